"""Where jobs put tables that they read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (local tests), a temporary one of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="veilspan-")
    return _FALLBACK[app]


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/veilspan-{uuid.uuid4().hex}"
