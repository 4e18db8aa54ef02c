"""Tables written to the shared folder, to cut lineage in a way that survives a lost executor."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import new_folder

#: Bytes of an Arrow batch of whole texts, about; a longer text is a batch of its own.
TEXT_BYTES = 4 << 20
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_KEPT: dict[str, list[str]] = {}


@contextmanager
def arrow_bytes(spark: SparkSession, most: int | None) -> Iterator[None]:
    """What runs inside sends Python batches of about ``most`` bytes (None: as the session says); the setting comes back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if most and before is not None:
            spark.conf.set(key, before)
        elif most:
            spark.conf.unset(key)


def written(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, then read from there by whatever uses it."""
    spark = df.sparkSession
    path = new_folder(spark)
    with arrow_bytes(spark, batch_bytes):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return table


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read any more."""
    for table in tables:
        path, spark = _PLACES.pop(table, None), table.sparkSession
        if path:
            _delete(spark, path)
            _KEPT[spark.sparkContext.applicationId].remove(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; call it once its results are stored, as they read these tables."""
    for path in _KEPT.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
