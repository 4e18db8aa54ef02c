"""Classification of texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..jobs.classification import classify
from ..sources.tables import write_results


def read_texts(spark: SparkSession, path: str, schema: str = "doc_id long, text string", fmt: str = "parquet", files_per_trigger: int | None = None, name: str | None = None) -> DataFrame:
    """A stream of the files that appear in a folder, of those that fit ``name`` (a glob) if it is given."""
    reader = spark.readStream.format(fmt).schema(schema)
    reader = reader.option("pathGlobFilter", name) if name else reader
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def classify_stream(texts: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False, **options) -> StreamingQuery:
    """Appends classified rows to a table; there is no state and no shuffle, so no watermark is needed."""
    writer = classify(texts, **options).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def classify_batches(texts: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = False, **options) -> StreamingQuery:
    """As classify_stream(), into partitions ``batch`` of a table that Spark may write again: a batch that is run a second time, after
    a failure or by hand, takes the place of what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        replace_batch(classify(batch, **options), path, number, fmt)

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replace_batch(rows: DataFrame, path: str, number: int, fmt: str = "parquet") -> None:
    """Writes the rows of one batch in place of those it wrote before; other batches stay."""
    write_results(rows.withColumn("batch", F.lit(number).cast("long")), path, fmt, ["batch"], only_partitions=True)
