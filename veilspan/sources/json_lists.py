"""JSON lists of any size, read by all tasks: a file is split, and records are put together across splits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits of all files together: one small row each goes to every task.
MOST_SPLITS = 2_000_000
#: Where the reader cuts: every record ends there, though not everything that ends there is a record.
END = "}"
_ESCAPED = re.compile(r"\\.", re.DOTALL)
#: A record of its own; the end of one that an earlier split began; one that a later split ends; neither begun nor ended here.
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def _opened(piece: str, inside: bool) -> tuple[int, bool]:
    """(braces opened outside strings, whether the piece ends inside a string) if it begins inside one or not."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    return sum(p.count("{") for p in parts[int(inside) :: 2]), inside != (len(parts) % 2 == 0)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: whether it changes between inside and outside a string, and by how much it deepens, begun outside or inside one."""
    at, states, deep = None, [False, True], [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([states[0]]), *(pa.array([d], pa.int64()) for d in deep)], ["file", "block", "turned", "outside", "inside"])

    for batch in batches:
        for file, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != at:
                if at is not None:
                    yield row()
                at, states, deep = (file, block), [False, True], [0, 0]
            for k in (0, 1):
                opened, states[k] = _opened(piece, states[k])
                deep[k] += opened - (not states[k])
    if at is not None:
        yield row()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, kind, text): whole records, and what a split holds of those that others begin or end."""
    at, inside, depth, parts, carried, out = None, False, 0, [], False, []

    def end() -> None:
        if parts:
            out.append((*at, MIDDLE if carried else TAIL, "".join(parts)))

    def drained() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["file", "block", "kind", "text"])

    for batch in batches:
        for file, block, piece, starts_inside, starts_deep in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (file, block) != at:
                end()
                at, inside, depth, parts = (file, block), starts_inside, starts_deep, []
                carried = inside or depth > 0
            if depth <= 0 and not inside:
                first = piece.find("{")
                if first < 0:  # between records, or after the last
                    depth = 0
                    continue
                piece, depth = piece[first:], 0
            opened, inside = _opened(piece, inside)
            depth += opened - (not inside)
            parts.append(piece + END)
            if depth <= 0 and not inside:
                out.append((*at, HEAD if carried else WHOLE, "".join(parts)))
                parts, carried = [], False
        yield drained()
    end()
    yield drained()


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(json): the objects of files that hold one JSON list of objects each, or a single object, as texts.

    Spark cuts a file at any place after a closing brace.  A first pass tells for each split how it changes the nesting; from these
    few numbers follows whether a split begins inside a string or a record, and a second pass cuts the records out.  Only the parts of
    records that lie across splits meet in a shuffle.  UTF-8; repeated records stay; an empty file has none.
    """
    pieces = spark.read.option("lineSep", END).text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    found = pieces.mapInArrow(_summaries, "file long, block long, turned boolean, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(F.col("turned").cast("int")).over(before), F.lit(0)) % 2 == 1
    deepened = F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside"))
    known = found.withColumn("begins", turned).withColumn("by", deepened).select("file", "block", "begins", F.coalesce(F.sum("by").over(before), F.lit(0).cast("long")).alias("depth"))
    # One row a split, gathered once: as a plan it would be another pass over the files whenever it is planned anew.
    rows = known.limit(MOST_SPLITS + 1).toArrow()
    if rows.num_rows > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    states = spark.createDataFrame(rows) if rows.num_rows else known.where("false")
    cut = pieces.join(F.broadcast(states), ["file", "block"]).select("file", "block", "value", "begins", "depth").mapInArrow(_records, "file long, block long, kind int, text string")
    order = Window.partitionBy("file").orderBy("block", (F.col("kind") == TAIL).cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = cut.where(F.col("kind") != WHOLE).withColumn("begun", F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "")
    crossing = parts.groupBy("file", "begun").agg(joined.alias("json"))
    return cut.where(F.col("kind") == WHOLE).select(F.col("text").alias("json")).unionByName(crossing.select("json"))


def read_json_list(spark: SparkSession, path: str | list[str], schema: str, corrupt: str | None = None) -> DataFrame:
    """The records of json_records() under a schema; what is missing is null, and so is all of a record that cannot be read.

    ``corrupt`` names a column for the text of such a record.
    """
    fields = schema if corrupt is None else f"{schema}, `{corrupt}` string"
    options = {} if corrupt is None else {"columnNameOfCorruptRecord": corrupt}
    parsed: Column = F.from_json("json", fields, options)
    return json_records(spark, path).select(F.explode(F.array(parsed)).alias("r")).select("r.*")
