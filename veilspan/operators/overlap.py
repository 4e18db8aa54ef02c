"""Spans that overlap: pairs, groups, and choices of spans that don't."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, running_max


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals that share a place."""
    return (a_start < b_end) & (b_start < a_end)


#: Characters of a stretch of text; spans meet by document and stretch.
STRETCH = 1024


def overlap_pairs(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, a_*, b_*): pairs of different spans of a document that overlap, each once.

    Spans meet in the stretches of text that they touch, and a pair counts in the one where the later of its two starts lies, so
    the work follows the spans near each other and not the square of a document's.
    """
    cols = ["entity_type", "start", "end"]
    stretch = lambda at: F.floor(at / STRETCH).cast("int")
    touched = F.explode(F.sequence(stretch(F.col("start")), stretch(F.greatest(F.col("end") - 1, F.col("start"))))).alias("__stretch")
    a = spans.select(F.col(id_col), *[F.col(c).alias(f"a_{c}") for c in cols], touched)
    b = spans.select(F.col(id_col), *[F.col(c).alias(f"b_{c}") for c in cols], touched)
    key = lambda s: F.struct(f"{s}_start", f"{s}_end", f"{s}_entity_type")
    apart = overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")) & (key("a") < key("b"))
    return a.join(b, [id_col, "__stretch"]).where(apart & (F.col("__stretch") == stretch(F.greatest("a_start", "b_start")))).drop("__stretch")


def overlap_groups(spans: DataFrame, id_col: str = "doc_id", name: str = "overlap_group") -> DataFrame:
    """Adds the number, from 1, of the run of overlapping spans in the document that a span belongs to."""
    order = Window.partitionBy(id_col).orderBy("start", "end", "entity_type")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return spans.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__begins")


def greedy(spans: Column, rank: Callable[[Column, Column], Column]) -> Column:
    """Spans taken in order of rank(span, index) unless they overlap one taken before; by start.

    Only spans of one run of overlapping ones can exclude each other, so runs are decided on their own: the cost follows the
    number of spans and the square of the longest run.
    """

    def decided(run: Column) -> Column:
        taken = lambda acc, x: F.exists(acc, lambda t: overlaps(t["start"], t["end"], x["start"], x["end"]))
        ordered = F.transform(F.array_sort(F.transform(run, lambda x: F.struct(x["rank"].alias("rank"), x.alias("x")))), lambda o: o["x"])
        kept = F.aggregate(ordered, F.slice(run, 1, 0), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
        return F.when(F.size(run) == 1, run).otherwise(F.array_sort(kept))

    def over(items: Column) -> Column:
        def cut(b: Column) -> Column:
            length = lambda k, at: F.coalesce(F.get(b["begins"], k + 1), F.size(items)) - at
            return F.flatten(F.transform(b["begins"], lambda at, k: decided(F.slice(items, at + 1, length(k, at)))))

        def begins(reach: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | (F.get(items, i)["start"] >= F.get(reach, i - 1)))

        starts = let(running_max(F.transform(items, lambda x: x["end"])), begins)
        return F.when(F.size(items) > 1, let(F.struct(starts.alias("begins")), cut)).otherwise(items)

    items = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), rank(s, i).alias("rank"), s.alias("span"))))
    return F.transform(let(items, over), lambda x: x["span"])


def first_come(spans: Column) -> Column:
    """Spans of an array, taken in its order, that overlap none taken before; by start."""
    return greedy(spans, lambda s, i: i)


def best_rank(s: Column, i: Column | None = None) -> Column:
    """Score, length (both falling), start and entity."""
    return F.struct((-s["score"]).alias("score"), (s["start"] - s["end"]).alias("length"), s["start"].alias("start"), s["entity_type"].alias("entity_type"))


def best_first(spans: Column) -> Column:
    """Spans in the order of best_rank(), none overlapping one taken before; by start."""
    return greedy(spans, best_rank)


#: Arrays of more spans go to disjoint_places(), whose cost does not follow the square of a run.
DENSE = 1000


def taken_places(starts: list[int], ends: list[int]) -> list[int]:
    """Numbers of the intervals, taken in the order given, that overlap none taken before.

    What is taken is a sorted set of disjoint intervals: of those that begin before an interval ends, the last one reaches farthest.
    """
    begun, ended, taken = [], [], []
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        at = bisect_left(begun, b)
        if not at or ended[at - 1] <= a:
            begun.insert(at, a)
            ended.insert(at, b)
            taken.append(k)
    return taken


def disjoint_places(starts: Column, ends: Column) -> Column:
    """array<int>: taken_places() of the two arrays of each row."""

    @F.arrow_udf("array<int>")
    def places(starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([taken_places(a, b) if a else [] for a, b in zip(starts.to_pylist(), ends.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return places(starts, ends)


def with_disjoint(df: DataFrame, spans_col: str, name: str, best: bool = False, dense: int = DENSE) -> DataFrame:
    """Adds the spans of an array column that first_come() or best_first() keeps; long arrays are decided by an interval set in Python."""
    rank = best_rank if best else (lambda s, i: i)
    spans, few = F.col(spans_col), F.size(F.col(spans_col)) <= dense
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct(rank(s, i).alias("rank"), i.alias("i"), s["start"].alias("start"), s["end"].alias("end"))))
    long = F.when(~few, F.transform(ranked, lambda x: F.struct(x["i"].alias("i"), x["start"].alias("start"), x["end"].alias("end"))))
    # A generated row is computed once; a projected array would be sorted anew wherever it is read.
    out = df.select("*", F.explode(F.array(F.coalesce(long, F.array().cast("array<struct<i:int,start:int,`end`:int>>")))).alias("__ranked"))
    out = out.withColumn("__taken", disjoint_places(F.transform("__ranked", lambda x: x["start"]), F.transform("__ranked", lambda x: x["end"])))
    picked = F.transform("__taken", lambda p: let(F.get(spans, F.get(F.col("__ranked"), p)["i"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("span"))))
    dense_kept = F.transform(F.array_sort(picked), lambda x: x["span"])
    return out.withColumn(name, F.when(few, best_first(spans) if best else first_come(spans)).otherwise(dense_kept)).drop("__ranked", "__taken")


def non_overlapping(spans: DataFrame, id_col: str = "doc_id", within: Sequence[str] = (), best: bool = False) -> DataFrame:
    """Rows of spans, per document (and ``within``), that first_come() or best_first() keeps; first come goes by start, end, entity."""
    keys = [id_col, *within]
    rest = [c for c in spans.columns if c not in keys]
    lead = ["start", "end", "entity_type"]
    item = F.struct(*[c for c in lead if c in rest], *[c for c in rest if c not in lead])
    # An array per document holds its spans only; the text stays behind.
    grouped = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__spans"))
    return with_disjoint(grouped, "__spans", "__kept", best).select(*keys, F.explode("__kept").alias("s")).select(*keys, "s.*")
