"""Mixing sources to target weights by pivotal dependent rounding over a tree of groups."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import taken_rows
from .scratch import written

#: Documents of a leaf, and groups whose residuals meet at the next level of the tree.
LEAF, FAN_IN = 2048, 256
#: Sources up to this many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    """Runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: float = 3.0) -> DataFrame:
    """(source, rows, source_size, target) of rows (source, size, n), each of which stands for n equal ones.

    Sources in code point order, null last, get the weights in turn and share the total of all sizes; no target
    exceeds max_repeats times its source's size.  With sources in order of limit by weight, those come first that
    are full when the level of all reaches their limit; the others share what is left.
    """
    sums = sized.groupBy("source").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # One row per source from here on.
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sums.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(max_repeats)))
    before = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, all_weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    used, gone = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = used + F.col("most") / F.col("weight") * (all_weights - gone) <= total
    s = s.withColumn("full", full).withColumn("total", total)
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    share = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(left / F.nullif(share, F.lit(0.0)) * F.col("weight"))
    return s.select("source", "rows", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def pivotal(size: np.ndarray, frac: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds fractional copies pair by pair; (0 or 1 for each, the index that stays fractional or -1).

    Of a pair, words move from one document to the other until a probability is 0 or 1; the direction is drawn so
    that expectations stay.  frac is changed in place.  The sum of frac * size stays the same.
    """
    carry = -1
    draws = rng.random(len(size))
    for i in range(len(size)):
        if not 0 < frac[i] < 1:
            continue
        if size[i] == 0:
            frac[i] = float(draws[i] < frac[i])
            continue
        if carry < 0:
            carry = i
            continue
        a, b = carry, i
        to_a = min((1 - frac[a]) * size[a], frac[b] * size[b])
        to_b = min((1 - frac[b]) * size[b], frac[a] * size[a])
        gain, lose, moved = (a, b, to_a) if draws[i] * (to_a + to_b) < to_b else (b, a, to_b)
        fills, empties = moved == (1 - frac[gain]) * size[gain], moved == frac[lose] * size[lose]
        frac[gain] = 1.0 if fills else frac[gain] + moved / size[gain]
        frac[lose] = 0.0 if empties else frac[lose] - moved / size[lose]
        carry = lose if fills else gain
        if not 0 < frac[carry] < 1:
            carry = -1
    return frac, carry


def _round_group(seed: int, level: int):
    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "id", "row", "frac"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        name = group["source"].iloc[0]
        name = b"\xff" if name is None or name != name else str(name).encode()
        rng = np.random.default_rng([seed, level, int(group["leaf"].iloc[0]), zlib.crc32(name)])
        frac, carry = pivotal(group["size"].to_numpy(np.float64), group["frac"].to_numpy(np.float64).copy(), rng)
        settled = np.ones(len(group), dtype=bool)
        if carry >= 0:
            if group["leaves"].iloc[0] == 1:
                frac[carry] = float(rng.random() < frac[carry])
            else:
                settled[carry] = False
        group["frac"], group["settled"] = frac, settled
        return group

    return rounded


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: float = 3.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", leaf_rows: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """How often a mix takes each row: (id, row, source, size, source_size, target, copies); row is a hash of the text.

    Every row of a source is due target / source_size copies: the whole part it gets, the fraction is rounded.  Leaves of
    about ``leaf_rows`` rows round on their own, largest first, and leave one fractional row at most; those rows meet
    ``fan_in`` at a time at the next level, until one per source is drawn.  So a source's words miss its target by less
    than one document, and a hot source is many leaves.  Null texts have size 0, a null source is a source of its own,
    repeated rows count as often as they occur, ties are broken by id and text hash, and reruns agree.  An empty table
    gives an empty result; other columns are not read.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = written(sized.groupBy("id", "row", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = written(source_targets(sized, weights, max_repeats))
    sources, most = targets.agg(F.count(F.lit(1)), F.max("rows")).first()
    t = targets.withColumnRenamed("source", "t_source")
    t = F.broadcast(t) if sources <= BROADCAST_SOURCES else t
    due = F.coalesce(F.least(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(float(max_repeats))), F.lit(0.0))
    state = sized.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "id", "row", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), "source_size", "target", F.floor(due).cast("long").alias("whole"), (due - F.floor(due)).alias("frac"), F.ceil(F.col("rows") / leaf_rows).cast("long").alias("leaves")
    )
    # Equal rows are numbered, so they are dealt out as well, and alike in each run.
    state = state.withColumn("leaf", F.pmod(F.xxhash64("id", "row", "copy", F.lit(seed)), F.col("leaves"))).drop("copy")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema) + ", settled boolean"
    done, level, leaves = [], 0, -(-(most or 0) // leaf_rows)
    while True:
        got = written(state.groupBy("source", "leaf").applyInPandas(_round_group(seed, level), schema))
        done.append(got.where("settled"))
        if leaves <= 1:
            break
        level, leaves = level + 1, -(-leaves // fan_in)
        up = {"leaf": F.floor(F.col("leaf") / fan_in).cast("long"), "leaves": F.ceil(F.col("leaves") / fan_in).cast("long")}
        state = got.where("not settled").withColumns(up).drop("settled")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("id", "row", "source", "size", "source_size", "target", (F.col("whole") + F.col("frac").cast("long")).alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """mix() as (doc_id, size, source_size, target, taken, copies, source); taken is the number of words, repeats counted."""
    return mix(docs, **options).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with all their columns."""
    took = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    took = took.groupBy("id", "row", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    return taken_rows(docs, {"id": F.col(id_col), "row": F.xxhash64(text_col), "source": F.col(source_col)}, took)
