"""Joins of rows with their groups when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group above this share of all rows is spread over several tasks.
SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], members: str, spread: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row for each of ``keys``, with how many rows of a ``total`` it has) on keys.

    A group with more than 1 / SHARE of all rows (1000 rows at least) gets as many copies as it exceeds that, and its rows
    choose one by a hash of ``spread``.  There are at most SHARE such groups, so their keys are broadcast to the rows.
    """
    least = max(1000, total // SHARE)
    large = groups.where(F.col(members) > least).select(*keys, F.ceil(F.col(members) / least).cast("int").alias("__salts"))
    left = rows.join(F.broadcast(large), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    copies = F.sequence(F.lit(0), F.when(F.col(members) > least, F.ceil(F.col(members) / least).cast("int") - 1).otherwise(F.lit(0)))
    right = groups.withColumn("__salt", F.explode(copies))
    return left.join(right, [*keys, "__salt"], how)
