"""Taking decided rows out of a table, each as often as decided, without a row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def taken_rows(docs: DataFrame, keys: dict[str, Column], decided: DataFrame) -> DataFrame:
    """The rows of docs whose keys are in ``decided`` (keys, n, copies), copies times in all for each key.

    ``n`` says how many rows of docs share the key; one of them stands for all.  Keys that name one row, nearly all,
    are joined as they are; only rows of the others meet in an aggregate.
    """
    names = list(keys)
    keyed = docs.select(F.struct("*").alias("row"), *[c.alias(f"k_{k}") for k, c in keys.items()])
    given = decided.where("copies > 0").select(*[F.col(k).alias(f"d_{k}") for k in names], "n", F.col("copies").cast("long").alias("copies"))
    same = [F.col(f"k_{k}").eqNullSafe(F.col(f"d_{k}")) for k in names]
    one = keyed.join(given.where("n = 1"), same).select("row", "copies")
    many = keyed.join(given.where("n > 1"), same).groupBy(*[f"k_{k}" for k in names]).agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies")
    return one.unionByName(many).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
