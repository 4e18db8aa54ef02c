"""Replacing spans by placeholders, with their places in the new text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, running_sums
from .overlap import best_first, with_disjoint

DETAIL = "struct<entity_type:string, location:string, confidence_score:double, entity_value:string, start_index:int, end_index:int>"


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def redaction(text: Column, spans: Column, escape: bool = True, disjoint: bool = False) -> Column:
    """struct<data, details>: the text with <ENTITY> in place of each kept span, and each span's place in it.

    Of overlapping spans the best stays; ``disjoint`` says that none overlap any more.  Values come from the original text; places count the escaped characters.
    """
    shown = html_escaped if escape else (lambda c: c)

    def gap(kept: Column, s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))
        return shown(F.substring(text, at + 1, s["start"] - at))

    def replaced(kept: Column) -> Column:
        parts = F.transform(kept, lambda s, i: F.struct(gap(kept, s, i).alias("gap"), shown(F.concat(F.lit("<"), s["entity_type"], F.lit(">"))).alias("mark")))

        def finish(p: Column) -> Column:
            ends = running_sums(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["mark"])))
            tail = shown(F.substring(text, F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)) + 1, F.length(text)))

            def detail(s: Column, i: Column, e: Column) -> Column:
                b = F.get(e, i)
                a = b - F.length(F.get(p, i)["mark"])
                return F.struct(s["entity_type"].alias("entity_type"), F.concat_ws("_", a.cast("string"), b.cast("string")).alias("location"), s["score"].alias("confidence_score"), s["value"].alias("entity_value"), a.alias("start_index"), b.alias("end_index"))

            details = let(ends, lambda e: F.transform(kept, lambda s, i: detail(s, i, e)))
            return F.struct(F.concat(F.array_join(F.transform(p, lambda x: F.concat(x["gap"], x["mark"])), ""), tail).alias("data"), details.cast(f"array<{DETAIL}>").alias("details"))

        return let(parts, finish)

    return let(spans if disjoint else best_first(spans), replaced)


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans", escape: bool = True, dense: bool = False) -> DataFrame:
    """Adds data and details; where the text is null, data is null: the text itself is never passed on instead.

    ``dense`` is for rows with many thousands of spans that overlap in chains, which an interval set in Python decides.
    """
    out = with_disjoint(df, spans_col, "__kept", best=True) if dense else df.withColumn("__kept", F.col(spans_col))
    out = out.withColumn("__r", redaction(F.col(text_col), F.col("__kept"), escape, disjoint=dense))
    return out.withColumn("data", F.col("__r.data")).withColumn("details", F.col("__r.details")).drop("__r", "__kept")
