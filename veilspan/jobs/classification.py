"""Corpus classification: texts in, details and redacted texts out, and corpus counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.validators import Validator
from ..operators.detect import AS_OF, SPAN, find_spans, spans_column, unknown_country, with_spans
from ..operators.overlap import with_disjoint
from ..operators.redact import redaction
from ..sources.rules import Rules, load_rules

DETAIL = "struct<location:string, confidence_score:double, entity_value:string, start_index:int, end_index:int>"


def split_valid(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds status: 400 where the text is missing or empty, else 200."""
    return df.withColumn("status", F.when(F.col(text_col).isNull() | (F.col(text_col) == ""), 400).otherwise(200))


def display_name(entity: Column, rules: Rules) -> Column:
    names = {r.entity: r.name for r in rules}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), entity), entity)


def span_details(spans: Column) -> Column:
    """Details of spans in the text itself."""
    return F.transform(spans, lambda s: F.struct(s["entity_type"].alias("entity_type"), F.concat_ws("_", s["start"].cast("string"), s["end"].cast("string")).alias("location"), s["score"].alias("confidence_score"), s["value"].alias("entity_value"), s["start"].alias("start_index"), s["end"].alias("end_index")))


def details_by_name(details: Column, rules: Rules) -> Column:
    """map<display name, details in order of start>, made within the row."""
    fields = ("location", "confidence_score", "entity_value", "start_index", "end_index")

    def by_name(all_of: Column) -> Column:
        own = lambda n: F.transform(F.filter(all_of, lambda d: d["name"] == n), lambda d: F.struct(*[d[c].alias(c) for c in fields]))
        names = F.array_distinct(F.transform(all_of, lambda d: d["name"]))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), own(n).alias("value"))))

    return let(F.transform(details, lambda d: F.struct(display_name(d["entity_type"], rules).alias("name"), *[d[c].alias(c) for c in fields])), by_name)


def classify(df: DataFrame, text_col: str = "text", countries: list[str] | Column | None = None, anonymize: bool | Column = False, rules: Rules | None = None, as_of: str = AS_OF, validators: Mapping[str, Validator | object] | None = None, dense: bool = False) -> DataFrame:
    """Adds status, data and entityDetails to every row, without a shuffle.

    With anonymize, data is the redacted text and locations are places in it; without, data is empty and they are places in
    the text.  A row without a text gets status 400, empty data and an empty map.  ``countries`` names the countries whose rules
    hold, for all rows or, as an array column, for each row; a row that names one without rules, while there are no GLOBAL
    ones, gets status 400 as well.  ``dense`` is for texts with many thousands of spans that overlap in chains: which of them stay is then
    decided by an interval set in Python, with the same result.
    """
    by_row = countries if isinstance(countries, Column) else None
    rules = rules if rules is not None else load_rules(None if by_row is not None else countries)
    hide = anonymize if isinstance(anonymize, Column) else F.lit(anonymize)
    out = split_valid(df, text_col)
    if by_row is not None:
        out = out.withColumn("status", F.when(unknown_country(rules.enabled(), by_row), 400).otherwise(F.col("status")))
    none = F.array().cast(f"array<{SPAN}>")
    if validators:
        out = with_spans(out, rules, text_col, as_of, validators, "__all", by_row).withColumn("__spans", F.when(F.col("status") == 200, F.col("__all")).otherwise(none)).drop("__all")
    else:
        out = out.withColumn("__spans", F.when(F.col("status") == 200, spans_column(df.sparkSession, text_col, rules, as_of) if by_row is None else find_spans(F.col(text_col), rules, as_of, None, by_row)).otherwise(none))
    kept = F.col("__spans")
    if dense:
        out, kept = with_disjoint(out, "__spans", "__kept", best=True), F.col("__kept")
    out = out.withColumn("__r", F.when(F.coalesce(hide, F.lit(False)) & (F.col("status") == 200), redaction(F.col(text_col), kept, disjoint=dense)))
    details = F.coalesce(F.col("__r.details"), span_details(F.col("__spans")))
    return out.withColumn("data", F.coalesce("__r.data", F.lit(""))).withColumn("entityDetails", details_by_name(details, rules)).drop("__spans", "__kept", "__r")


def entity_details(classified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, entity, location, confidence_score, entity_value, start_index, end_index): one row per detail."""
    # The outer form: for the inner one Spark would test the map's size first, and so compute it twice.
    each = classified.select(id_col, F.explode_outer("entityDetails").alias("entity", "details")).where("entity is not null")
    return each.select(id_col, "entity", F.explode("details").alias("d")).select(id_col, "entity", "d.*")


def entity_counts(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, entity_type, n): spans per document and entity, per document, and in all."""
    return spans.rollup(id_col, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(spans: DataFrame, rules: Rules, id_col: str = "doc_id") -> DataFrame:
    """Spans and documents per entity; one row per entity, summed before the shuffle."""
    return spans.groupBy(display_name(F.col("entity_type"), rules).alias("entity")).agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct(id_col).alias("n_docs"))
