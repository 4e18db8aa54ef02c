"""Predictions against gold: pairs, metrics, and the rows where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ENTITY, parse_entities  # noqa: F401


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’", "''")


def response_entities(df: DataFrame, id_col: str = "row_id", details_col: str = "entityDetails") -> DataFrame:
    """(id, label, start, end, extracted_text) from a map of detail lists; details with an unreadable location are skipped."""
    each = df.select(id_col, F.explode_outer(details_col).alias("label", "details")).where("label is not null").select(id_col, "label", F.explode("details").alias("d"))
    place = F.split("d.location", "_")
    out = each.select(id_col, "label", F.get(place, 0).try_cast("int").alias("start"), F.get(place, 1).try_cast("int").alias("end"), F.col("d.entity_value").alias("extracted_text"))
    return out.where("start is not null and end is not null")


def entity_pairs(df: DataFrame, entities_col: str, id_col: str = "row_id") -> DataFrame:
    """Distinct (id, label, value) of an array of entities, trimmed; made distinct in the row, before any shuffle."""
    pairs = F.array_distinct(F.transform(entities_col, lambda e: F.struct(F.trim(e["label"]).alias("label"), F.trim(e["extracted_text"]).alias("value"))))
    return df.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.label", "p.value")


def matched_pairs(gold: DataFrame, predicted: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, label, value, in_gold, in_predicted): the full outer join of distinct pairs."""
    keys = [id_col, "label", "value"]
    g, p = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True)), predicted.select(*keys).distinct().withColumn("in_predicted", F.lit(True))
    return g.join(p, keys, "full_outer").select(*keys, F.coalesce("in_gold", F.lit(False)).alias("in_gold"), F.coalesce("in_predicted", F.lit(False)).alias("in_predicted"))


def entity_metrics(gold: DataFrame, predicted: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Per label: counts, accuracy, precision, recall and F1; a zero denominator gives 0."""
    m = matched_pairs(gold, predicted, id_col)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g, p = F.col("in_gold"), F.col("in_predicted")
    counts = m.groupBy(F.col("label").alias("entity_type")).agg(n(g).alias("actual_count"), F.count_distinct(F.when(g, F.col(id_col))).alias("support"), n(g & p).alias("correct"), n(~g & p).alias("extra"), n(g & ~p).alias("missed"), F.lit(0).cast("long").alias("wrong"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("correct"), F.col("extra"), F.col("missed")
    scored = counts.select("*", ratio(tp, tp + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_average(metrics: DataFrame) -> DataFrame:
    """The unweighted mean of each score over labels; 0 without labels."""
    return metrics.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("accuracy", "precision", "recall", "f1")])


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column and ``total``; one pass."""
    sums = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(f"n{i}", F.lit(0)).cast("long").alias("nulls")) for i, c in enumerate(df.columns)]
    total = sum((F.coalesce(f"n{i}", F.lit(0)).cast("long") for i in range(1, len(df.columns))), F.coalesce("n0", F.lit(0)).cast("long"))
    return sums.select(F.explode(F.array(*pairs, F.struct(F.lit("total").alias("column"), total.alias("nulls")))).alias("p")).select("p.*")


def unmatched(left: DataFrame, right: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Entities (id, label, value, start, end) of left that match none of right in text or place; id and label are the join key."""
    a = left.alias("a")
    b = right.alias("b")
    same = (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.lower("a.label") == F.lower("b.label"))
    alike = (F.trim("a.value") == F.trim("b.value")) | ((F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end")))
    return a.join(b, same & alike, "left_anti")


def rows_with_extra(df: DataFrame, gold: DataFrame, predicted: DataFrame, label: str, id_col: str = "row_id") -> DataFrame:
    """Rows of df with a prediction of the label that no gold entity matches."""
    mine = F.lower("label") == label.lower()
    return df.join(unmatched(predicted.where(mine), gold.where(mine), id_col).select(id_col), id_col, "left_semi")


def rows_with_missed(df: DataFrame, gold: DataFrame, predicted: DataFrame, label: str, id_col: str = "row_id") -> DataFrame:
    """Rows of df with a gold entity of the label that no prediction matches."""
    return rows_with_extra(df, predicted, gold, label, id_col)


def only_label(entities: Column, label: str) -> Column:
    """The entities of an array that have the label, in any case."""
    return F.filter(entities, lambda e: F.lower(e["label"]) == label.lower())


def relabel_from_predictions(df: DataFrame, label: str, gold_col: str = "mapped_output", predicted_col: str = "classification_results") -> DataFrame:
    """Gold replaced by the predictions of one label."""
    return df.withColumn(gold_col, only_label(F.col(predicted_col), label))


def pair_sets(gold: Column, predicted: Column) -> Column:
    """struct<correct, extra, missed> of two arrays of pairs, as sets, within the row."""
    return F.struct(F.array_intersect(gold, predicted).alias("correct"), F.array_except(predicted, gold).alias("extra"), F.array_except(gold, predicted).alias("missed"))


def ranked_metrics(metrics: DataFrame, only_found: bool = False, k: int | None = None) -> DataFrame:
    """Metrics by falling F1, then label; without labels of F1 0, or only the first k, if asked for."""
    out = (metrics.where("f1 > 0") if only_found else metrics).orderBy(F.desc("f1"), "entity_type")
    return out if k is None else out.limit(k)
