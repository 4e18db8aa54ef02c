"""Quality rules: a table of thresholds becomes one projection over the text, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

SPACE, UPPER, LOWER = "\x20\x09\x0a\x0b\x0c\x0d", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "#*$%&|<>"
#: Punctuation that may stand around a word.
AROUND = ".,;:!?\"'()[]«»“”„¿¡"
#: Words of a window, and the words in all and share of repeated ones that fail a text by themselves.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

# Frequent words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their "
    "de la le et les des en un du une que est pour qui dans par plus au ne se sur pas ce sont il mais nous avec ou leur cette "
    "el los las y del por con una su para es al lo como o pero sus ya entre cuando muy sin sobre ser también "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so"
).split()
STOP_WORDS = sorted(set(STOP_WORDS))


@dataclass(frozen=True)
class Threshold:
    """A text fails the rule if the measure lies below ``least`` or above ``most``; a measure that is null fails nothing."""

    rule: str
    measure: str
    least: float | None = None
    most: float | None = None


# Published limits of rule-based filters for web text.
THRESHOLDS = (
    Threshold("word_length", "mean_word_chars", 3.0, 10.0),
    Threshold("symbols", "symbol_ratio", most=0.1),
    Threshold("letters", "letter_word_ratio", least=0.8),
    Threshold("stop_words", "n_stop_words", least=2.0),
    Threshold("bullet_lines", "bullet_line_ratio", most=0.9),
    Threshold("ellipsis_lines", "ellipsis_line_ratio", most=0.3),
    Threshold("duplicate_lines", "dup_line_ratio", most=0.3),
)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words of an array lie in a window of ``size`` words that occurs twice or more, the first time included.

    Windows meet by hash; those whose hash is not alone are sorted with their words, so that only equal ones count.
    """

    def alike(items: Column, same) -> Column:
        return F.filter(items, lambda x, k: same(F.get(items, k - 1), x) | same(F.get(items, k + 1), x))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, s: F.struct((s + size).alias("end"), (acc["n"] + s + size - F.greatest(acc["end"], s)).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def among(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = let(placed, lambda p: alike(p, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
        whole = F.sort_array(F.transform(some, lambda c: F.struct(c["h"].alias("h"), F.slice(words, c["i"] + 1, size).alias("w"), c["i"].alias("i"))))
        equal = let(whole, lambda p: alike(p, lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(F.sort_array(F.transform(equal, lambda c: c["i"]))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(F.slice(words, i + 1, size)))
    return F.when(F.size(words) < size, 0).otherwise(let(hashes, among)).cast("long")


def measures(text: Column) -> Column:
    """struct of counts and ratios of a text; ratios of a text without words or lines are null."""
    squeezed = lambda t: F.translate(t, SPACE, "")
    long = lambda c: c.cast("long")

    def counts(b: Column) -> Column:
        words, lines = b["words"], b["lines"]
        plain = lambda w: F.translate(F.btrim(w, F.lit(AROUND)), UPPER, LOWER)
        having = lambda items, of: long(F.size(F.filter(items, of)))
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(b["solid"])).alias("word_chars"),
            long(F.length(b["solid"]) - F.length(F.translate(b["solid"], SYMBOLS, ""))).alias("n_symbols"),
            having(words, lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
            having(words, lambda w: plain(w).isin(STOP_WORDS)).alias("n_stop_words"),
            long(F.size(lines)).alias("n_lines"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            having(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[•‣*·-][\x20\x09-\x0D]")).alias("n_bullet_lines"),
            having(lines, lambda x: x.rlike(r"(?:…|\.\.\.)[\x20\x09-\x0D]*$")).alias("n_ellipsis_lines"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def ratios(c: Column) -> Column:
        words, lines = F.nullif(c["n_words"], F.lit(0)), F.nullif(c["n_lines"], F.lit(0))
        named = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
        return F.struct(
            *[c[k].alias(k) for k in named],
            (c["word_chars"] / words).alias("mean_word_chars"),
            (c["n_symbols"] / words).alias("symbol_ratio"),
            (c["n_letter_words"] / words).alias("letter_word_ratio"),
            (c["n_dup_lines"] / lines).alias("dup_line_ratio"),
            (c["n_bullet_lines"] / lines).alias("bullet_line_ratio"),
            (c["n_ellipsis_lines"] / lines).alias("ellipsis_line_ratio"),
        )

    def parts(t: Column) -> Column:
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: squeezed(x) != "")
        return let(F.struct(squeezed(t).alias("solid"), words.alias("words"), lines.alias("lines")), lambda b: let(counts(b), ratios))

    return let(F.coalesce(text, F.lit("")), parts)


def failed_rules(measured: Column, thresholds: Sequence[Threshold]) -> Column:
    """array of the rules that a struct of measures fails, in the order of the table."""

    def fails(t: Threshold) -> Column:
        m = measured[t.measure]
        parts = ([m < t.least] if t.least is not None else []) + ([m > t.most] if t.most is not None else [])
        if not parts:
            raise ValueError(f"{t.rule}: neither least nor most")
        return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))

    return F.array_compact(F.array(*[F.when(fails(t), F.lit(t.rule)) for t in thresholds])) if thresholds else F.array().cast("array<string>")


def thresholds_from(table: DataFrame, most_rows: int = 1000) -> tuple[Threshold, ...]:
    """The thresholds of a table (rule, measure, least, most), in order of rule; of ``most_rows`` rows at most."""
    rows = table.select("rule", "measure", F.col("least").cast("double"), F.col("most").cast("double")).orderBy("rule").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} thresholds")
    return tuple(Threshold(*r) for r in rows)


def assess(docs: DataFrame, text_col: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS, name: str = "quality") -> DataFrame:
    """Adds a struct of the measures, base_failed, kept and the failed rules to every row, in one projection: no shuffle, no Python.

    A null text is an empty one, has no words and fails.  base_failed says that a text has fewer than 20 words or that over 30 of
    100 lie in repeated windows of eight; such a text is not kept, whatever the thresholds say.  Each row is judged by itself, so
    ties and repeated rows change nothing; texts are read whole; other columns stay (but for one called ``name``).  An empty table gives an
    empty result.  A text of another language than those of STOP_WORDS needs a table without the rule of that name.
    """
    # A generated row is computed once; a projected struct would be put together anew wherever a field of it is read.
    measured = docs.select("*", F.explode(F.array(measures(F.col(text_col)))).alias("__m"))
    m = F.col("__m")
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    failed = failed_rules(m, thresholds)
    fields = [c for c in measured.schema["__m"].dataType.names]
    out = F.struct(*[m[c].alias(c) for c in fields], base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"))
    return measured.withColumn(name, out).drop("__m")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed): one row per row of docs."""
    q = assess(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", thresholds)
    named = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select(F.col("id").alias(id_col), *[F.col(f"quality.{c}").alias(c) for c in named], F.array_join("quality.failed", ",").alias("failed"))


def good_documents(docs: DataFrame, text_col: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return assess(docs, text_col, thresholds, "__quality").where("__quality.kept").drop("__quality")
