"""Language ID by rank-order profiles: out-of-place distance between a text's frequent n-grams and each language's."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: n-grams of a profile.
RANKS = 300
#: Labelled documents per language that profiles are learned from, about; chosen by a hash of the id.
LEARN_PER_LANGUAGE = 3000
UNDETERMINED = "und"

_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
_SLICE = 1 << 20  # characters whose n-grams are sorted at a time while learning


def gram_codes(text: str) -> np.ndarray:
    """The 1- to 3-grams of a text's lower-cased words, each word between spaces, as whole numbers of 21 bits a character."""
    low = text.lower()
    words = _WORD.findall(low)
    if not "".join(words).isalpha():  # number signs such as ½ count as word characters, but are no letters
        words = _LETTERS.findall(low)
    joined = " " + " ".join(words) + " " if words else ""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    one, two = c[c != 32], c[:-1] << 21 | c[1:]
    inner = c[1:-1] != 32
    three = (two[:-1] << 21 | c[2:])[inner]
    return np.concatenate([one, two, three])


def top_grams(text: str, ranks: int = RANKS) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, ties in order of code."""
    grams, counts = np.unique(gram_codes(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:ranks]]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def learn_profiles(docs: DataFrame, ranks: int = RANKS, per_language: int = LEARN_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams in labelled documents that aren't held out.

    Only ids and languages are read to choose about ``per_language`` documents of each language (all, if there are
    fewer), then their whole texts.  The result has ``ranks`` numbers per language, whatever the corpus.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))]), F.col("lang"))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit("learn")), F.lit(1_000_000)) < share * 1_000_000).where(F.col("text").isNotNull())

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                size = texts.str.len().cumsum() // _SLICE
                for _, part in texts.groupby(size):
                    grams, n = np.unique(gram_codes(" ".join(part)), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    summed = chosen.select("lang", "text").mapInPandas(counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = summed.select("lang", "gram", rank.alias("rank")).where(F.col("rank") <= ranks).collect()
    profiles: dict[str, list] = {lang: [] for lang in sizes}
    for row in sorted(best, key=lambda r: r["rank"]):
        profiles[row["lang"]].append(row["gram"])
    return {lang: np.array(grams, dtype=np.int64) for lang, grams in sorted(profiles.items()) if grams}


class Profiles:
    """Profiles as one table of ranks, for out-of-place distances to all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], ranks: int = RANKS):
        self.languages, self.ranks = list(profiles), ranks
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.table = np.full((len(profiles), len(self.grams) + 1), -1, dtype=np.int64)
        for row, grams in zip(self.table, profiles.values(), strict=True):
            row[np.searchsorted(self.grams, grams)] = np.arange(len(grams))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Of each language: the sum over the text's n-grams of how far they are from their place, ``ranks`` if missing."""
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (np.append(self.grams, -1)[at] != top)] = len(self.grams)
        place = self.table[:, at]
        return np.where(place < 0, self.ranks, np.abs(place - np.arange(len(top)))).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first of several) and 1 less its distance as a share of the largest possible."""
        top = top_grams(text, self.ranks) if text else np.empty(0, np.int64)
        if not len(top) or not self.languages:
            return UNDETERMINED, 0.0
        distance = self.distances(top)
        best = int(distance.argmin())
        return self.languages[best], float(max(0.0, 1 - distance[best] / (self.ranks * len(top))))


def identify(docs: DataFrame, ranks: int = RANKS, per_language: int = LEARN_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row, from its whole text alone.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or nothing could be learned.  Repeated rows
    are judged alike; an empty table gives an empty result; columns other than id, text and language are not read.
    """
    model = Profiles(learn_profiles(docs, ranks, per_language, id_col, text_col, lang_col), ranks)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    judged = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return judged.select(id_col, "held_out", "p.lang_pred", "p.score")


def identified_documents(docs: DataFrame, ranks: int = RANKS, per_language: int = LEARN_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language can be told, with the columns of docs."""
    model = Profiles(learn_profiles(docs, ranks, per_language, id_col, text_col, lang_col), ranks)

    @F.arrow_udf("string")
    def language(texts: pa.Array) -> pa.Array:
        return pa.array([model.predict(t.as_py())[0] for t in texts], pa.string())

    return docs.where(language(F.col(text_col)) != UNDETERMINED)
