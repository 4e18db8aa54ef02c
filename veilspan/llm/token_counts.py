"""Exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import TEXT_BYTES, written
from .tokens import flat, gathered, word_tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Lengths of a block: sums run within blocks and over blocks, so that no task sorts all lengths.
BLOCK = 1024


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """(n_tokens, docs): how many texts have each encoded length, counted within each batch already."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        for batch in gathered(batches):
            counts: dict[int, int] = {}
            for docs_ids in tokenizer.encode_all(flat(batch.column(0))):
                for ids in docs_ids:
                    counts[len(ids)] = counts.get(len(ids), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["n_tokens", "docs"])

    return docs.select(text_col).mapInArrow(rows, "n_tokens long, docs long")


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per occurring length, with exact answers for a context limit of that many tokens.

    ``docs``, ``tokens``: of that length; ``docs_longer``, ``tokens_longer``: of greater lengths (suffix sums);
    ``kept_tokens``: the total if every text is truncated to the limit; ``quantile``: the share of texts that fit.
    A null or empty text has length 0.  An empty table gives an empty result.  Only the text column is read.
    """
    # Used twice below; stored, so that texts are encoded once.
    counts = written(token_lengths(docs, vocabulary, text_col).groupBy("n_tokens").agg(F.sum("docs").alias("docs")), TEXT_BYTES)
    counts = counts.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / block).alias("block"))
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    # One row per block of lengths: bounded by the longest text, not by the number of texts.
    all_rows = Window.partitionBy(F.lit(0))
    after = all_rows.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("b_docs", "b_tokens")], F.sum("b_docs").over(all_rows).alias("all_docs"), F.sum("b_tokens").over(all_rows).alias("all_tokens")
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"b_{c}_after")
    sums = counts.join(blocks, "block").select("n_tokens", "docs", "tokens", longer("docs").alias("docs_longer"), longer("tokens").alias("tokens_longer"), "all_docs", "all_tokens")
    return sums.select(
        "n_tokens",
        "docs",
        "tokens",
        "docs_longer",
        "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("kept_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )
