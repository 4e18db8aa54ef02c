"""Exact dedup by composable polynomial fingerprints, verified by comparing texts chunk by chunk."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import taken_rows
from .scratch import TEXT_BYTES, drop, written
from .skew import join_groups

#: Moduli of the two fingerprints: primes under 2**61, so that each value is a long.
PRIMES = (1957294168273505681, 2108354871540229841)
#: Characters of a chunk; longer texts are hashed and compared in several chunks by several tasks.
CHUNK = 65_536
#: Members of a group of copies that are compared with one copy of the group's representative.
SALT_ROWS = 64

_KEY = ["n_bytes", "fp1", "fp2"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def chunks_of(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, in order, cut in one pass over the text; the empty text is one empty piece."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _hash_udf(primes: Sequence[int]):
    @F.pandas_udf("fp1 long, fp2 long")
    def chunk_hash(chunk: pd.Series) -> pd.DataFrame:
        # The bytes are the digits of a number in base 256: its residue is the polynomial's value.
        numbers = [int.from_bytes(x, "big") for x in chunk]
        return pd.DataFrame({"fp1": [n % primes[0] for n in numbers], "fp2": [n % primes[1] for n in numbers]}, dtype="int64")

    return chunk_hash


def combine(parts: Sequence[tuple[int, int]], prime: int) -> tuple[int, int]:
    """(hash, length) of a text from those of its consecutive parts: shift by the length that follows, then add."""
    value = length = 0
    for h, n in parts:
        value, length = (value * pow(256, n, prime) + h) % prime, length + n
    return value, length


def _combine_udf(primes: Sequence[int]):
    @F.pandas_udf("fp1 long, fp2 long")
    def combined(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for doc in parts:
            doc = sorted(doc, key=lambda p: p["i"])
            rows.append([combine([(p[k], p["n"]) for p in doc], prime)[0] for k, prime in zip(("fp1", "fp2"), primes, strict=True)])
        return pd.DataFrame(rows, columns=["fp1", "fp2"], dtype="int64")

    return combined


def fingerprints(docs: DataFrame, id_col: str, text_col: str, primes: Sequence[int] = PRIMES, chunk_chars: int = CHUNK) -> DataFrame:
    """One row per row of docs: id, row (a hash of id and text), n_bytes, fp1, fp2 and text_sha256 of the normalised text.

    Texts of up to ``chunk_chars`` bytes are hashed in place.  The chunks of longer ones are dealt out to all tasks
    and their hashes combined by length-shifted sums.
    """
    hashed = _hash_udf(primes)
    raw = _numbered_texts(docs, id_col, text_col)
    long = F.octet_length("raw") > chunk_chars
    out = ["id", "row", "n_bytes", "fp1", "fp2", "text_sha256"]

    def norm(rows: DataFrame) -> DataFrame:
        texts = rows.select("id", "row", normalised(F.col("raw")).alias("norm"))
        return texts.select("id", "row", "norm", F.octet_length("norm").cast("long").alias("n_bytes"), F.sha2("norm", 256).alias("text_sha256"))

    short = norm(raw.where(~long)).withColumn("h", hashed(F.col("norm").cast("binary"))).select("*", "h.*").select(out)
    whole = norm(raw.where(long)).withColumn("nr", F.monotonically_increasing_id())
    parts = (
        whole.select("nr", "id", "row", "n_bytes", "text_sha256", F.posexplode(chunks_of(F.col("norm"), chunk_chars)).alias("i", "chunk"))
        .repartition("nr", "i")
        .withColumn("h", hashed(F.col("chunk").cast("binary")))
        .select("nr", "id", "row", "n_bytes", "text_sha256", F.struct("i", F.octet_length("chunk").alias("n"), "h.fp1", "h.fp2").alias("part"))
    )
    # Of one text at most: as many parts as it has chunks.
    joined = parts.groupBy("nr", "id", "row", "n_bytes", "text_sha256").agg(F.collect_list("part").alias("parts"))
    return short.unionByName(joined.withColumn("h", _combine_udf(primes)(F.col("parts"))).select("*", "h.*").select(out))


def _numbered_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, row) of every row; row is a hash of id and text."""
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    return raw.withColumn("row", F.xxhash64("id", "raw"))


def _shared_texts(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """(id, key, text_sha256, norm): the texts of rows whose fingerprint others have too, fetched by their row hash."""
    wanted = written(join_groups(rows, shared, _KEY, "members", ["id", "row"], total).select(F.col("id").alias("w_id"), "row", *_KEY, "text_sha256", rows["n"]))
    texts = join_groups(_numbered_texts(docs, id_col, text_col).withColumn("nr", F.monotonically_increasing_id()), wanted, ["row"], "n", ["nr"], total)
    texts = texts.where(F.col("id").eqNullSafe(F.col("w_id"))).withColumn("norm", normalised(F.col("raw"))).where(F.sha2("norm", 256) == F.col("text_sha256"))
    # Repeated rows come from several salts; one of each salt is left.
    return texts.select("id", *_KEY, "text_sha256", "norm", "__salt").dropDuplicates(["id", *_KEY, "text_sha256", "__salt"]).drop("__salt")


def _mismatches(texts: DataFrame, chunk_chars: int, salt_rows: int) -> DataFrame:
    """Members whose text differs from that of the smallest member with the same fingerprint."""
    reps = written(texts.groupBy(_KEY).agg(F.min(F.struct("id", "text_sha256")).alias("rep"), F.count(F.lit(1)).alias("members")))
    with_rep = join_groups(texts, reps, _KEY, "members", ["id", "text_sha256"], texts.count()).withColumn("salts", F.ceil(F.col("members") / salt_rows).cast("int"))
    is_rep = F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("text_sha256") == F.col("rep.text_sha256"))
    pieces = chunks_of(F.col("norm"), chunk_chars)
    left = (
        with_rep.where(~is_rep)
        .withColumn("salt", F.pmod(F.xxhash64("id", "text_sha256"), F.col("salts")).cast("int"))
        .select(*_KEY, "id", "text_sha256", "salt", F.posexplode(pieces).alias("i", "chunk"))
    )
    right = (
        with_rep.where(is_rep)
        .select(*_KEY, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), pieces.alias("p"))
        .select(*_KEY, "salt", F.posexplode("p").alias("i", "rep_chunk"))
        .dropDuplicates([*_KEY, "salt", "i"])
    )
    pairs = left.join(right, [*_KEY, "salt", "i"], "left")
    return pairs.where(~F.col("chunk").eqNullSafe(F.col("rep_chunk"))).select(*_KEY, "id", "text_sha256").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: Sequence[int] = PRIMES, chunk_chars: int = CHUNK, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Groups of equal normalised texts: (id_col, keep_id, group_size, kept, text_sha256), one row per row of docs.

    The smallest id of a group stays.  Rows with equal fingerprints form one group only after their texts were
    compared with the group's representative, chunk by chunk; those that differ form groups of their own.
    Null texts are empty texts and equal to each other.  Of several rows with the same id and text, one is kept.
    A null id stays only where its group has no other; an empty table gives an empty result.  Other columns are not read.
    """
    one = fingerprints(docs, id_col, text_col, primes, chunk_chars)
    rows = written(one.groupBy("id", *_KEY, "text_sha256").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), TEXT_BYTES)
    shared = written(rows.groupBy(_KEY).agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    texts = written(_shared_texts(docs, id_col, text_col, rows, shared, total))
    branches, todo, branch = None, texts, 0
    while True:
        other = written(_mismatches(todo, chunk_chars, salt_rows))
        if other.isEmpty():
            break
        branch += 1
        found = other.withColumn("branch", F.lit(branch))
        branches = found if branches is None else branches.unionByName(found)
        same = [todo[k] == other[k] for k in [*_KEY, "text_sha256"]] + [todo["id"].eqNullSafe(other["id"])]
        rest = written(todo.join(other, same, "left_semi"))
        drop(todo)
        todo = rest
    drop(todo, shared)
    rows = rows.drop("row")
    if branches is None:
        rows = rows.withColumn("branch", F.lit(0))
    else:
        b = branches.groupBy(F.col("id").alias("b_id"), *[F.col(k).alias(f"b_{k}") for k in [*_KEY, "text_sha256"]]).agg(F.max("branch").alias("branch"))
        same = [rows[k] == b[f"b_{k}"] for k in [*_KEY, "text_sha256"]] + [rows["id"].eqNullSafe(b["b_id"])]
        rows = rows.join(b, same, "left").select(*[rows[c] for c in rows.columns], F.coalesce("branch", F.lit(0)).alias("branch"))
    groups = written(rows.groupBy(*_KEY, "branch").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("members")))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    return join_groups(rows, groups, [*_KEY, "branch"], "members", ["id", "text_sha256"], total).select("*", repeats).select(
        F.col("id").alias(id_col), "keep_id", "group_size", ((F.col("copy") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns."""
    found = exact_dedup(docs, id_col, text_col, **options)
    same_text = found.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kept").cast("long")).alias("copies"))
    return taken_rows(docs, {"id": F.col(id_col), "sha": F.sha2(normalised(F.col(text_col)), 256)}, same_text)
