"""SimHash near-dedup: fingerprints of word shingles, linked with the help of tables of distances to pivots."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rows import taken_rows
from .scratch import TEXT_BYTES, drop, written
from .skew import SHARE, join_groups

SEED = 42
#: Reference fingerprints whose distances to every fingerprint form the tables.
N_PIVOTS = 16
#: Fingerprints with one key that are swept at once, free bits of a key whose runs are swept in any case (256 members at most), and
#: fingerprints whose keys are counted to find those that many share.
RUN, FREE_BITS, COUNTED = 4096, 8, 20_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)  # the bits of each octet
_COLUMN = np.arange(0, 2048, 256, dtype=np.int16)


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """n fixed 64-bit references: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text's shingles, repeats included; 0 if it has no word."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined, k = b" ".join(found), min(words, len(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[: len(found) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8) + _COLUMN
    ones = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, row, fp) for every row; row is a hash of the text, fp the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(fps.view(np.int64))], names=["id", "row", "fp"])

    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return given.mapInArrow(rows, f"id {given.schema['id'].dataType.simpleString()}, row long, fp long")


def pivot_table(fps: np.ndarray, n: int = N_PIVOTS) -> np.ndarray:
    """The Hamming distances of each fingerprint to the n pivots."""
    return np.bitwise_count(fps[:, None] ^ pivots(n)[None, :]).astype(np.int16)


def block_masks(max_bits: int, fixed: int = 0) -> list[int]:
    """Masks of which at least one covers equal bits in any two fingerprints with up to max_bits differing bits.

    The bits outside ``fixed``, in which the two are equal already, form 2 * max_bits blocks; each mask joins max_bits of them with
    the fixed ones.  Differing bits spoil max_bits blocks at most.
    """
    free = [b for b in range(64) if not fixed >> b & 1]
    n = max(1, 2 * max_bits)
    blocks = [sum(1 << b for b in free[len(free) * i // n : len(free) * (i + 1) // n]) for i in range(n)]
    return sorted({fixed + sum(c) for c in itertools.combinations(blocks, n - max_bits)})


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _narrower(max_bits: int):
    @F.pandas_udf("array<long>")
    def masks(fixed: pd.Series) -> pd.Series:
        known = {m: [_signed(x) for x in block_masks(max_bits, m & (1 << 64) - 1)] for m in fixed.unique().tolist()}
        return fixed.map(known)

    return masks


def _linked_within(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among distinct fingerprints: one fewer than members of a component.

    The fingerprints are swept in order of their distance to the first pivot, so that only a window of max_bits is
    looked at; members of one component are skipped; the other coordinates discard; survivors are verified.
    """
    order = np.argsort(table[:, 0], kind="stable")
    x, t = fps[order], table[order]
    stop = np.searchsorted(t[:, 0], t[:, 0] + max_bits, side="right")
    root = np.arange(len(x))
    a, b = [], []
    for i in range(len(x) - 1):
        js = np.arange(i + 1, stop[i])
        js = js[root[js] != root[i]]
        js = js[np.abs(t[js] - t[i]).max(axis=1, initial=0) <= max_bits]
        js = js[np.bitwise_count(x[js] ^ x[i]) <= max_bits]
        if len(js):
            r, first = np.unique(root[js], return_index=True)
            a += [x[i]] * len(r)
            b += x[js[first]].tolist()
            root[np.isin(root, r)] = root[i]
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def _sweep(max_bits: int, n_pivots: int, most: int):
    """Over rows (mask, key, fp) sorted so: links within each run of one key; a run of more than ``most`` is handed on.

    Gives rows (a, b, mask): a link with no mask, or a fingerprint of a run handed on with its mask.  Only the run at hand is held.
    """

    def handed_on(mask: int, fps: list[np.ndarray]) -> pa.RecordBatch:
        own = np.concatenate(fps)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(np.full(len(own), mask))], names=["a", "b", "mask"])

    def links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "mask"])

    def within(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.unique(fps).view(np.uint64)
        return _linked_within(own, pivot_table(own, n_pivots), max_bits)

    def divisible(mask: int) -> bool:
        return 64 - (mask & (1 << 64) - 1).bit_count() > FREE_BITS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            keys = np.stack([batch.column("mask").to_numpy(), batch.column("key").to_numpy()], axis=1)
            fps = batch.column("fp").to_numpy()
            edges = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
            found = []
            for lo, hi in itertools.pairwise(edges):
                if lo == hi:
                    continue
                if lo or tuple(keys[0].tolist()) != now:
                    if len(held) > 1 or size > 1 and held:
                        found.append(within(np.concatenate(held)))
                    now, held, size = tuple(keys[lo].tolist()), [], 0
                held.append(fps[lo:hi])
                size += hi - lo
                if size > most and divisible(now[0]):
                    yield handed_on(now[0], held)
                    held = []
            if found:
                yield links(found)
        if size > 1 and held:
            yield links([within(np.concatenate(held))])

    return rows


def _hot(todo: DataFrame, keyed, total: int, most: int) -> DataFrame:
    """(mask, key) that more than a thousandth of all fingerprints share, judged by a sample of them; they affect balance only."""
    share = min(1.0, COUNTED / max(1, total))
    sample = todo.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000))))
    return keyed(sample).groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(most, total / SHARE) * share).select("mask", "key")


def fingerprint_links(fps: DataFrame, max_bits: int = 3, n_pivots: int = N_PIVOTS, most: int = RUN) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that have the same components as all pairs within max_bits.

    Pivot distances alone would have to be held against all others, so candidates first meet by equal blocks of bits; then the
    pivot tables discard and the fingerprints decide.  Where more than ``most`` meet by one key, its remaining bits are cut into
    blocks in turn and they meet by equal blocks of these, until a run has a bounded size: with 8 bits left it has 256 at most.
    Keys that very many share go there at once and never meet in one task.  No pair is lost and no group's pairs are all emitted.
    """
    narrower = _narrower(max_bits)

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("fp", F.explode(narrower("mask")).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")

    links, todo = [], fps.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        total = todo.count()
        # At most 20 masks of 1000 keys each.
        hot = F.broadcast(written(_hot(todo, keyed, total, most)))
        free = 64 - F.bit_count("mask").cast("int")
        every = keyed(todo).join(hot.withColumn("hot", F.lit(True)), ["mask", "key"], "left").withColumn("hot", F.col("hot").isNotNull() & (free > FREE_BITS))
        dealt = every.where(~F.col("hot")).drop("hot").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        got = written(dealt.mapInArrow(_sweep(max_bits, n_pivots, most), "a long, b long, mask long"))
        links.append(got.where("mask is null").select("a", "b"))
        later = every.where("hot").select("fp", "mask").unionByName(got.where("mask is not null").select(F.col("a").alias("fp"), "mask"))
        later = written(later.distinct())
        if later.isEmpty():
            break
        todo = later
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, n_pivots: int = N_PIVOTS) -> DataFrame:
    """(id, row, fp, component_id), one row per row of docs.

    A-Z are lower-cased, words are runs without ASCII white space, shingles have ``words`` words (a shorter text is one
    shingle; a text without words, or null, has fingerprint 0 and is linked like any other).  Texts link when their
    fingerprints differ in max_bits bits or fewer; component_id is the smallest id reachable over links (null only
    where all ids are).  Equal fingerprints count once in the search, however many rows have them.  An empty table gives
    an empty result; other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, words), TEXT_BYTES)
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(fingerprint_links(distinct, max_bits, n_pivots), "a", "b")
    rooted = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    total = rows.count()
    known = written(join_groups(rooted, named, ["root"], "fps", ["fp"], total).select("fp", "n", "component_id"))
    drop(distinct, rooted, named)
    return join_groups(rows, known, ["fp"], "n", ["id", "row"], total).select("id", "row", "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """simhash_components() as (id_col, fingerprint, component_id), the fingerprint in 16 hexadecimal digits."""
    found = simhash_components(docs, id_col, text_col, **options)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the smallest id, then text hash."""
    found = simhash_components(docs, id_col, text_col, **options).where(F.col("id").eqNullSafe(F.col("component_id")))
    counted = found.groupBy("component_id", "id", "row").agg(F.count(F.lit(1)).alias("n"))
    stays = counted.groupBy("component_id", "id").agg(F.min(F.struct("row", "n")).alias("s"))
    decided = stays.groupBy("id", F.col("s.row").alias("row")).agg(F.max("s.n").alias("n"), F.lit(1).alias("copies"))
    return taken_rows(docs, {"id": F.col(id_col), "row": F.xxhash64(text_col)}, decided)
