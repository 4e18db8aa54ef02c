"""Approximate nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, written

#: Vectors that the codebooks are fitted on, about; centroids of a half at most, and for each root of the number of entries.
FIT_ROWS, MAX_CENTROIDS, CENTROIDS_PER_ROOT = 20_000, 256, 4
#: Share of all entries whose cells a query visits.
PROBE = 0.5
#: Entries that a query visits at least, for each neighbour asked for.
SEEN_PER_NEIGHBOUR = 20
#: Index entries that one task holds, queries that stream past them there, and queries whose distances are computed at a time.
BLOCK, QUERIES, CHUNK = 65_536, 262_144, 64


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means; a centroid without members stays where it is."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: int) -> list[tuple[int, int]]:
    """Pairs of centroids by ascending d1 + d2, until their cells hold ``want`` entries.

    A pair enters the heap when both pairs before it, along either half's order, have left it.
    """
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2, n = d1[o1].tolist(), d2[o2].tolist(), counts[np.ix_(o1, o2)].tolist()
    out, got = [], 0
    heap, done = [(s1[0] + s2[0], 0, 0)], [0] * (len(o1) + 1)  # done[i]: pairs of row i that have left
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        if n[i][j]:
            out.append((o1[i], o2[j]))
            got += n[i][j]
        if i + 1 < len(o1) and done[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < len(o2) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class _Rerank:
    """The index entries of one block; ``nearest`` gives each query's nearest among those whose cells it visits."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, c1: np.ndarray, c2: np.ndarray):
        table = pa.Table.from_batches(batches)
        self.codebooks, self.half = (c1, c2), max(1, dim // 2)
        self.x = np.concatenate([_matrix(b.column("v"), dim) for b in batches])
        self.cells = [table.column(c).to_numpy() for c in ("c1", "c2")]
        self.ids = table.column("ids").combine_chunks()
        self.norms = (self.x**2).sum(1)

    def nearest(self, own: list, q: np.ndarray, reach: np.ndarray, k: int) -> Iterator[tuple]:
        """(query, id, distance), k for each query at most: candidates by matrix product, distances of these from differences."""
        for lo in range(0, len(q), CHUNK):
            part = q[lo : lo + CHUNK]
            halves = (part[:, : self.half], part[:, self.half :])
            d1, d2 = (squared(h, c)[:, at] for h, c, at in zip(halves, self.codebooks, self.cells, strict=True))
            rough = self.norms - 2 * part @ self.x.T
            rough[d1 + d2 > reach[lo : lo + CHUNK, None] * (1 + 1e-9)] = np.inf
            slack = 1e-9 * (self.norms.max() + (part**2).sum(1))
            for i, row in enumerate(rough):
                most = np.partition(row, k)[k] + slack[i] if len(row) > k + 1 else np.inf
                near = np.flatnonzero((row <= most) & (row < np.inf))
                d = np.sqrt(((self.x[near] - part[i]) ** 2).sum(1))
                mine = own[lo + i]
                found = sorted((s, other) for at, s in zip(near.tolist(), d.tolist(), strict=True) for other in self.ids[at].as_py() if other != mine)
                yield from ((mine, other, s) for s, other in found[:k])


def nearest_neighbours(vectors: DataFrame, k: int = 10, query_every: int = 100, probe: float = PROBE, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by query_every, the k nearest found.

    Codebooks of both halves are fitted on about fit_rows vectors, chosen by hash; every vector is indexed in the cell of its two
    nearest centroids.  A query visits cells by summed centroid distance until they hold a ``probe`` share of all entries, and 20 k
    of them at least, and ranks their entries by Euclidean distance in double precision, ties by id.  Vectors that are null, zero,
    hold null or non-finite components, or have another length than most, and rows with a null id, take no part.  Equal vectors are
    one entry with its k + 1 smallest ids: no query can need more.  Repeated rows of one id and vector count once; a query's own id
    is never its neighbour.  Entries are dealt to blocks of neighbouring cells, a large cell to several; a task holds one block
    while the queries that visit it stream past, so entries move once for each QUERIES queries and queries once for each
    block they visit.  An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    given = written(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct())
    kind = given.schema["id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    lengths = given.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return empty
    dim, half = lengths["dim"], max(1, lengths["dim"] // 2)
    given = given.where(F.size("v") == dim)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = given.select("id", "v", place.alias("place")).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = written(entries)
    total = entries.count()
    share = int(np.ceil(1e6 * min(1.0, fit_rows / total)))
    sample = entries.select("v").where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < share).collect() or entries.select("v").limit(1).collect()
    fit = np.array(sorted(r["v"] for r in sample), dtype=np.float64)
    n_centroids = int(min(MAX_CENTROIDS, len(fit), max(4, CENTROIDS_PER_ROOT * total**0.5)))
    c1, c2 = fit_centroids(fit[:, :half], n_centroids), fit_centroids(fit[:, half:], n_centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            cells = [pa.array(nearest(h, c), pa.int32()) for h, c in ((x[:, :half], c1), (x[:, half:], c2))]
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), *cells], names=["v", "ids", "c1", "c2"])

    index = written(entries.select("v", "ids").mapInArrow(assign, f"v array<double>, ids array<{kind}>, c1 int, c2 int"))
    drop(entries)
    counts = np.zeros((len(c1), len(c2)), dtype=np.int64)
    for r in index.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell: MAX_CENTROIDS squared at most
        counts[r["c1"], r["c2"]] = r["n"]
    # Smaller blocks on a smaller table, so that all cores take part; no result depends on it.
    block = min(block, max(1024, -(-total // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    ends = np.cumsum(counts.ravel()).reshape(counts.shape)
    first, last = (ends - counts) // block, np.maximum(ends - 1, 0) // block
    want = int(min(total, max(np.ceil(probe * total), SEEN_PER_NEIGHBOUR * k)))
    asked = given.where(F.col("id") % query_every == 0)
    groups = max(1, -(-asked.count() // QUERIES))
    # Few bytes, much work: a stated number of tasks keeps Spark from joining partitions by their size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("int")
    def block_of(a: pd.Series, b: pd.Series, h: pd.Series) -> pd.Series:
        lo, hi = first[a, b], last[a, b]
        return pd.Series(lo + h.to_numpy() % (hi - lo + 1), dtype="int32")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            at, reaches, blocks = [], [], []
            for i, (d1, d2) in enumerate(zip(squared(x[:, :half], c1), squared(x[:, half:], c2), strict=True)):
                cells = np.array(traverse(d1, d2, counts, want)).reshape(-1, 2)
                a, b = cells[:, 0], cells[:, 1]
                span = np.zeros(int(last.max()) + 2, dtype=np.int64)
                np.add.at(span, first[a, b], 1)
                np.add.at(span, last[a, b] + 1, -1)
                visits = np.flatnonzero(np.cumsum(span))
                at += [i] * len(visits)
                reaches += [float((d1[a] + d2[b]).max(initial=0.0))] * len(visits)
                blocks += visits.tolist()
            taken = batch.select(["id", "v", "part"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(reaches, pa.float64()), pa.array(blocks, pa.int32())], names=["id", "v", "part", "reach", "block"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, entries_of = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "asks")], axis=1)
            edges = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in itertools.pairwise(edges):
                if lo == hi:
                    continue
                *here, asks = keys[lo].tolist()
                if here != now:
                    now, held, entries_of = here, [], None
                rows = batch.slice(lo, hi - lo)
                if not asks:
                    held.append(rows)
                elif held:
                    entries_of = entries_of or _Rerank(held, dim, c1, c2)
                    found = list(entries_of.nearest(rows.column("id").to_pylist(), _matrix(rows.column("v"), dim), rows.column("reach").to_numpy(), k))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (rows.schema.field("id").type, rows.schema.field("id").type, pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).repartition(tasks, "id")
    asked = asked.mapInArrow(plan, f"id {kind}, v array<double>, part int, reach double, block int").withColumn("asks", F.lit(1))
    dealt = index.withColumn("block", block_of("c1", "c2", F.pmod(F.xxhash64("v"), F.lit(1 << 30)))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asks", F.lit(0))
    meet = dealt.unionByName(asked, allowMissingColumns=True).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "asks")
    found = meet.mapInArrow(rerank, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
