import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from veilspan.llm import neighbours as nn


def brute(ids, x, k, every):
    ids, x = np.array(ids), np.asarray(x)
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d))[: k + 1] if ids[j] != q][:k]
        out[q] = [(float(d[j]), int(ids[j])) for j in order]
    return out


def check_recall(spark, ids, x, every, **options):
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = {}
    for r in nn.nearest_neighbours(df, query_every=every, **options).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute(ids, x, 10, every)
    assert got.keys() == want.keys()
    hits = [len({v for _, v in got[q].values()} & {v for _, v in want[q]}) / 10 for q in want]
    for q, found in got.items():
        assert [found[r] for r in sorted(found)] == sorted(found.values()) and sorted(found) == list(range(1, 11))
        for s, v in found.values():
            assert np.isclose(s, np.sqrt(((x[ids.index(v)] - x[ids.index(q)]) ** 2).sum()), rtol=1e-12)
    return np.mean(hits), min(hits)


def test_recall_on_the_table(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.stack(t["embedding"].to_numpy()).astype(float)
    mean, least = check_recall(spark, t["vec_id"].to_pylist(), x, 50, block=300)
    assert mean >= 0.95 and least >= 0.7


def test_recall_on_a_large_table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50_000, 32)).round(4)
    mean, least = check_recall(spark, list(range(50_000)), x, 1000)
    assert mean >= 0.9 and least >= 0.6


def test_traversal_order():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(7), rng.random(9)
    counts = rng.integers(0, 3, (7, 9))
    cells = nn.traverse(d1, d2, counts, 10**9)
    assert sorted(cells) == sorted(zip(*map(list, np.nonzero(counts)), strict=True))
    sums = [d1[a] + d2[b] for a, b in cells]
    assert sums == sorted(sums)


def test_ties_repeats_and_unusable_vectors(spark):
    bad = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], []]
    rows = [(i, [1.0, float(i % 4), 2.0]) for i in range(40)] + [(100 + i, v) for i, v in enumerate(bad)] + [(0, [1.0, 0.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in nn.nearest_neighbours(df, query_every=10, block=8).orderBy("query_id", "rank").collect()]
    ids, x = [i for i, _ in rows[:40]], np.array([v for _, v in rows[:40]])
    want = [(q, r + 1, v, s) for q, found in brute(ids, x, 10, 10).items() for r, (s, v) in enumerate(found)]
    assert got == want


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn.nearest_neighbours(df).collect() == []
    assert nn.nearest_neighbours(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30_000, 8)).round(3)
    x[::3] = x[0]
    mean, least = check_recall(spark, list(range(30_000)), x, 1500)
    assert mean >= 0.9 and least >= 0.6
