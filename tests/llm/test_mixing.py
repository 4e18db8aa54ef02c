import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import mixing as m


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / share for s in names}
        over = {s for s in names if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        capped |= over


def test_targets(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 23):
        sizes = {f"s{i}é": int(rng.choice([0, 5, 40, 1000, 90000])) for i in range(n)} | {None: 12}
        rows = spark.createDataFrame([(s, x, 1) for s, x in sizes.items()], "source string, size long, n long")
        got = {r["source"]: r["target"] for r in m.source_targets(rows).collect()}
        assert got == pytest.approx(brute_targets(sizes))
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(7)
    size = rng.integers(1, 50, 40).astype(float)
    frac = rng.random(40)
    mean = np.zeros(40)
    for _ in range(3000):
        got, carry = m.pivotal(size, frac.copy(), rng)
        assert got @ size == pytest.approx(frac @ size)
        assert sum((got > 0) & (got < 1)) == (carry >= 0)
        mean += got / 3000
    assert np.abs(mean - frac).max() < 0.05


def test_mix_over_a_tree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    target = brute_targets(sizes)
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.col("source")))
    for given, options in ((docs, {}), (hot, {"leaf_rows": 7, "fan_in": 3})):
        got = m.mix_report(given, **options).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows)
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
        again = m.mix_report(given.repartition(3), **options).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))
        by = {}
        for r in got:
            t = by.setdefault(r["source"], [r["target"], 0, 0])
            t[1] += r["taken"]
            t[2] = max(t[2], r["size"])
        assert all(abs(taken - t) <= most for t, taken, most in by.values())
        if not options:
            assert {r["doc_id"]: r["target"] for r in got} == pytest.approx({r["doc_id"]: target[r["source"]] for r in rows})


def test_odd_rows(odd, odd_rows):
    got = m.mix_report(odd).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in odd_rows)
    assert sorted(r["size"] for r in got) == sorted(words(r[1]) for r in odd_rows)
    mixed = m.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert sum(words(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_empty_table(none):
    assert m.mix_report(none).collect() == []
    assert m.mixed_documents(none).collect() == []
