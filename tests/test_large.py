"""What grows: long chains of overlapping spans, long lists of values, long names."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.jobs.classification import classify
from veilspan.operators import overlap as O
from veilspan.operators import values as X
from veilspan.sources.rules import Rules
from veilspan.streaming.classify import classify_batches, read_texts, replace_batch

SPAN = "array<struct<start:int,`end`:int,entity_type:string,score:double>>"


def fold(spans):
    kept = []
    for s in spans:
        if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
            kept.append(s)
    return kept


def best(spans):
    return sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0], s[2]))


def test_interval_set_agrees_with_the_fold():
    rng = random.Random(1)
    for _ in range(300):
        spans = [(a, a + rng.choice([0, 1, 1, 2, 5, 9])) for a in (rng.randrange(30) for _ in range(rng.randrange(25)))]
        assert [spans[k] for k in O.taken_places([s[0] for s in spans], [s[1] for s in spans])] == fold(spans)


def test_dense_and_sparse_rows_alike(spark):
    rng = random.Random(2)
    rows = [(i, [(a, a + rng.randrange(1, 9), rng.choice("AB"), rng.random()) for a in (rng.randrange(80) for _ in range(n))]) for i, n in enumerate([0, 1, 5, 60, 60, 40])] + [(9, None)]
    df = spark.createDataFrame(rows, f"id int, spans {SPAN}")
    for order, ranked in ((True, best), (False, lambda s: s)):
        a = O.with_disjoint(df, "spans", "kept", order, dense=10).orderBy("id").collect()
        b = O.with_disjoint(df, "spans", "kept", order).orderBy("id").collect()
        assert a == b
        for (_, spans), r in zip(rows[:-1], a, strict=False):
            assert [tuple(x) for x in r.kept] == sorted(fold(ranked(spans)), key=lambda s: s[:2])


def test_chain_of_a_hundred_thousand(spark):
    n, rng = 100_000, random.Random(3)
    spans = [(3 * i, 3 * i + 4, "A", rng.random()) for i in range(n)]
    df = spark.createDataFrame([(1, s, e, t, v) for s, e, t, v in spans], "doc_id int, start int, end int, entity_type string, score double")
    began = time.time()
    got = sorted(r.start for r in O.non_overlapping(df, best=True).collect())
    assert time.time() - began < 60
    order, taken = sorted(range(n), key=lambda i: -spans[i][3]), [None] * n
    for i in order:  # in a chain only neighbours overlap
        taken[i] = not ((i and taken[i - 1]) or (i + 1 < n and taken[i + 1]))
    assert got == [3 * i for i in range(n) if taken[i]]


def test_dense_redaction(spark):
    docs = spark.createDataFrame([(1, "abab" * 700), (2, "ab"), (3, None)], "doc_id long, text string")
    rules = Rules(()).with_recognizer("AB", [("ab", 0.9)]).with_recognizer("BA", [("ba", 0.95)])
    out = [sorted((r.doc_id, r.status, r.data, str(r.entityDetails)) for r in classify(docs, rules=rules, anonymize=True, dense=d).collect()) for d in (False, True)]
    assert out[0] == out[1] and out[0][0][2].startswith("a&lt;BA&gt;&lt;BA&gt;")


def naive(text, value):
    at, out, low = 0, [], value.lower()
    while (at := text.lower().find(low, at)) >= 0:
        out.append(at)
        at += len(low)
    return out


def test_occurrences_in_any_case():
    text = "Straße STRASSE ﬁ aAaA İi ẞß x.X*x"
    for form in ("straße", "aa", "x.x", "ß", "i", "zz", "", "X*X"):
        starts = X.occurrences(text, [form])[0]
        assert all(X.folded(text[s : s + len(form)]) == X.folded(form) for s in starts) and all(b - a >= len(form) for a, b in zip(starts, starts[1:], strict=False))
    assert X.occurrences(text, ["aa", "AA", "aaa"]) == [[19 - 2, 19], [17, 19], [17]]
    rng = random.Random(4)
    text = "".join(rng.choice("abAB ") for _ in range(400))
    forms = ["".join(rng.choice("abAB") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    assert X.occurrences(text, forms) == [naive(text, f) for f in forms]
    assert sorted(X.choices_in("ann lee, ann smith lee", "Ann Smith Lee", {"ann": True, "smith": True, "lee": True})) == ["Ann", "Ann Lee", "Ann Smith", "Ann Smith Lee", "Lee", "Smith", "Smith Lee"]


def test_thousands_of_values_in_a_long_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(20_000)]
    text = " ".join(rng.choice(words) for _ in range(110_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    values = spark.createDataFrame([(1, "company" if i % 2 else "name", w if i % 2 else f"{w} {words[i + 1]}") for i, w in enumerate(words[:5000])], "doc_id long, label string, value string")
    began = time.time()
    n = X.match_values(docs, values.replace("company", "company_name"), text_col="text").count()
    assert n > 10_000 and time.time() - began < 90


def test_long_names_listed_by_several_tasks(spark):
    names = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(15))), (2, "a b a"), (3, " "), (4, None), (5, "a b a")], "id int, name string")
    rows = X.listed_choices(names, "name")
    assert {r.id: r.n for r in rows.groupBy("id").agg(F.count_distinct("choice").alias("n")).collect()} == {1: 2**15 - 1, 2: 6, 5: 6}
    assert rows.count() == 2**15 - 1 + 12 and rows.select(F.spark_partition_id()).where("id = 1").distinct().count() > 1
    with pytest.raises(Exception, match="too many choices"):
        X.listed_choices(spark.createDataFrame([(1, "w " * 41)], "id int, name string"), "name").count()
    assert len(names.where("id = 2").select(X.name_subsequences(F.col("name")).alias("s")).first().s) == 6


def test_batch_run_twice(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, f"write to a{i}@b.org")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rules = Rules(()).with_recognizer("MAIL", [("[a-z0-9]+@[a-z.]+", 0.9)])
    texts = read_texts(spark, f"{tmp_path}/in", files_per_trigger=1)
    classify_batches(texts, f"{tmp_path}/out", f"{tmp_path}/state", once=True, rules=rules).awaitTermination()
    rows = lambda: sorted((r.batch, r.doc_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    first = rows()
    assert len(first) == 2 and {b for b, _ in first} == {0, 1}
    again = classify(spark.createDataFrame([(first[1][1], "write to c@d.org")], "doc_id long, text string"), rules=rules)
    replace_batch(again, f"{tmp_path}/out", 1)
    assert rows() == first


def test_places_of_values_leave_python_block_by_block():
    n = 2000
    batch = [pa.array(["alpha beta gamma " * 20] * n), pa.array([["alpha", "beta", "gamma"]] * n), pa.array([["ssn"] * 3] * n)]
    tracemalloc.start()
    found = X.arrow_places(*batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n and {len(row) for row in found} == {60}
    assert peak < 10_000_000  # all 120,000 places as objects take five times as much
