import hashlib
import re
import time

from pyspark.sql import functions as F

from veilspan.llm import exact_dedup as x


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return out


def plain(df):
    return [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()]


order = lambda rows: sorted(rows, key=str)


def test_parts_combine():
    data = "héllo wörld, a text in parts".encode()
    for p in x.PRIMES:
        parts = [data[:3], b"", data[3:11], data[11:]]
        assert x.combine([(int.from_bytes(c, "big") % p, len(c)) for c in parts], p) == (int.from_bytes(data, "big") % p, len(data))


def test_odd_rows(odd, odd_rows):
    got = x.exact_dedup(odd).collect()
    assert order([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]) == order(brute([r[:2] for r in odd_rows]))
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})


def test_long_texts_in_chunks(odd, odd_rows):
    assert order(plain(x.exact_dedup(odd, chunk_chars=1000, salt_rows=1))) == order(brute([r[:2] for r in odd_rows]))


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(i, f"t{i % 9}") for i in range(60)]
    got = x.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), primes=(3, 2), chunk_chars=1)
    assert order(plain(got)) == order(brute(rows))


def test_empty_table(none):
    assert x.exact_dedup(none).collect() == []
    assert x.deduplicated(none).collect() == []


def test_rows_that_stay(odd, odd_rows):
    got = x.deduplicated(odd)
    assert got.columns == odd.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in got.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in odd_rows})


def test_chunks_of_any_characters(spark):
    texts = ["", "a", "ab\ncd", "\U0001f600é" * 5, "x" * 12, "\r\n\u2028\x85" * 4]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(x.chunks_of(F.col("t"), 4).alias("c")).collect()
    assert [r.c for r in got] == [[t[i : i + 4] for i in range(0, max(len(t), 1), 4)] for t in texts]


def test_huge_texts(spark):
    text = " ".join(f"word{i}" for i in range(1_500_000))  # 16 MB
    rows = [(1, text), (2, text), (3, text + "!"), (4, "!" + text)]
    began = time.time()
    out = {r.doc_id: r.keep_id for r in x.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4} and time.time() - began < 120
