import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspan.llm import packing, token_counts
from veilspan.llm.tokens import WordTokenizer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_tokenizers_ids(spark, sf, tokenizer):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    texts += ["a<|endoftext|>b", "İstanbul ΣΑΣ don't 've\x1cx", "l'été 12.5% naïve ½ Ⅷ 日本語 ﬁ 🙂👍🏽 x\x00y ŉ ẞ", "﻿x ​q", "it's'll we've'S", "", "  "]
    small = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), words=50, pieces=20, longest=8)
    for t in texts:
        assert np.frombuffer(small.encode(t), "<u4").tolist() == ids(tokenizer, t)


def check_packing(rows, texts, tokenizer, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = Counter()
    for doc_id, text in texts:
        whole = np.array([*ids(tokenizer, text), 0], dtype="<u4")
        for k, s in enumerate(range(0, len(whole), capacity)):
            part = whole[s : s + capacity]
            want[doc_id, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_round_trip_odd_rows(odd, odd_rows, tokenizer):
    check_packing(packing.pack_documents(odd, capacity=64).collect(), [r[:2] for r in odd_rows], tokenizer, 64)


def test_few_sequences_over_several_levels(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, shard_rows=20).collect()
    n, total = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 2048)
    assert n <= -(-total // 2048) * 1.03 + 1


def test_least_squares_rule():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 40, 60)
        bins = packing.pack_lengths(lengths, 40)
        assert np.bincount(bins, weights=lengths).max() <= 40
        fills, order = {}, np.argsort(-lengths, kind="stable")
        for i in order:
            s, b = lengths[i], bins[i]
            squares = lambda f: sum(c * c for g, c in Counter(40 - x for x in f.values()).items() if g)
            fitting = [k for k, x in fills.items() if x + s <= 40 and x < 40]
            tried = {k: squares({**fills, k: fills[k] + s}) for k in fitting}
            if tried:
                assert tried[b] == min(tried.values())
            else:
                assert b not in fills
            fills[b] = fills.get(b, 0) + s


def test_empty_tables(none):
    assert packing.pack_documents(none).collect() == []
    assert token_counts.length_histogram(none).collect() == []


def test_histogram(odd, odd_rows, tokenizer):
    lengths = [len(ids(tokenizer, r[1])) for r in odd_rows]
    got = token_counts.length_histogram(odd, block=4).orderBy("n_tokens").collect()
    assert [r["n_tokens"] for r in got] == sorted(set(lengths))
    for r in got:
        n = r["n_tokens"]
        assert (r["docs"], r["tokens"]) == (lengths.count(n), n * lengths.count(n))
        assert (r["docs_longer"], r["tokens_longer"]) == (sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert r["kept_tokens"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))


def test_pieces_of_repeated_rows(spark):
    docs = spark.range(3).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one two").alias("text"))
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == 3 and sorted(r["offset"] for r in rows) == [0, 3, 6]


def test_pieces_that_never_fill_a_sequence(spark, monkeypatch):
    """All of one length that leaves a gap, among a few short ones: no group grows with the corpus, and the bound is reached."""
    lengths = [1500] * 2000 + [300] * 200 + [248] * 100
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long")
    groups, inner = [], packing._pack_group
    monkeypatch.setattr(packing, "_pack_group", lambda capacity, carry: groups.append(carry) or inner(capacity, carry))
    got = packing.pack(rows, 2048, shard_rows=128, fan_in=4).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert sorted(r["id"] for r in got) == list(range(len(lengths))) and max(fill.values()) <= 2048
    assert len(fill) == 2000  # every long piece needs a sequence of its own, and the short ones fit beside them
    assert set(groups) == {32, 0}  # a shard passes on a quarter of a shard, so four of them form one of the same size
