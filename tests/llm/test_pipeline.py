import re
import zlib
from collections import Counter

import corpus_pipeline as c
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veilspan.llm import mixing

from .test_simhash import brute_fingerprint, components


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, stage in c.STAGES:
        tables.append(stage(spark, tables[-1], sf).cache())
        if name != "packing":
            assert tables[-1].columns == docs.columns
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    key = lambda r: r["doc_id"]
    assert sorted(rows[1], key=key) == sorted((r for r in rows[0] if re.search(r"[^\W\d_]", r["text"] or "")), key=key)
    first = {}
    for r in sorted(rows[1], key=key):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
    assert sorted(rows[2], key=key) == sorted(first.values(), key=key)
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows[2]}
    root, least = components(set(fps.values())), {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    assert sorted(map(key, rows[3])) == sorted(least.values())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(tables[3]).collect()}
    assert Counter(map(key, rows[4])) == Counter({i: n for i, n in copies.items() if n})
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in rows[4]:
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((r["doc_id"], k, zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows[5]) == want
    assert c.run(spark, sf).count() == len(rows[5])


def test_stages_take_odd_rows(spark, odd, odd_rows, none):
    for name, stage in c.STAGES:
        got = stage(spark, odd, "")
        if name != "packing":
            assert got.columns == odd.columns
        got.collect()
        assert stage(spark, none, "").collect() == []
