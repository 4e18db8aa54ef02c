import random

import xxhash

from veilspan.llm import simhash as s
from veilspan.llm.components import connected_components

from .conftest import sentence


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    k = min(3, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(fps, bits=3):
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fs}


def test_fingerprints():
    for t in [None, "", " \t", "One", "one TWO", "a b c", "É a b É a b", sentence(1, 500)]:
        assert s.fingerprint(t) == brute_fingerprint(t)


def test_masks_meet_every_close_pair():
    masks = s.block_masks(3)
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_links_keep_all_components(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for c in [rng.getrandbits(64) for _ in range(6)]:
        x = c
        for _ in range(60):
            if rng.random() < 0.3:
                x = c
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << bit
            fps.add(x)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = s.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3 for r in links.collect())
    roots = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    want = components(fps)
    classes = lambda label: {frozenset(f for f in fps if label(f) == c) for c in {label(f) for f in fps}}
    assert classes(lambda f: roots.get(signed(f), signed(f))) == classes(lambda f: want[f])


def test_a_key_that_very_many_share(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    low = (1 << 40) - 1
    fps = {base}
    while len(fps) < 3000:  # 24 bits in common, so whole runs share blocks; chains of near ones among them
        x = base & ~low | rng.getrandbits(40)
        for _ in range(3):
            fps.add(x)
            x ^= 1 << rng.randrange(40)
    fps |= {base ^ 1 << b for b in range(64)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = components(fps)
    for most in (4096, 40):
        links = s.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), most=most)
        roots = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
        classes = lambda label: {frozenset(g) for g in _grouped(fps, label)}
        assert classes(lambda f: roots.get(signed(f), signed(f))) == classes(lambda f: want[f])


def _grouped(fps, label):
    out = {}
    for f in fps:
        out.setdefault(label(f), []).append(f)
    return out.values()


def test_masks_of_the_bits_that_are_left():
    rng = random.Random(5)
    for _ in range(50):
        fixed = rng.choice(s.block_masks(3))
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample([i for i in range(64) if not fixed >> i & 1], 3):
            b ^= 1 << bit
        masks = s.block_masks(3, fixed)
        assert all(m & fixed == fixed and m != fixed for m in masks)
        assert any(a & m == b & m for m in masks)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_odd_rows(odd, odd_rows):
    got = s.simhash_groups(odd).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(r[0]), f"{brute_fingerprint(r[1]):016x}") for r in odd_rows)
    want = components({brute_fingerprint(r[1]) for r in odd_rows})
    least = {}
    for r in odd_rows:
        c = want[brute_fingerprint(r[1])]
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == sorted(map(str, ((r[0], least[want[brute_fingerprint(r[1])]]) for r in odd_rows)))
    stays = s.deduplicated(odd)
    assert stays.columns == odd.columns and stays.count() == len(set(want.values()))


def test_empty_table(none):
    assert s.simhash_groups(none).collect() == []
    assert s.deduplicated(none).collect() == []
