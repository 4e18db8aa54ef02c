import hashlib
import random
import re
import zlib

import pytest

from veilspan.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, owner string, depth int, last string"


def brute(rows, shared=True):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    # Rows with equal numbers go by the digest of role and text.
    digest = lambda t: hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()[: P.DIGEST]
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0], digest(t)))] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + ts[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault((d, tuple(ts[:d])), []).append(c)
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[1][-1][1])) if n[0] else 0
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[0] >= node[0] and m[1][: node[0]] == node[1]]
        children = [m for m in below if m[0] == node[0] + 1]
        childless = [m for m in below if not any(x[0] == m[0] + 1 and x[1][: m[0]] == m[1] for x in below)]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == node[0]))
        parent = min(members[(node[0] - 1, node[1][:-1])]) if node[0] else None
        out.append((min(cs), node[0], parent, len(cs), len(children), len(childless), sum((len(members[m]) - 1) * words(m) for m in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, convs):
    rng, rows = random.Random(seed), []
    for c in convs:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "a b c", "", None]), "x", 1, "y"))
    return rows


@pytest.mark.parametrize("shared", [True, False])
def test_against_brute_force(spark, shared):
    rows = random_rows(5, [*range(45), -3, -41, 5_000_000_020, 5_000_000_021])
    rows += [(3, None, "user", "null turns come first", "x", 1, "y"), (3, 0, "user", "tied", "x", 1, "y"), rows[0], (None, 1, "user", "nobody's", "x", 1, "y"), (200, 4, None, None, None, None, None)]
    assert result(P.prefix_trie(spark.createDataFrame(rows, SCHEMA), shared_starts=shared)) == brute(rows, shared)


def test_conversation_left_without_turns(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(c, 0, "user", "only", "x", 1, "y")]
    nothing, own = hashlib.sha256(b"").hexdigest(), hashlib.sha256(str(c).encode()).hexdigest()
    assert nothing != own
    assert result(P.prefix_trie(spark.createDataFrame(rows, SCHEMA), shared_starts=True)) == [(c, 0, None, 1, 0, 1, 0, own)] == brute(rows)


def test_hot_conversation_and_long_chain(spark):
    copies = [(c, t, "user", f"turn {t}", "x", 1, "y") for c in range(3000) for t in range(2)]
    chain = [(9000, t, "user", f"turn {t}", "x", 1, "y") for t in range(4000)]
    out = {(r.conv_id, r.depth): r for r in P.prefix_trie(spark.createDataFrame(copies + chain, SCHEMA)).collect()}
    assert len(out) == 4001
    ends = hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert (out[0, 2].n_convs, out[0, 2].ends_sha256, out[0, 2].n_children, out[0, 2].n_leaves, out[0, 2].saved_tokens) == (3001, ends, 1, 1, 6000)
    assert out[0, 0].saved_tokens == 12000 and out[0, 0].n_leaves == 1 and out[9000, 3].parent_conv_id == 0 and out[9000, 4000].n_children == 0


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.prefix_trie(none, shared_starts=True).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "x", 1, "y")], SCHEMA)).count() == 0


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000, "x", 1, "y"), (2, 0, "user", "word " * 400_000, "x", 1, "y")]
    assert {r.saved_tokens for r in P.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()} == {400_000}
