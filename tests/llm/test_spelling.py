import random
import re
import zlib
from collections import Counter

import pytest

from veilspan.llm import spelling as S


def words_of(rows, slips=97):
    n = Counter()
    for r in rows:
        doc_id, text = r[0], r[1]
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    out, form = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, docs, size):
    """Words over few letters, so that there are many neighbours; some much more frequent than others."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abàÿ") for _ in range(rng.choice([4, 5, 5, 6, 6, 7, 8, 11]))) for _ in range(160)]
    weights = [1 / (1 + i % 40) for i in range(len(pool))]
    return [(d, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(pool, weights, k=size))) for d in range(docs)]


@pytest.mark.parametrize("held", [S.HELD, 3])
def test_against_brute_force(spark, held):
    rows = texts(7, 40, 120)
    n = words_of(rows)
    assert len(n) > 100
    assert result(S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), held=held)) == brute(n)


def test_slips_make_variants(spark):
    rows = [(d, "remember straße Überfluß naïve × ÷ naïve! " * 9) for d in range(120)]
    out = result(S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), slips=11))
    assert out == brute(words_of(rows, 11)) and any(r[1] == "remember" for r in out)


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(300)})
    a = S.Automaton(words)
    assert [a.number(a.start, 0, w) for w in words] == list(range(len(words)))
    assert a.number(a.start, 0, "abcabcabc") is None and a.sizes[a.start] == len(words)
    # States of a minimal automaton differ by what can follow.
    futures = set()

    def future(s):
        return frozenset([""] if a.final[s] else []) | {c + f for c, (t, _) in a.edges[s].items() for f in future(t)}

    for s in range(len(a.final)):
        futures.add(future(s))
    assert len(futures) == len(a.final)
    for w in words[::7]:
        for kinds in ((True, True, True), (True, False, False), (False, True, False), (False, False, True)):
            want = [v for v in words if near(w, v) and kinds[0 if len(v) == len(w) else 1 if len(v) > len(w) else 2]]
            assert sorted(words[k] for k in a.one_error(w, *kinds)) == want


def test_chain_of_forms(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    text = " ".join(" ".join([w] * (3 * 2**i)) for i, w in enumerate(chain))
    out = {r.word: r for r in S.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), slips=None).collect()}
    assert {r.root for r in out.values()} == {"bbbbb"} and out["aaaaa"].form == "aaaab" and out["bbbbb"].form is None


def test_ties_nulls_and_nothing(spark, odd, odd_rows, none):
    assert result(S.spelling_variants(odd)) == brute(words_of(odd_rows))
    out = S.spelling_variants(none)
    assert out.count() == 0 and out.schema == S.spelling_variants(odd).schema
    tie = [(1, "words words words wordy wordy wordy wordx " + "worda " * 9 + "wordb " * 9)]
    got = {r.word: r.form for r in S.spelling_variants(spark.createDataFrame(tie, "doc_id long, text string"), slips=None).collect()}
    assert got == {"words": "worda", "wordy": "worda", "worda": None, "wordb": None}
