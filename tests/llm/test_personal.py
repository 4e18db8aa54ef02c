import hashlib
import random
import re

from pyspark.sql import functions as F

from veilspan.llm import personal as p
from veilspan.llm.skew import join_groups

DEFINED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(DEFINED.items()):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def listed(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


TEXTS = [
    None,
    "",
    "a@b.c a@b a@b.c_d@e.f x@@y.z %@1.2..3 .@-.- a@b.c.d@e.f",
    "é🙂 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 000000255.0.0.01 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 5500000000000004-1 0000000000000 1" + "1" * 30,
    "+1 (743) 555-3824 ++1 23456789 +1-2 +123456789012345 +1234567890123456 +1 (743) 555-3824 4111111111111111",
    "+1 1.2.3.4 a.1@1.2.3.4",
    "1" * 30000 + " " + "a" * 30000 + "@b.c " + "1 " * 20000 + "1." * 20000,
    "".join(f"u{i}@mail.example 10.0.0.{i % 300}, " for i in range(700)),
]


def test_base_spans(spark, odd_rows):
    texts = TEXTS + [r[1] for r in odd_rows]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, row int")
    got = {r["doc_id"]: r for r in p.report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert [got[i][f"n_{k}"] for k in p.KINDS] == [sum(x[3] == k for x in want) for k in p.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(filter(None, listed(want).split(","))) <= set(got[i]["spans"].split(","))


def test_table(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in p.report(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(listed(brute(r["text"])).encode()).hexdigest()
    found = sum(r["n_found"] for r in got.values())
    assert found < 0.2 * sum(r["n_phone"] + r["n_email"] + r["n_ip"] + r["n_card"] for r in got.values())


def test_precision_and_recall_of_added_spans(spark):
    """10,000 documents: of those with an identifier an eighth hold one that no pattern fits, next to words that others share; the rest hold other numbers."""
    rng = random.Random(4)
    phone = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04d}"
    seed, odd = lambda: "+1 " + phone(), lambda: rng.choice([phone(), phone().replace("(", "").replace(") ", "."), phone().replace(") ", ")")])
    mail = lambda: f"u{rng.randrange(10**6)}@mail{rng.randrange(50)}.example"
    hidden = lambda: mail().replace("@", " [at] ").replace(".", " [dot] ")
    filler = lambda: " ".join(rng.choice("river stone cloud amber mesa lilac orbit pixel quartz raven".split()) for _ in range(rng.randrange(3, 9)))
    shapes = [("please call me: {} or not", seed, odd), ("{} write to mail: {}", mail, hidden), ("{} is my line {}", seed, odd), ("reach us via {} soon", mail, hidden)]
    rows, planted = [], set()
    for i in range(10_000):
        k = rng.randrange(14)
        if k < 8:
            shape, usual, other = rng.choice(shapes)
            is_odd = k == 0
            value = (other if is_odd else usual)()
            before, _, after = shape.rpartition("{}") if shape.count("{}") == 2 and "write" in shape else shape.partition("{}")
            before, after = before.replace("{}", filler()), after.replace("{}", filler())
            start = f"{filler()} {before}"
            rows.append((i, f"{start}{value}{after} {filler()}"))
            if is_odd:
                planted.add((i, len(start), len(start) + len(value)))
        else:
            rows.append((i, f"{filler()} {rng.choice(['order number', 'build', 'in total', 'lot size'])} {odd()} {rng.choice(['shipped', 'units', 'of all'])} {filler()}"))
    found = {(r["doc_id"], s["start"], s["end"]) for r in p.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r["found"]}
    assert len(planted) > 600 and len(found & planted) >= 0.95 * len(planted) and len(found & planted) >= 0.98 * len(found)


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"please call me: +1 (555) 010-{i:04d} soon") for i in range(20)] + [(100 + i, f"write to mail: user{i}@mail.example or so") for i in range(20)]
    rows += [(200, "please call me: (743) 555-3824 today"), (201, "write to mail: jane [at] corp [dot] org now"), (202, "order number 743 555 3824 shipped"), (203, "é call me: 743.555.3825")]
    rows += [(200, "please call me: (743) 555-3824 today")]
    rows += [(300 + i, f"{'abcdefghijkl'[i]}{i} +1 (555) 020-{i:04d} is my line") for i in range(12)] + [(400, "zz (743) 555-3999 is my line")]
    got = {r["doc_id"]: r["found"] for r in p.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: [(s["kind"], s["value"], s["start"]) for s in f] for i, f in got.items() if f} == {
        200: [(3, "(743) 555-3824", 16)],
        201: [(0, "jane [at] corp [dot] org", 15)],
        203: [(3, "743.555.3825", 11)],
        400: [(3, "(743) 555-3999", 3)],
    }


def test_empty_table(none):
    assert p.report(none).collect() == []


def test_discovered_identifiers_make_contexts_credible(spark):
    rows = [("a", f"seed{i}", 0) for i in range(1200)] + [("a", f"x{i}", None) for i in range(120)]
    rows += [("b", f"mine{i}", 0) for i in range(60)] + [("b", f"x{i}", None) for i in range(120)] + [("b", f"y{i}", None) for i in range(20)]
    rows += [("c", f"y{i}", None) for i in range(20)] + [("c", "c0", None)]
    rows += [("noise", f"n{i}", None) for i in range(50)] + [("noise", "x1", None), ("few", "x1", None), ("few", "x2", None)]
    mentions = spark.createDataFrame([(c, v, k, [0]) for c, v, k in rows], "context string, value string, kind int, options array<int>")
    got = {(r["context"], r["value"]) for r in p.learned_mentions(mentions).collect()}
    assert {("b", f"y{i}") for i in range(20)} <= got  # a context with 30 per cent seeds
    assert ("c", "c0") in got  # a context without seeds, two hops away
    assert {c for c, _ in got} == {"a", "b", "c"}


def test_hot_context_and_value(spark, monkeypatch):
    """One context in all rows and one identifier in a third of them: dealt over tasks, with the result of plain joins."""
    rows = [(i, f"call me at +1 (2{i % 90:02d}) 555-{i:04d} today please") for i in range(2000)]
    rows += [(i, f"call me at (2{i % 90:02d}) 555-{i:04d} today please") for i in range(2000, 2300)]
    rows += [(i, "call me at (999) 555-0000 today please") for i in range(2300, 3600)]
    df, salted = spark.createDataFrame(rows, "doc_id long, text string"), []

    def dealt(left, groups, keys, members, *rest, **named):
        salted.append((keys, groups.where(f"{members} > 1000").count()))
        return join_groups(left, groups, keys, members, *rest, **named)

    monkeypatch.setattr(p, "join_groups", dealt)
    got = {r["doc_id"]: r["spans"] for r in p.report(df).collect()}
    monkeypatch.setattr(p, "join_groups", lambda left, groups, keys, members, spread, total, how="inner": left.join(groups, keys, how).withColumn("__salt", F.lit(0)))
    assert got == {r["doc_id"]: r["spans"] for r in p.report(df).collect()}
    assert {tuple(k) for k, n in salted if n} == {("context", "kind"), ("context", "value")}
    assert got[2300] == "phone:11:25" and all(got.values())
