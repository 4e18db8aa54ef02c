import pytest
from pyspark.sql import functions as F

from veilspan.llm import quality as Q

SPACE = set(" \t\n\x0b\x0c\r")


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def base(text):
    words, text = words_of(text), text or ""
    lines = [x for x in text.split("\n") if words_of(x)]
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n, r = len(words), len(repeated)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


CLEAN = "It was the first day of the year and the river had risen over the meadow, so we took the upper road to the town and met nobody on the way."
TEXTS = [
    CLEAN,
    CLEAN + "\n" + CLEAN,
    "\n".join([CLEAN, "", "  ", "alpha the of", "alpha the of", "alpha  the of"]),
    " ".join(f"w{i % 9}" for i in range(300)),
    " ".join(f"the of {'ab'[i % 2] * (i % 5 + 1)}{i}" for i in range(40)) + " " + " ".join("pqrstuvwxyz"),
    "a b c d e f g h " * 2 + "x " + "b c d e f g h a",
    "# * $ % & | < > " * 4,
    " ".join(["supercalifragilistic"] * 3 + ["expialidocious" + str(i) for i in range(30)]),
    "\n".join(f"- item of the {i}" for i in range(20)),
    "the end of it ...\n" * 3 + CLEAN,
    "\x0b".join("one two\x0cthree\rfour".split(" ")) + " é " * 25,
    "日本語 " * 25,
    None,
    "",
    " \n\t ",
    CLEAN,
]


def test_counts_against_brute_force(spark):
    rows = list(enumerate(TEXTS))
    out = {r.doc_id: r for r in Q.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), text
        assert not (r.kept and r.base_failed)
    assert out[0].kept and out[15].kept and out[0].failed == ""
    assert out[8].failed.split(",") == ["bullet_lines"] or "bullet_lines" in out[8].failed
    assert "symbols" in out[6].failed and "word_length" in out[7].failed and "ellipsis_lines" in out[9].failed and "stop_words" in out[11].failed


def test_long_text_with_many_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30_000)) + " " + " ".join(f"w{i}" for i in range(10_000))
    r = Q.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words) == (40_000, 20_000)


def test_one_projection_without_python_or_shuffle(spark, odd):
    plan = Q.report(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_nulls_repeats_clashes_and_nothing(spark, odd, odd_rows, none):
    out = Q.report(odd).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.kept) for r in out))) == sorted(map(str, ((r[0], len(words_of(r[1])), k.kept) for r in odd_rows for k in [next(o for o in out if o.doc_id == r[0] and o.n_words == len(words_of(r[1])))])))
    assert Q.report(none).count() == 0 and Q.report(none).schema == Q.report(odd).schema
    kept = Q.good_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {7, 8, 9}


def test_table_of_thresholds(spark):
    table = spark.createDataFrame([("length", "n_words", 2.0, 3.0), ("any", "mean_word_chars", None, 4.0)], "rule string, measure string, least double, most double")
    docs = spark.createDataFrame([(1, " ".join(["the"] * 3 + [str(i) for i in range(30)]))], "doc_id long, text string")
    out = Q.assess(docs, thresholds=Q.thresholds_from(table)).select("quality.failed", "quality.kept").first()
    assert out.failed == ["length"] and not out.kept
    assert Q.assess(docs, thresholds=()).select("quality.kept").first().kept
    with pytest.raises(ValueError):
        Q.thresholds_from(table, 1)
    with pytest.raises(ValueError):
        Q.failed_rules(F.struct(F.lit(1).alias("n_words")), [Q.Threshold("x", "n_words")])
