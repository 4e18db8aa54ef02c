import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from veilspan.jobs.classification import classify
from veilspan.operators import detect as D
from veilspan.operators.checks import PythonCheck, as_python, python_check
from veilspan.sources.rules import Rules

RULES = Rules(()).with_recognizer("TAG", [(r"\b[a-z]{2}-[0-9a-z]+", 0.9)], validator="own", country="XX", parameters=(("limit", 5),))
ROWS = [(1, "ab-7 cd-x ef-12"), (2, "none"), (3, None), (4, ""), (5, "gh-3"), (6, "ab-7 ab-7")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def found(docs, check, rules=RULES):
    return sorted((r.doc_id, r.start, r.value) for r in D.detect(docs, rules, validators={"own": check}).collect())


def digits(v):
    return v[3:].isdigit()


ALL_DIGITS = [(1, 0, "ab-7"), (1, 10, "ef-12"), (5, 0, "gh-3"), (6, 0, "ab-7"), (6, 5, "ab-7")]


@pytest.mark.parametrize(
    "check",
    [
        python_check(digits),
        python_check(lambda v: bool(int(v[3:]) + 1)),  # raises on x
        python_check(lambda v, t: v in t and digits(v)),
        python_check(lambda v, t, c: c == "XX" and digits(v)),
        python_check(lambda v, t, c, p: p["limit"] == 5 and p["entity"] == "TAG" and digits(v)),
        python_check(lambda *a: len(a) == 4 and digits(a[0])),
        F.pandas_udf(lambda v: v.str.slice(3).str.isdigit(), BooleanType()),
        F.pandas_udf(lambda v: v.str.slice(3).astype(int) >= 0, BooleanType()),  # raises for the batch that holds x
        F.pandas_udf(lambda v, t: pd.Series([b.find(a) >= 0 and digits(a) for a, b in zip(v, t, strict=True)]), BooleanType()),
        F.arrow_udf(lambda v: pc.match_substring_regex(v, "-[0-9]+$"), BooleanType()),
        F.udf(digits, BooleanType()),
        lambda v, t: F.substring(v, 4, 9).cast("int") >= 0,  # fails on x where casts raise
        lambda v, t: F.when(F.substring(v, 4, 9).rlike("^[0-9]+$"), True),
    ],
)
def test_kinds_of_checks(docs, check):
    assert found(docs, check) == ALL_DIGITS


def test_batches_of_other_lengths_and_nulls_fail(docs):
    assert found(docs, F.pandas_udf(lambda v: pd.Series([True] * (len(v) + 1)), BooleanType())) == []
    assert found(docs, F.arrow_udf(lambda v: pa.nulls(len(v), pa.bool_()), BooleanType())) == []
    assert found(docs, python_check(lambda v: None)) == []


def test_streamed_udf_and_what_is_no_python(docs):
    def each(batches):
        for v in batches:
            yield v.str.slice(3).str.isdigit()

    assert found(docs, PythonCheck(each, "pandas", True)) == ALL_DIGITS
    assert as_python(lambda v, t: v == t) is None and as_python(python_check(digits)).kind == "plain"
    with pytest.raises(ValueError):
        python_check(lambda: True).arguments()


def test_one_failing_check_leaves_the_others(docs):
    rules = RULES.with_recognizer("DASH", [("-", 0.9)], country="XX")
    assert len(D.detect(docs, rules, validators={"own": python_check(lambda v: 1 / 0)}).collect()) == 6
    mixed = rules.with_recognizer("NUM", [("[0-9]+", 0.9)], validator="num", country="XX")
    out = D.detect(docs, mixed, validators={"own": python_check(digits), "num": lambda v, t: (F.lit(10) / (v.cast("int") - 7)) > 0}).collect()
    assert sorted(r.value for r in out if r.entity_type == "NUM") == ["12"] and sum(r.entity_type == "TAG" for r in out) == 5


def test_session_keeps_its_mode_and_plans_stay(spark, docs):
    before = spark.conf.get("spark.sql.ansi.enabled")
    found(docs, lambda v, t: v.cast("int") > 0)
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    plain = Rules(()).with_recognizer("TAG", [("[a-z]+", 0.9)], validator="any_digit")
    plan = D.with_spans(docs, plain)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError, match="step of their own"):
        D.find_spans(F.col("text"), RULES, validators={"own": python_check(digits)})
    with pytest.raises(ValueError, match="no validator"):
        D.detect(docs, RULES)


def test_classify_with_checks(docs):
    for anonymize in (False, True):
        out = {r.doc_id: r for r in classify(docs, rules=RULES, validators={"own": python_check(digits)}, anonymize=anonymize).collect()}
        assert out[3].status == out[4].status == 400 and out[3].entityDetails == {}
        assert [d.entity_value for d in out[1].entityDetails["tag"]] == ["ab-7", "ef-12"]
    assert out[1].data == "&lt;TAG&gt; cd-x &lt;TAG&gt;"


def test_empty_matches(spark):
    docs = spark.createDataFrame([(1, "axxbx"), (2, "bbb"), (3, "é xx﷒x"), (4, "")], "doc_id long, text string")
    spans = lambda rx: sorted((r.doc_id, r.start, r.end, r.value) for r in D.detect(docs, Rules(()).with_recognizer("X", [(rx, 0.9)])).collect())
    runs = [(1, 1, 3, "xx"), (1, 4, 5, "x"), (3, 2, 4, "xx"), (3, 5, 6, "x")]
    assert spans("x*") == spans("x+") == spans("(?:x|(?=b))+") == runs
    assert spans(r"\b") == spans("^|$") == []
    many = spark.createDataFrame([(1, "ab" * 500)], "doc_id long, text string")
    got = D.detect(many, Rules(()).with_recognizer("A", [("a*", 0.2)], context=["nothing"], min_confidence=0.1)).collect()
    assert [(r.start, r.end) for r in sorted(got, key=lambda r: r.start)] == [(2 * i, 2 * i + 1) for i in range(500)]
