import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspan.jobs import queries as Q
from veilspan.jobs.classification import classify, entity_details, split_valid
from veilspan.operators import evaluate as E
from veilspan.operators import values as X
from veilspan.operators.detect import with_spans
from veilspan.operators.redact import redact
from veilspan.sources.rules import load_rules
from veilspan.sources.tables import concat_datasets, planted_records, read_json_corpus, read_labelled, write_results
from veilspan.streaming.classify import classify_stream, read_texts

SLIM = ["detect_us_ssn_rec", "detect_phone_number_rec", "detect_secrets_rec", "decimal_guard", "validators_matrix", "check_digits", "overlap_groups", "non_overlap_best", "redact_docs", "concat_sets", "null_profile", "parse_gold", "parse_model_json", "map_values", "match_values", "name_subsequences", "eval_metrics", "missed_rows", "detect_all_docs", "classify_response", "redact_all_docs", "redacted_places", "row_countries", "enabled_methods", "missing_text", "own_recognizer", "checks_by_label", "gold_pairs", "relabelled", "labelled_tables", "json_corpus", "stream_details", "match_names"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", SLIM)
def test_query_agrees_with_sql(spark, sf, duck, name):
    want = duck.execute(Q.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = Q.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rows: sorted(tuple(str(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_redacted_text_is_the_text_with_its_best_spans_replaced(spark, sf):
    out = redact(with_spans(planted_records(spark, sf, more=True).select("doc_id", "text"), load_rules()))
    escaped = lambda t: t.replace("<", "&lt;").replace(">", "&gt;")
    for r in out.where("doc_id BETWEEN 1 AND 40").collect():
        kept = []
        for s in sorted(r["spans"], key=lambda s: (-s["score"], s["start"] - s["end"], s["start"], s["entity_type"])):
            if all(s["end"] <= k["start"] or k["end"] <= s["start"] for k in kept):
                kept.append(s)
        data, at, places = "", 0, []
        for s in sorted(kept, key=lambda s: s["start"]):
            data += escaped(r["text"][at : s["start"]])
            mark = f"&lt;{s['entity_type']}&gt;"
            places.append((s["entity_type"], s["value"], len(data), len(data) + len(mark), f"{len(data)}_{len(data) + len(mark)}"))
            data, at = data + mark, s["end"]
        assert kept and r["data"] == data + escaped(r["text"][at:])
        assert [(d["entity_type"], d["entity_value"], d["start_index"], d["end_index"], d["location"]) for d in r["details"]] == places


def test_classify_rows(spark):
    rows = [(1, "mail a.b@c.org & <x>", True), (2, "mail a.b@c.org", False), (3, "", True), (4, None, True)]
    out = classify(spark.createDataFrame(rows, "doc_id long, text string, hide boolean"), anonymize=F.col("hide"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == [200, 200, 400, 400]
    assert [got[i]["data"] for i in (1, 2, 3, 4)] == ["mail &lt;EMAIL_ADDRESS&gt; & &lt;x&gt;", "", "", ""]
    assert got[1]["entityDetails"]["email-address"][0]["location"] == "5_26"
    assert got[2]["entityDetails"]["email-address"][0]["location"] == "5_14"
    assert got[3]["entityDetails"] == got[4]["entityDetails"] == {}
    assert entity_details(out).count() == 2
    assert split_valid(out, "data").where("status = 200").count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = planted_records(spark, sf).select("doc_id", "text").limit(50)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    rules = load_rules().only("EMAIL_ADDRESS", "DOD_ID")
    classify_stream(read_texts(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "state"), once=True, rules=rules, anonymize=True).awaitTermination()
    rows = lambda df: sorted((r["doc_id"], r["data"]) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(classify(docs, rules=rules, anonymize=True))


def test_stream_reads_a_table_of_many_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    one, many = (rows(Q.QUERIES["stream_details"](spark, path)) for path in (sf, str(tmp_path)))
    assert one and one == many


def test_printed_gold_is_parsed_once_for_each_row(spark, sf):
    plan = Q.QUERIES["parse_gold"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_only_the_rules_of_the_label_are_searched(spark, sf):
    plan = Q.QUERIES["missed_rows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "12][0-9]|3[01])[-/.]" in plan and "EMP|EID" not in plan


def test_evaluation_by_hand(spark):
    gold = spark.createDataFrame([(1, "a", "x", 0, 1), (1, "a", "y", 2, 3), (2, "b", "z", 0, 1)], "row_id long, label string, value string, start int, end int")
    pred = spark.createDataFrame([(1, "a", "x", 0, 1), (1, "a", "w", 2, 3), (2, "c", "q", 5, 6)], "row_id long, label string, value string, start int, end int")
    m = {r["entity_type"]: r for r in E.entity_metrics(gold, pred).collect()}
    assert (m["a"]["correct"], m["a"]["extra"], m["a"]["missed"], m["a"]["support"], m["a"]["accuracy"], m["a"]["f1"]) == (1, 1, 1, 1, pytest.approx(1 / 3), 0.5)
    assert (m["b"]["recall"], m["c"]["precision"], m["c"]["actual_count"]) == (0.0, 0.0, 0)
    rows = spark.createDataFrame([(1,), (2,)], "row_id long")
    assert E.rows_with_extra(rows, gold, pred, "A").count() == 0
    assert [r["row_id"] for r in E.rows_with_missed(rows, gold, pred, "b").collect()] == [2]
    assert E.macro_average(E.entity_metrics(gold.limit(0), pred.limit(0))).first().asDict() == dict.fromkeys(["macro_accuracy", "macro_precision", "macro_recall", "macro_f1"], 0.0)
    arrays = spark.createDataFrame([(1, [("SSN", " 1 "), ("ssn", "2"), ("SSN", "1")])], "row_id long, e array<struct<label:string,extracted_text:string>>")
    assert E.entity_pairs(arrays, "e").count() == 2
    both = arrays.withColumn("classification_results", F.col("e"))
    assert len(E.relabel_from_predictions(both, "SSN").first()["mapped_output"]) == 3


def test_model_output(spark):
    raw = ['```json\n{"SSN": ["1"]}\n```', '{"SSN": []}', "no json", None]
    got = [r["m"] for r in spark.createDataFrame([(r,) for r in raw], "r string").select(X.parse_model_json(F.col("r")).alias("m")).collect()]
    assert got == [{"SSN": ["1"]}, {"SSN": []}, {}, {}]
    verdicts = ['[{"A": "Correct"}, {"A": "Incorrect", "B": "correct"}]', '{"A": "Correct"}']
    got = [r["m"] for r in spark.createDataFrame([(r,) for r in verdicts], "r string").select(X.merge_verdicts(F.col("r")).alias("m")).collect()]
    assert got == [{"A": "Incorrect", "B": "correct"}, {"A": "Correct"}]
    names = spark.createDataFrame([("John Q Doe",), ("",), (" ".join("abcdefghi"),)], "n string").select(X.name_subsequences(F.col("n")).alias("s")).collect()
    assert names[0]["s"] == ["John Q Doe", "John Doe", "John Q", "Q Doe", "John", "Doe", "Q"]
    assert names[1]["s"] == [] and len(names[2]["s"]) == 511 and names[2]["s"][0] == "a b c d e f g h i"
    capped = spark.createDataFrame([("a b c",)], "n string").select(X.name_subsequences(F.col("n"), 2).alias("s")).first()["s"]
    assert capped == ["a b c"]


def test_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"Text": "a", "Entities": [{"start": 0, "end": 1, "label": "x", "extracted_text": "a"}]}, {"Text": "b", "Entities": []}]')
    corpus = read_json_corpus(spark, str(tmp_path / "c.json"))
    assert [(r["text"], len(r["mapped_output"])) for r in corpus.orderBy("text").collect()] == [("a", 1), ("b", 0)]
    write_results(corpus.withColumn("row_id", F.lit(1).cast("long")), str(tmp_path / "out"), partition_by=["row_id"])
    assert read_labelled(spark, str(tmp_path / "out")).count() == 2
    assert concat_datasets(corpus, corpus).count() == 4


def test_names_of_any_length_match_by_parts(spark):
    long = "Maria Josefa Carmen Teresa Isabel Lucia Beatriz Dolores Fernandez Garcia"
    text = "Signed by maria carmen GARCIA, and Teresa Isabel Fernandez; Garcia Maria; John Smith-Doe, john doe."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x " + long + " y")], "doc_id long, text string")
    values = spark.createDataFrame([(i, "name", n) for i in (1, 2, 3) for n in (long, "John Q Doe")], "doc_id long, label string, value string")
    got = {(r["doc_id"], r["start"], r["extracted_text"]) for r in X.match_values(docs, values).collect()}
    want = ["maria carmen GARCIA", "Teresa Isabel Fernandez", "john doe"]
    assert {(1, text.index(w), w) for w in want} | {(3, 2, long)} <= got
    assert {g[2] for g in got} == {*want, long, "Garcia"}  # "Maria" and "John" are too short for a name
