import json
import os

import pytest
from pyspark.sql import functions as F

from veilspan.operators import detect as D
from veilspan.sources.json_lists import json_records, read_json_list
from veilspan.sources.rules import Rules, load_rules, overridden, read_rules, rules_from, rules_table
from veilspan.sources.tables import gold, read_json_corpus, read_labelled, readable_rows, write_results

GOOD = {
    """[{"start": 1, "end": 4, "label": "NAME", "extracted_text": "O'Brien"}]""": ["O'Brien"],
    """[{'start': 1, 'label': 'NAME', 'extracted_text': 'say "x"'}]""": ['say "x"'],
    """[{'start': None, 'label': 'A', 'extracted_text': 'x', 'sure': True}, {'label': None, 'extracted_text': 'None, True'},]""": ["x", "None, True"],
    r"""[{'label': 'A', 'extracted_text': 'it\'s \\ \x41 \U000000e9 \"q\" \d'}]""": ["it's \\ A é \"q\" \\d"],
    r"""[{'label': 'A', 'extracted_text': 'end \\'}, {'label': 'B', 'extracted_text': "a\\\"b"}]""": ["end \\", 'a\\"b'],
    """[{'label': ‘NAME’, 'extracted_text': 'D’Arcy'}]""": ["D’Arcy"],
    """[{'label': ’NAME’, 'extracted_text': ‘x’}]""": ["x"],
    '[{"label": "A", "extracted_text": "json \\u00e9 null", "start": null}]': ["json é null"],
    """ [ ]\n""": [],
    "": [],
    None: [],
}
BAD = ["""[{'label': 'A', 'extracted_text': 'O'Brien'}]""", "[{'label': 'A'", "nonsense", "{'label': 'A'}", "[1, 2]", """[{'label': 'A'}] oops""", "nan", r"[{'label': '\U0001f600'}]"]


def test_printed_lists(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*GOOD, *BAD])], "i int, t string")
    out = {r.i: r.g for r in rows.select("i", gold(F.col("t")).alias("g")).collect()}
    for i, want in enumerate(GOOD.values()):
        assert (out[i].readable, [e.extracted_text for e in out[i].entities]) == (True, want), list(GOOD)[i]
    for i, text in enumerate(BAD):
        assert (out[len(GOOD) + i].readable, out[len(GOOD) + i].entities) == (False, []), text


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_unreadable_rows(spark, tmp_path, fmt):
    rows = [(1, "a", "[{'label': 'A', 'extracted_text': 'x'}]"), (2, "b", "[]"), (3, "c", "[{'label"), (4, "d", None)]
    df = spark.createDataFrame(rows, "row_id long, text string, mapped_output string")
    df.write.options(**({"header": "true", "quote": '"', "escape": '"'} if fmt == "csv" else {})).format(fmt).save(f"{tmp_path}/x")
    if fmt == "json":
        with open(f"{tmp_path}/x/more.json", "w") as f:
            f.write('{"row_id": 5, "text"\n{"row_id": 6, "text": "f", "mapped_output": [{"label": "B", "extracted_text": "y"}]}\n')
    flagged = read_labelled(spark, f"{tmp_path}/x", fmt, readable="fine")
    kept, counts = readable_rows(flagged, "fine", f"{tmp_path}/bad")
    got = {r.row_id: [e.extracted_text for e in r.mapped_output] for r in kept.collect()}
    more = {6: ["y"]} if fmt == "json" else {}
    assert got == {1: ["x"], 2: [], 4: [], **more} and kept.columns == ["row_id", "text", "mapped_output"]
    assert counts.get == {"n_rows": 6 if more else 4, "n_unreadable": 2 if more else 1, "n_empty": 2, "n_entities": 2 if more else 1}
    assert spark.read.schema("row_id long").json(f"{tmp_path}/bad").count() == (2 if more else 1)
    arrays = read_labelled(spark, f"{tmp_path}/x", fmt)
    assert arrays.count() == (6 if more else 4)


ITEMS = [
    {"Text": 'braces } { in "strings" \\ and \\" quotes', "Entities": [{"start": 1, "end": 2, "label": "A", "extracted_text": "}"}]},
    {"Text": "", "Entities": []},
    {"Text": "é" * 50 + "}" * 30 + '"{[' * 20, "Entities": None},
    {"Text": "long " * 400, "Entities": [{"start": i, "end": i, "label": "{", "extracted_text": '"}'} for i in range(40)]},
    {"Text": None, "Entities": [{"start": 0, "end": 0, "label": "x", "extracted_text": None}]},
]


@pytest.mark.parametrize(("size", "indent"), [("300", None), ("700", 2), ("128m", 2)])
def test_json_lists_in_splits(spark, tmp_path, size, indent):
    items = [dict(ITEMS[i % len(ITEMS)], Nr=i) for i in range(20)]
    for name, part in (("a", items[:15]), ("b", items[15:]), ("c", [])):
        with open(f"{tmp_path}/{name}.json", "w") as f:
            json.dump(part, f, indent=indent, ensure_ascii=False)
    with open(f"{tmp_path}/d.json", "w") as f:
        json.dump(dict(ITEMS[0], Nr=20), f)
    open(f"{tmp_path}/e.json", "w").close()
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = read_json_list(spark, str(tmp_path), "Text string, Nr int, Entities array<struct<start:int,`end`:int,label:string,extracted_text:string>>").collect()
        corpus = read_json_corpus(spark, f"{tmp_path}/a.json")
        assert corpus.columns == ["text", "mapped_output"] and corpus.count() == 15
        if size == "700":
            assert spark.read.option("lineSep", "}").text(f"{tmp_path}/a.json").rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {r.Nr: (r.Text, r.Entities and [e.asDict() for e in r.Entities]) for r in rows}
    assert len(rows) == 21 and got == {i: (x["Text"], x["Entities"]) for i, x in enumerate([*items, ITEMS[0]])}


def test_json_list_that_is_cut_off(spark, tmp_path):
    with open(f"{tmp_path}/a.json", "w") as f:
        f.write('[{"Text": "one"}, {"Text": oops}, {"Text": "t')
    rows = read_json_list(spark, str(tmp_path), "Text string", corrupt="bad").collect()
    assert [r.Text for r in rows if r.bad is None] == ["one"] and len([r for r in rows if r.bad]) == 2
    assert json_records(spark, f"{tmp_path}/a.json").count() == 3


def test_large_json_list(spark, tmp_path):
    with open(f"{tmp_path}/a.json", "w") as f:
        f.write("[" + ",".join(json.dumps({"Text": f"{i} " + "word } " * 60, "Entities": []}) for i in range(20_000)) + "]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        assert read_json_corpus(spark, f"{tmp_path}/a.json").agg(F.count_distinct("text"), F.count("text"), F.min(F.length("text"))).first()[:2] == (20_000, 20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rule_tables(spark, tmp_path):
    rules = load_rules(secrets=True)
    for fmt in ("json", "parquet"):
        rules_table(spark, rules).write.format(fmt).save(f"{tmp_path}/{fmt}")
        again = {r.entity: r for r in read_rules(spark, f"{tmp_path}/{fmt}", fmt)}
        for r in rules:
            a = again[r.entity]
            assert (a.name, a.group, a.context, a.validator, a.guard_decimals, a.min_confidence, a.methods, a.enabled, a.country, a.output_key) == (r.name, r.group, r.context, r.validator, r.guard_decimals, r.min_confidence, r.methods, r.enabled, r.country, r.output_key)
            assert [(p.regex, p.score, p.needs) for p in a.patterns] == [(p.regex, p.score, p.needs) for p in r.patterns]


def _row(**changes):
    return {"country": "XX", "entity": "TAG", "group": "g", "patterns": [{"regex": "x+", "score": 0.9}], **changes}


@pytest.mark.parametrize(
    ("row", "says"),
    [
        (_row(patterns=[{"regex": "x+", "score": 0.9}, {"regex": "(x", "score": 0.9}]), r"XX/TAG: patterns\[1\].regex: Unclosed group"),
        (_row(patterns=[{"regex": "x", "score": 1.5}]), r"patterns\[0\].score 1.5"),
        (_row(patterns=[{"regex": "", "score": 0.5}]), r"patterns\[0\].regex is empty"),
        (_row(min_confidence=7), "min_confidence 7.0"),
        (_row(methods=["guess"]), "methods: no such method as guess"),
        (_row(validator="nope"), "validator: no such check as nope"),
        (_row(group=None), "group is missing"),
        (_row(colour="red"), "no such field as colour"),
        (_row(enabled="perhaps"), "XX/TAG: a field is of another type"),
    ],
)
def test_errors_name_the_field(spark, tmp_path, row, says):
    with open(f"{tmp_path}/r.json", "w") as f:
        f.write(json.dumps(row) + "\n")
    with pytest.raises(ValueError, match=says):
        read_rules(spark, str(tmp_path), validators={"ssn"})


def test_rules_of_countries_and_overrides(spark, tmp_path):
    with open(f"{tmp_path}/r.json", "w") as f:
        for row in (_row(), _row(country="GLOBAL", patterns=[{"regex": "y+", "score": 0.9}])):
            f.write(json.dumps(row) + "\n")
    rules = read_rules(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "xx yy")], "doc_id long, text string")
    values = lambda r: sorted(x.value for x in D.detect(docs, r).collect())
    assert values(load_rules(["XX"], table=rules)) == ["xx"] and values(load_rules(["ZZ"], table=rules)) == ["yy"] and values(load_rules(["XX", "ZZ"], table=rules)) == ["xx", "yy"]
    assert values(load_rules(["XX"], table=rules, overrides={("XX", "TAG"): {"patterns": [("y", 0.9)]}})) == ["y", "y"]
    assert values(load_rules(["XX"], table=rules, overrides={("XX", "TAG"): {"min_confidence": 0.95}})) == []
    table = spark.createDataFrame([("XX", "TAG", False)], "country string, entity string, enabled boolean")
    assert values(load_rules(["XX"], table=rules, overrides=table)) == []
    for bad, says in (({("XX", "NO"): {}}, "no rule XX/NO"), ({("XX", "TAG"): {"size": 1}}, "no such field as size"), ({("XX", "TAG"): {"patterns": [("(", 0.5)]}}, "Unclosed")):
        with pytest.raises(ValueError, match=says):
            overridden(rules, bad, spark)
    with pytest.raises(ValueError, match="twice"):
        rules_from(rules_table(spark, Rules([*rules, *rules])))


def test_partitions_written_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    write_results(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, partition_by=["p"])
    write_results(spark.createDataFrame([(3, "b")], "v int, p string"), path, partition_by=["p"], only_partitions=True)
    assert sorted((r.v, r.p) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]
    with pytest.raises(ValueError):
        write_results(spark.range(1), path, only_partitions=True)
    assert os.path.isdir(path)
