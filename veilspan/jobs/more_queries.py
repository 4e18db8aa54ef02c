"""More registered queries: user checks, rule tables, gold and model answers as they come, large inputs, reruns."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import overlap as O
from ..operators import values as X
from ..operators.checks import python_check
from ..sources.folders import new_folder
from ..sources.rules import Rules, load_rules, read_rules, rules_table
from ..sources.tables import ENTITY, gold, planted_records, planted_texts, read_json_corpus, read_labelled, readable_rows, table, write_results
from ..streaming.classify import replace_batch
from . import classification as C
from . import oracle as S
from .queries import REC, RULES, SECRETS, query


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_records(spark, sf_dir, more=True)


def _with_checks(**names: str) -> Rules:
    return Rules(replace(r, validator=names[r.entity]) for r in RULES.only(*names))


def _ends_in_seven(values: pd.Series) -> pd.Series:
    return values.str.endswith("7")


def _ends_in_three(values: pa.Array) -> pa.Array:
    return pc.ends_with(values, "3")


def _even(value: str) -> bool:
    return int("".join(c for c in value if c.isdigit())) % 2 == 0


def _of_record(value: str, text: str, country: str, parameters: dict) -> bool:
    return value[-1] == text[16] and country == "US" and parameters["entity"] == "MEDICAL_LICENSE"


def _spans_where(condition: dict[str, str]) -> str:
    passing = " OR ".join(f"(entity_type = '{e}' AND {c})" for e, c in condition.items())
    return f'WITH {REC}, {S.checked("rec", list(condition))} SELECT spans.doc_id, entity_type, start_ AS start, end_ AS "end", score, value FROM spans JOIN rec ON rec.doc_id = spans.doc_id WHERE {passing}'


@query(_spans_where({"EMAIL_ADDRESS": "CAST(regexp_extract(value, '[0-9]+') AS BIGINT) % 2 = 0", "DOD_ID": "value LIKE '%7'", "BUSINESS_TAX_ID": "value LIKE '%3'", "MEDICAL_LICENSE": "right(value, 1) = substring(rec.text, 17, 1)"}))
def python_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python checks of one and of four arguments, by value and by batch of pandas or Arrow."""
    rules = _with_checks(EMAIL_ADDRESS="even", DOD_ID="seven", BUSINESS_TAX_ID="three", MEDICAL_LICENSE="own")
    checks = {"even": python_check(_even), "seven": F.pandas_udf(_ends_in_seven, "boolean"), "three": F.arrow_udf(_ends_in_three, "boolean"), "own": python_check(_of_record)}
    return D.detect(_records(spark, sf_dir), rules, validators=checks)


def _raises_on_odd(value: str, text: str) -> bool:
    if not _even(value):
        raise RuntimeError(f"odd: {value}")
    return value in text


def _raises_for_batch(values: pd.Series) -> pd.Series:
    if values.str.endswith("5").any():
        raise RuntimeError("a value ends in 5")
    return values.str.endswith("7")


_TAIL_OVER = "coalesce(try_cast(substring(value, 5, 10) AS INTEGER) > 50000, false)"


@query(_spans_where({"EMPLOYEE_ID": _TAIL_OVER, "EMAIL_ADDRESS": "CAST(regexp_extract(value, '[0-9]+') AS BIGINT) % 2 = 0", "DOD_ID": "value LIKE '%7'"}))
def failing_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that fail on some values: a cast of what is no number, an exception for one value, and one for its whole batch."""
    rules = _with_checks(EMPLOYEE_ID="number", EMAIL_ADDRESS="even", DOD_ID="batch")
    checks = {"number": lambda v, t: F.substring(v, 5, 10).cast("int") > 50000, "even": python_check(_raises_on_odd), "batch": F.pandas_udf(_raises_for_batch, "boolean")}
    return D.detect(_records(spark, sf_dir), rules, validators=checks)


#: Printed lists as they come, by the record's number: quotes in values, constants, escapes, a comma at the end, blank and broken ones.
_PRINTED = [
    """concat('[{"start": 1, "label": "NAME", "extracted_text": "O''Brien ', k, '"}]')""",
    """concat('[{''start'': 2, ''label'': ''NAME'', ''extracted_text'': ''say "', k, '"''}]')""",
    """concat('[{''start'': 3, ''end'': None, ''label'': ''NAME'', ''extracted_text'': ''it', chr(92), '''s ', k, '''}, ]')""",
    """concat('[{''start'': 4, ''label'': ‘NAME’, ''extracted_text'': ''D’Arcy ', k, ''', ''sure'': True}]')""",
    """concat('[{''start'': 5, ''label'': ''NAME'', ''extracted_text'': ''caf', chr(92), 'xe9 None, ', k, '''}]')""",
    """'[]'""",
    """concat('[{''start'': 6, ''label'': ''NAME'', ''extracted_text'': ''O''Brien ', k, '''}]')""",
    """concat('[{''start'': 7, ''label'': ''NAME'', ''extracted_text'': ''cut ', k)""",
]
_MEANT = ["concat('O''Brien ', k)", """concat('say "', k, '"')""", "concat('it''s ', k)", "concat('D’Arcy ', k)", "concat('café None, ', k)"]
_KIND = f"c_custkey % {len(_PRINTED)}"


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, mapped_output): a printed list for each customer."""
    k = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"))
    listed = F.expr(f"case {_KIND} " + " ".join(f"when {i} then {p}" for i, p in enumerate(_PRINTED)) + " end")
    return k.select(F.col("c_custkey").alias("row_id"), F.concat(F.lit("text "), "k").alias("text"), listed.alias("mapped_output"))


@query(
    "SELECT c_custkey AS row_id, CAST(kind + 1 AS INTEGER) AS start, 'NAME' AS label, CASE kind " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_MEANT)) + f" END AS value FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, {_KIND} AS kind FROM customer) WHERE kind < {len(_MEANT)}"
)
def gold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with apostrophes and other quotes in printed lists; lists that are broken give nothing."""
    rows = _printed(spark, sf_dir).select("row_id", F.explode(F.array(gold(F.col("mapped_output")))).alias("g"))
    return rows.select("row_id", F.explode("g.entities").alias("e")).select("row_id", "e.start", "e.label", F.col("e.extracted_text").alias("value"))


@query(
    f"WITH c AS (SELECT {_KIND} AS kind FROM customer), f AS (SELECT unnest(['csv', 'json']) AS fmt) "
    "SELECT fmt, count(*) AS n_rows, count(*) FILTER (kind >= 6) AS n_unreadable, count(*) FILTER (kind = 5) AS n_empty, count(*) FILTER (kind < 5) AS n_entities, count(*) FILTER (kind >= 6) AS n_quarantined, count(*) FILTER (kind < 6) AS n_kept FROM c, f GROUP BY fmt"
)
def gold_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose gold cannot be read go to a folder of their own and are counted; those without entities are not among them."""
    out = []
    for fmt in ("csv", "json"):
        path, bad = new_folder(spark), new_folder(spark)
        _printed(spark, sf_dir).write.options(**({"header": "true", "quote": '"', "escape": '"'} if fmt == "csv" else {})).format(fmt).save(path)
        kept, counts = readable_rows(read_labelled(spark, path, fmt, readable="readable"), "readable", bad)
        n_kept = kept.count()
        out.append((fmt, *(counts.get[c] for c in ("n_rows", "n_unreadable", "n_empty", "n_entities")), spark.read.schema("row_id long").json(bad).count(), n_kept))
    return spark.createDataFrame(out, "fmt string, n_rows long, n_unreadable long, n_empty long, n_entities long, n_quarantined long, n_kept long")


@query(f"WITH {REC}, {S.checked('rec', ['US_SSN', 'EMAIL_ADDRESS', 'EMPLOYEE_ID'])} SELECT doc_id, entity_type, start_ AS start, end_ AS \"end\", CASE entity_type WHEN 'EMAIL_ADDRESS' THEN CAST(0.7 AS DOUBLE) ELSE score END AS score, value FROM spans WHERE entity_type <> 'US_SSN' OR score >= 0.85")
def rules_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules written as JSON and Parquet and read again, some fields replaced by a table and others by a mapping."""
    paths = {"json": new_folder(spark), "parquet": new_folder(spark)}
    rules_table(spark, RULES.only("US_SSN", "EMAIL_ADDRESS")).write.json(paths["json"])
    rules_table(spark, RULES.only("EMPLOYEE_ID", "PHONE_NUMBER")).write.parquet(paths["parquet"])
    rules = Rules((*read_rules(spark, paths["json"]), *read_rules(spark, paths["parquet"], "parquet")))
    changes = spark.createDataFrame([("US", "US_SSN", 0.85, None), ("US", "PHONE_NUMBER", None, False)], "country string, entity string, min_confidence double, enabled boolean")
    rules = load_rules(["US"], table=rules, overrides=changes)
    mail = RULES.only("EMAIL_ADDRESS")[0]
    return D.detect(_records(spark, sf_dir), load_rules(table=rules, overrides={("US", "EMAIL_ADDRESS"): {"patterns": [(mail.patterns[0].regex, 0.7)], "context": []}}))


@query(f"WITH {REC} SELECT text, label, value FROM rec, LATERAL (SELECT 'SSN' AS label, ssn AS value UNION ALL SELECT 'EMAIL', email)")
def json_corpus_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one file, as one JSON list, which as many tasks read as it has splits."""
    entity = lambda label, value: F.struct(F.lit(0).alias("start"), F.length(value).alias("end"), F.lit(label).alias("label"), value.alias("extracted_text"))
    entities = F.array(entity("SSN", F.col("ssn")), entity("EMAIL", F.col("email"))).cast(f"array<{ENTITY}>")
    item = F.to_json(F.struct(F.col("text").alias("Text"), entities.alias("Entities")))
    path = new_folder(spark)
    # The file is what is tested: a list has one beginning and one end.
    nr = F.monotonically_increasing_id()
    _records(spark, sf_dir).select(item.alias("item")).coalesce(1).select(F.concat(F.when(nr == 0, "[").otherwise(","), "item")).write.option("lineSep", "\n").text(path)
    return read_json_corpus(spark, path).select("text", F.explode("mapped_output").alias("e")).select("text", "e.label", F.col("e.extracted_text").alias("value"))


@query("SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'rewritten' ELSE 'first' END AS written FROM conversations")
def rewritten_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by role, of which one partition is written a second time; the others stay."""
    rows, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), new_folder(spark)
    write_results(rows.withColumn("written", F.lit("first")), path, partition_by=["role"])
    write_results(rows.where("role = 'user'").withColumn("written", F.lit("rewritten")), path, partition_by=["role"], only_partitions=True)
    return spark.read.parquet(path).select("conv_id", "turn", F.col("role").cast("string").alias("role"), "written")


@query(f"WITH {REC}, {S.checked('rec', ['EMAIL_ADDRESS'])} SELECT doc_id % 3 AS batch, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs FROM spans GROUP BY ALL")
def replayed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a stream, one of which is run twice, as after a failure: nothing is there twice."""
    found, path = C.classify(_records(spark, sf_dir).select("doc_id", "text"), rules=RULES.only("EMAIL_ADDRESS")), new_folder(spark)
    for number in (0, 1, 2, 1):
        replace_batch(found.where(F.col("doc_id") % 3 == number), path, number)
    each = spark.read.parquet(path).select("batch", "doc_id", F.explode("entityDetails").alias("entity", "details")).select("batch", "doc_id", F.explode("details"))
    return each.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"))


#: A model's answers as they come, by the record's number, with what each label should be read as.
_ANSWERED = [
    ("""concat('```json {"SSN": ["', ssn, '"], "EMAIL": "', email, '"} ```')""", {"SSN": "ssn", "EMAIL": "email"}),
    ("""concat('Here is what I found:', chr(10), '```json', chr(10), '{"SSN": ["', ssn, '"]}', chr(10), '```', chr(10), 'Anything else?')""", {"SSN": "ssn"}),
    ("""concat('```{"EMAIL": ["', email, '"], "SSN": null, "AGE": 7}```')""", {"EMAIL": "email", "AGE": "'7'"}),
    ("""concat('{"EMAIL": ["', email, '", null], "ODD": {"a": 1}, "NOTE": "[', ssn, '"}')""", {"EMAIL": "email", "NOTE": "concat('[', ssn)"}),
    ("""concat('I found ', ssn, ', nothing more.')""", {}),
    ("""concat('{"SSN": ["', ssn, '"')""", {}),
]
_BY_ANSWER = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {value} AS value FROM v WHERE doc_id % {len(_ANSWERED)} = {i}" for i, (_, want) in enumerate(_ANSWERED) for label, value in want.items())


@query(f"WITH {REC} {_BY_ANSWER}")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences anywhere, words around the object, bare strings in place of lists; a label that is odd leaves the others."""
    raw = F.expr(f"case doc_id % {len(_ANSWERED)} " + " ".join(f"when {i} then {a}" for i, (a, _) in enumerate(_ANSWERED)) + " end")
    answers = _records(spark, sf_dir).select("doc_id", X.parse_model_json(raw).alias("answer"))
    return X.listed_values(answers).select("doc_id", "label", "value")


_LONG_WORDS = "list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 8))"


@query(
    f"WITH w AS (SELECT doc_id, text, unnest({_LONG_WORDS}) AS value FROM documents), v AS (SELECT DISTINCT doc_id, text, lower(value) AS value FROM w), "
    "p AS (SELECT doc_id, value, string_split(lower(text), value) AS p FROM v), i AS (SELECT doc_id, value, p, unnest(generate_series(1, len(p) - 1)) AS i FROM p), "
    "spans AS (SELECT doc_id, length(value) AS n, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(value) AS BIGINT) AS s FROM i), "
    + S.kept("{'n': -n, 's': s, 'e': s + n}")
    + " SELECT doc_id, count(*) AS n, CAST(sum(x.s) AS BIGINT) AS sum_start, CAST(sum(x.e) AS BIGINT) AS sum_end FROM k GROUP BY doc_id"
)
def match_value_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of up to thousands of values: the long words of each document, in capitals, found everywhere in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.array_distinct(F.transform(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) > 8), lambda w: F.upper(w)))
    found = X.match_values(docs, docs.select("doc_id", F.lit("company_name").alias("label"), F.explode(words).alias("value")))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"))


@query(
    "WITH p AS (SELECT doc_id, string_split(text, '.') AS p FROM documents), i AS (SELECT doc_id, p, unnest(generate_series(1, len(p) - 1)) AS i FROM p), "
    "spans AS (SELECT doc_id, CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start_, length(p[i]) + length(p[i + 1]) + 1 AS n FROM i), "
    "sized AS (SELECT doc_id, CAST((n % 7) / 8 AS DOUBLE) AS score, start_, start_ + n AS end_, 'PAIR' AS entity_type FROM spans), " + S.kept("{'a': -score, 'b': start_ - end_, 's': start_, 't': entity_type, 'e': end_}").replace("FROM spans", "FROM sized")
    + " SELECT doc_id, count(*) AS n, CAST(sum(x.s) AS BIGINT) AS sum_start, CAST(sum(x.e) AS BIGINT) AS sum_end FROM k GROUP BY doc_id"
)
def dense_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains as long as documents: each two neighbouring sentences are a span that overlaps the next one."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", "[.]", -1).alias("p"))
    lengths = pieces.select("doc_id", "row", F.explode(F.array(F.transform("p", lambda x: F.length(x)))).alias("n"))
    copies = lengths.select("doc_id", "row", F.posexplode(F.slice("n", 1, F.size("n") - 1)).alias("i", "own"), F.slice("n", 2, F.size("n")).alias("rest"))
    copies = copies.select("doc_id", "row", "i", "own", F.get("rest", F.col("i")).alias("after"))
    before = Window.partitionBy("doc_id", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    spans = copies.select("doc_id", F.coalesce(F.sum(F.col("own") + 1).over(before), F.lit(0)).cast("int").alias("start"), (F.col("own") + F.col("after") + 1).alias("size"))
    sized = spans.select("doc_id", F.lit("PAIR").alias("entity_type"), "start", (F.col("start") + F.col("size")).alias("end"), ((F.col("size") % 7) / 8).alias("score"))
    kept = O.non_overlapping(sized, best=True)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"))


@query(
    "WITH w AS (SELECT p_partkey, string_split(concat(p_name, ' ', p_type), ' ') AS w FROM part), c AS (SELECT p_partkey, w, unnest(generate_series(1, CAST(power(2, len(w)) AS BIGINT) - 1)) AS mask FROM w), "
    "s AS (SELECT DISTINCT p_partkey, array_to_string(list_filter(w, lambda x, i: (mask // CAST(power(2, i - 1) AS BIGINT)) % 2 = 1), ' ') AS choice FROM c) "
    "SELECT p_partkey, count(*) AS n, CAST(sum(length(choice)) AS BIGINT) AS total, min(choice) AS first_choice FROM s GROUP BY p_partkey"
)
def long_name_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All choices of the words of long names, listed as rows."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    each = X.listed_choices(parts, "name")
    return each.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("choice")).alias("total"), F.min("choice").alias("first_choice"))


@query(f"WITH raw_ AS ({S.hits('documents', '(?:th|an)+', 0.9, '', 'RUN', 0)}) SELECT doc_id, count(*) AS n, CAST(sum(start_) AS BIGINT) AS sum_start, CAST(sum(end_) AS BIGINT) AS sum_end, min(value) AS first_value FROM raw_ GROUP BY doc_id")
def empty_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's pattern that also matches the empty string gives the matches that are not empty."""
    found = D.detect(table(spark, sf_dir, "documents"), Rules(()).with_recognizer("RUN", [("(?:th|an)*", 0.9)]))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"), F.min("value").alias("first_value"))


_EVERY = list(S.SAID)


def _planted(spark: SparkSession, sf_dir: str, name: str, number: Column, text: str) -> DataFrame:
    return D.detect(planted_texts(table(spark, sf_dir, name), number, F.col(text)), SECRETS)


@query(S.detection("src", _EVERY, S.planted("documents", "doc_id", "text")))
def detect_planted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all 17 kinds, one somewhere in each document."""
    return _planted(spark, sf_dir, "documents", F.col("doc_id"), "text")


@query(S.detection("src", _EVERY, S.planted("pages", "page_id", "html")))
def detect_planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all 17 kinds, one somewhere in each page, be it in a tag."""
    return _planted(spark, sf_dir, "pages", F.col("page_id"), "html")


@query(S.detection("src", _EVERY, S.planted("conversations", "conv_id * 1000 + turn", "text")))
def detect_planted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all 17 kinds, one somewhere in each turn."""
    return _planted(spark, sf_dir, "conversations", F.col("conv_id") * 1000 + F.col("turn"), "text")
