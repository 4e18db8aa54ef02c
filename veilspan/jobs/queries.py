"""Registered queries of the detection, redaction, evaluation and value jobs, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validators as V
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import overlap as O
from ..operators import values as X
from ..operators.redact import redact
from ..sources.rules import Rules, load_rules
from ..sources.tables import concat_datasets, planted_records, table
from . import classification as C
from . import oracle as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RULES, SECRETS = load_rules(), load_rules(secrets=True)
GOLD = {"ssn": "us-ssn", "dob": "date-of-birth", "emp": "employee-id", "ein": "business-tax-id", "svc": "service-number", "dod": "dodi-number", "va": "va-claim-number", "lic": "medical-license-number", "email": "email-address", "phone": "phone-number"}
NAMES = {r.entity: r.name for r in SECRETS}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_records(spark, sf_dir, more=True)


REC = S.records(more=True)
_BASE = f"WITH {REC}, {S.checked('rec', S.COUNTRY)} "


def _detection(rules: Rules, source: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.detect(_records(spark, sf_dir) if source == "rec" else table(spark, sf_dir, source), rules)

    return run


for _r in RULES:
    _n = f"detect_{_r.entity.lower()}_rec"
    QUERIES[_n], ORACLES[_n] = _detection(RULES.only(_r.entity), "rec"), S.detection("rec", [_r.entity], REC)
for _e, _n in (("EMAIL_ADDRESS", "detect_email_docs"), ("PHONE_NUMBER", "detect_phone_docs")):
    QUERIES[_n], ORACLES[_n] = _detection(RULES.only(_e), "documents"), S.detection("documents", [_e])
_TOKENS = Rules(r for r in SECRETS if r.group == "secrets")
QUERIES["detect_secrets_rec"], ORACLES["detect_secrets_rec"] = _detection(_TOKENS, "rec"), S.detection("rec", S.SECRETS, REC)


@query(f"WITH {REC}, {S.checked('rec', S.COUNTRY)} SELECT entity_type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs, CAST(sum(start_) AS BIGINT) AS sum_start FROM spans GROUP BY entity_type")
def classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = D.detect(_records(spark, sf_dir), RULES)
    return spans.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"), F.sum("start").alias("sum_start"))


@query(f"WITH {REC}, raw_ AS ({S.raw('rec', S.COUNTRY)}) SELECT entity_type, pattern, base_score, score, count(*) AS n FROM raw_ GROUP BY ALL")
def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.raw_matches(_records(spark, sf_dir), RULES).groupBy("entity_type", "pattern", "base_score", "score").agg(F.count(F.lit(1)).alias("n"))


_LEAST = "(VALUES " + ", ".join(f"({S.quoted(r.entity)}, CAST({r.min_confidence} AS DOUBLE))" for r in RULES) + ") AS t(entity_type, least)"


@query(f"WITH {REC}, raw_ AS ({S.raw('rec', S.COUNTRY)}) SELECT doc_id, entity_type, start_ AS start, score FROM raw_ JOIN {_LEAST} USING (entity_type) WHERE score >= least")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.above_threshold(D.raw_matches(_records(spark, sf_dir), RULES), RULES.table(spark))
    return D.known_entities(kept, RULES.table(spark)).select("doc_id", "entity_type", "start", "score")


@query(
    f"WITH {REC}, raw_ AS ({S.raw('rec', ['US_BANK_NUMBER', 'PHONE_NUMBER'])}) SELECT doc_id, entity_type, start_ AS start, "
    f"NOT {S.IN_DECIMAL} AS whole FROM raw_"
)
def decimal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    raw = D.raw_matches(records, RULES.only("US_BANK_NUMBER", "PHONE_NUMBER")).select("doc_id", "entity_type", "start", "end")
    text = records.select("doc_id", "text")
    return raw.join(text, "doc_id").select("doc_id", "entity_type", "start", D.not_in_decimal(F.col("text"), F.col("start"), F.col("end")).alias("whole"))


@query(_BASE + "SELECT coalesce(CAST(doc_id AS VARCHAR), '(all)') AS doc, coalesce(entity_type, '(all)') AS entity, count(*) AS n FROM spans GROUP BY ROLLUP (doc_id, entity_type)")
def entity_counts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.entity_counts(D.detect(_records(spark, sf_dir), RULES))
    return n.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("(all)")).alias("doc"), F.coalesce("entity_type", F.lit("(all)")).alias("entity"), "n")


NAMED = "CASE entity_type " + " ".join(f"WHEN {S.quoted(k)} THEN {S.quoted(v)}" for k, v in NAMES.items()) + " ELSE entity_type END"


@query(_BASE + f"SELECT doc_id, {NAMED} AS entity, concat(start_, '_', end_) AS location, score AS confidence_score, value AS entity_value, start_ AS start_index, end_ AS end_index FROM spans")
def entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.entity_details(C.classify(_records(spark, sf_dir).select("doc_id", "text"), rules=RULES))
    return out.withColumn("confidence_score", F.round("confidence_score", 4))


@query(_BASE + f"SELECT {NAMED} AS entity, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM spans GROUP BY entity ORDER BY n_spans DESC, entity LIMIT 5")
def topk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_counts(D.detect(_records(spark, sf_dir), RULES), RULES).orderBy(F.desc("n_spans"), "entity").limit(5)


_MATRIX = ["ssn", "dob", "emp", "ein", "va", "phone", "email", "dl", "acct", "aba"]
_CHECKS = ["ssn", "bank_account", "routing", "email", "phone", "dob", "va_claim", "driver_license"]


@query(
    f"WITH {REC}, vals AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {k} AS value FROM v" for k in _MATRIX) + ") SELECT kind, "
    + ", ".join(f"CAST(sum(CASE WHEN {S.checks('value')[c]} THEN 1 ELSE 0 END) AS BIGINT) AS n_{c}" for c in _CHECKS)
    + ", " + ", ".join(f"CAST(sum(CASE WHEN {S.digit_run('value', k)} THEN 1 ELSE 0 END) AS BIGINT) AS n_{k}" for k in V.RUNS)
    + ", CAST(sum(length(regexp_replace(value, '[^0-9]', '', 'g'))) AS BIGINT) AS n_digits, CAST(sum(length(regexp_replace(value, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS n_letters"
    + ", count(DISTINCT upper(regexp_replace(value, '[-\\s._/,]', '', 'g'))) AS n_tokens FROM vals GROUP BY kind"
)
def validators_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.registry(D.AS_OF)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in _MATRIX]))
    vals = _records(spark, sf_dir).select("doc_id", "text", pairs.alias("p")).select("doc_id", "text", "p.*")
    v, n = F.col("value"), lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return vals.groupBy("kind").agg(
        *[n(known[c](v, F.col("text"))).alias(f"n_{c}") for c in _CHECKS],
        *[n(V.digit_run(v, k)).alias(f"n_{k}") for k in V.RUNS],
        F.sum(F.length(V.digits_only(v))).cast("long").alias("n_digits"),
        F.sum(V.count_letters(v)).cast("long").alias("n_letters"),
        F.count_distinct(V.normalize_token(v)).alias("n_tokens"),
    )


_WEIGHTED = " + ".join(f"CAST(substring(acct, {i}, 1) AS INTEGER) * {(7, 3, 1)[(i - 1) % 3]}" for i in range(1, 11))


@query(
    f"WITH {REC}, c AS (SELECT doc_id, acct, ({_WEIGHTED}) % 10 AS check_digit FROM v) SELECT doc_id, check_digit, "
    "(list_reduce(list_prepend(10, list_transform(generate_series(1, 10), lambda i: CAST(substring(lpad(acct, 11, '7'), i, 1) AS INTEGER))), "
    "lambda p, d: (CASE WHEN (d + p) % 10 = 0 THEN 10 ELSE (d + p) % 10 END * 2) % 11) + CAST(substring(lpad(acct, 11, '7'), 11, 1) AS INTEGER)) % 10 = 1 "
    "AND list_reduce(list_prepend(10, list_transform(generate_series(1, 10), lambda i: CAST(substring(lpad(acct, 11, '7'), i, 1) AS INTEGER))), "
    "lambda p, d: (CASE WHEN (d + p) % 10 = 0 THEN 10 ELSE (d + p) % 10 END * 2) % 11) <> 99 AS checks_out FROM c"
)
def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", V.mrz_check_digit(F.col("acct")).alias("check_digit"), V.valid_mod_11_10(F.lpad("acct", 11, "7")).alias("checks_out"))


_PAIRS = "SELECT a.doc_id, a.entity_type AS a_entity_type, a.start_ AS a_start, a.end_ AS a_end, b.entity_type AS b_entity_type, b.start_ AS b_start, b.end_ AS b_end FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.start_ < b.end_ AND b.start_ < a.end_ AND (a.start_, a.end_, a.entity_type) < (b.start_, b.end_, b.entity_type)"


@query(_BASE + _PAIRS)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.overlap_pairs(D.detect(_records(spark, sf_dir), RULES))


_GROUPS = (
    ", reach AS (SELECT *, max(end_) OVER (PARTITION BY doc_id ORDER BY start_, end_, entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans), "
    "grouped AS (SELECT *, CAST(sum(CASE WHEN r IS NULL OR start_ >= r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_, end_, entity_type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS overlap_group FROM reach) "
)


@query(_BASE.rstrip() + _GROUPS + 'SELECT doc_id, entity_type, start_ AS start, end_ AS "end", overlap_group FROM grouped')
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.overlap_groups(D.detect(_records(spark, sf_dir), RULES)).select("doc_id", "entity_type", "start", "end", "overlap_group")


def _greedy(order: str) -> str:
    return _BASE.rstrip() + f", {S.kept(order)} SELECT doc_id, x.t AS entity_type, x.s AS start, x.e AS \"end\" FROM k"


@query(_greedy("{'s': start_, 'e': end_, 't': entity_type}"))
def non_overlap_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.non_overlapping(D.detect(_records(spark, sf_dir), RULES)).select("doc_id", "entity_type", "start", "end")


@query(_greedy(S.BEST))
def non_overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.non_overlapping(D.detect(_records(spark, sf_dir), RULES), best=True).select("doc_id", "entity_type", "start", "end")


@query(_BASE.rstrip() + f", {S.redaction('rec')} SELECT doc_id, data, CAST(n AS INTEGER) AS n_spans FROM whole")
def redact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact(D.with_spans(_records(spark, sf_dir).select("doc_id", "text"), RULES))
    return out.select("doc_id", "data", F.size("details").alias("n_spans"))


_EMAIL = RULES.only("EMAIL_ADDRESS")


@query(
    "SELECT doc_id, replace(replace(regexp_replace(replace(replace(text, '<', chr(1)), '>', chr(2)), "
    + S.quoted(S.SAID["EMAIL_ADDRESS"][0][0][0])
    + ", '&lt;EMAIL_ADDRESS&gt;', 'g'), chr(1), '&lt;'), chr(2), '&gt;') AS data FROM documents"
)
def redact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(D.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), _EMAIL)).select("doc_id", "data")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.col(k).alias("value")) for k, name in GOLD.items()]))
    spans = records.select(F.col("doc_id").alias("row_id"), "text", pairs.alias("p")).select("row_id", "text", "p.*")
    start = F.instr("text", F.col("value")) - 1
    return spans.select("row_id", "label", "value", start.cast("int").alias("start"), (start + F.length("value")).cast("int").alias("end"))


def _predicted(spark: SparkSession, sf_dir: str, label: str | None = None) -> DataFrame:
    """Predictions of all labels, or of one: entities are merged each by itself, so rules of others need not be searched."""
    rules = RULES if label is None else Rules(r for r in RULES if r.name == label)
    spans = D.with_display_name(D.detect(_records(spark, sf_dir), rules), rules.table(spark))
    return spans.where(F.col("return_name").isin(list(GOLD.values()))).select(F.col("doc_id").alias("row_id"), F.col("return_name").alias("label"), "value", "start", "end")


_EVAL = (
    _BASE.rstrip()
    + ", gold AS ("
    + " UNION ALL ".join(f"SELECT doc_id AS row_id, '{name}' AS label, {k} AS value, strpos(text, {k}) - 1 AS s, strpos(text, {k}) - 1 + length({k}) AS e FROM rec" for k, name in GOLD.items())
    + f"), pred AS (SELECT doc_id AS row_id, {NAMED} AS label, value, start_ AS s, end_ AS e FROM spans WHERE {NAMED} IN {S.listed(list(GOLD.values()))}), "
    "m AS (SELECT coalesce(g.row_id, p.row_id) AS row_id, coalesce(g.label, p.label) AS label, coalesce(g.value, p.value) AS value, g.row_id IS NOT NULL AS g, p.row_id IS NOT NULL AS p "
    "FROM (SELECT DISTINCT row_id, label, value FROM gold) g FULL JOIN (SELECT DISTINCT row_id, label, value FROM pred) p ON g.row_id = p.row_id AND g.label = p.label AND g.value = p.value), "
    "n AS (SELECT label AS entity_type, count(*) FILTER (g) AS actual_count, count(DISTINCT row_id) FILTER (g) AS support, count(*) FILTER (g AND p) AS correct, count(*) FILTER (NOT g AND p) AS extra, count(*) FILTER (g AND NOT p) AS missed, CAST(0 AS BIGINT) AS wrong FROM m GROUP BY label), "
    "r AS (SELECT *, coalesce(correct / nullif(correct + extra + missed, 0), 0) AS accuracy, coalesce(correct / nullif(correct + extra, 0), 0) AS precision, coalesce(correct / nullif(correct + missed, 0), 0) AS recall FROM n), "
    "metrics AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r) "
)
_SCORES = ("accuracy", "precision", "recall", "f1")


@query(_EVAL + "SELECT entity_type, actual_count, support, correct, extra, missed, wrong, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SCORES) + " FROM metrics")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.entity_metrics(_gold(spark, sf_dir), _predicted(spark, sf_dir))
    return m.withColumns({c: F.round(c, 6) for c in _SCORES})


@query(_EVAL + "SELECT " + ", ".join(f"round(avg({c}), 6) AS macro_{c}" for c in _SCORES) + " FROM metrics")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.macro_average(E.entity_metrics(_gold(spark, sf_dir), _predicted(spark, sf_dir)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(_EVAL + "SELECT entity_type, round(f1, 6) AS f1 FROM metrics WHERE f1 > 0 ORDER BY metrics.f1 DESC, entity_type LIMIT 4")
def eval_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.ranked_metrics(E.entity_metrics(_gold(spark, sf_dir), _predicted(spark, sf_dir)), only_found=True, k=4)
    return m.select("entity_type", F.round("f1", 6).alias("f1"))


def _unmatched_sql(a: str, b: str, label: str) -> str:
    return _EVAL + f"SELECT doc_id AS row_id FROM rec WHERE doc_id IN (SELECT x.row_id FROM {a} x WHERE x.label = '{label}' AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.row_id = x.row_id AND y.label = x.label AND (y.value = x.value OR (y.s = x.s AND y.e = x.e))))"


@query(_unmatched_sql("pred", "gold", "employee-id"))
def extra_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select(F.col("doc_id").alias("row_id"))
    return E.rows_with_extra(rows, _gold(spark, sf_dir), _predicted(spark, sf_dir, "employee-id"), "employee-id")


@query(_unmatched_sql("gold", "pred", "date-of-birth"))
def missed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select(F.col("doc_id").alias("row_id"))
    return E.rows_with_missed(rows, _gold(spark, sf_dir), _predicted(spark, sf_dir, "date-of-birth"), "date-of-birth")


@query(_EVAL + "SELECT DISTINCT label, value FROM m WHERE g AND NOT p")
def missed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.matched_pairs(_gold(spark, sf_dir), _predicted(spark, sf_dir))
    return m.where("in_gold AND NOT in_predicted").select("label", "value").distinct()


@query(_EVAL + "SELECT row_id, count(*) FILTER (g AND p) AS correct, count(*) FILTER (NOT g AND p) AS extra, count(*) FILTER (g AND NOT p) AS missed FROM m GROUP BY row_id")
def pair_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = lambda df, name: df.groupBy("row_id").agg(F.collect_set(F.struct("label", "value")).alias(name))
    joined = both(_gold(spark, sf_dir), "gold").join(both(_predicted(spark, sf_dir), "pred"), "row_id", "full_outer")
    none = F.array().cast("array<struct<label:string,value:string>>")
    sets = joined.select("row_id", E.pair_sets(F.coalesce("gold", none), F.coalesce("pred", none)).alias("s"))
    return sets.select("row_id", *[F.size(f"s.{c}").cast("long").alias(c) for c in ("correct", "extra", "missed")])


@query("SELECT text, CAST(n_chars AS VARCHAR) AS mapped_output FROM documents UNION ALL SELECT text, role AS mapped_output FROM conversations")
def concat_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", F.col("n_chars").cast("string").alias("mapped_output"))
    return concat_datasets(docs, table(spark, sf_dir, "conversations").select("text", F.col("role").alias("mapped_output")))


@query(
    "WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), n AS (SELECT "
    + ", ".join(f"count(*) - count({c}) AS {c}" for c in ("doc_id", "lang", "quality", "toxic"))
    + " FROM j) "
    + " UNION ALL ".join([f"SELECT '{c}' AS \"column\", {c} AS nulls FROM n" for c in ("doc_id", "lang", "quality", "toxic")] + ["SELECT 'total' AS \"column\", doc_id + lang + quality + toxic AS nulls FROM n"])
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return E.null_profile(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic"))


@query(f"WITH {REC} SELECT doc_id AS row_id, label, value, s AS start FROM (SELECT doc_id, 'SSN' AS label, ssn AS value, 3 AS s FROM v UNION ALL SELECT doc_id, 'EMAIL', email, 7 FROM v) WHERE doc_id % 7 <> 0")
def parse_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lists of dictionaries, curly quotes and all; every seventh cannot be read and gives nothing."""
    item = lambda label, col, s: F.format_string(f"{{'start': {s}, 'end': {s + 5}, 'label': ‘{label}’, 'extracted_text': '%s'}}", col)
    printed = F.concat(F.lit("["), item("SSN", "ssn", 3), F.lit(", "), item("EMAIL", "email", 7), F.when(F.col("doc_id") % 7 == 0, F.lit(", oops")).otherwise(F.lit("]")))
    # The outer form: for the inner one Spark would test the list first, and so parse it again for each test.
    flat = _records(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.explode_outer(E.parse_entities(printed)).alias("e")).where("e is not null")
    return flat.select("row_id", "e.label", F.col("e.extracted_text").alias("value"), "e.start")


@query(_BASE + f"SELECT doc_id AS row_id, {NAMED} AS label, start_ AS start, end_ AS \"end\", value AS extracted_text FROM spans")
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.classify(_records(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text"), rules=RULES)
    return E.response_entities(out)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's fenced answer per record: right, repeated, blank and made-up values; every eleventh is broken."""
    body = F.format_string('```json\n{"SSN": ["%s", "", "000"], "EMAIL": ["%s", "%s"], "PHONE_NUMBER": ["%s"], "NONE": ["x"]%s\n```', "ssn", "email", "email", "phone", F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.lit("}")))
    return _records(spark, sf_dir).select("doc_id", X.parse_model_json(body).alias("answer"))


_ANSWERS = (
    f"WITH {REC}, a AS (SELECT * FROM rec WHERE doc_id % 11 <> 0), vals AS (SELECT doc_id, text, 'SSN' AS label, 0 AS k, 0 AS pos, ssn AS value FROM a UNION ALL SELECT doc_id, text, 'SSN', 0, 1, '' FROM a UNION ALL SELECT doc_id, text, 'SSN', 0, 2, '000' FROM a "
    "UNION ALL SELECT doc_id, text, 'EMAIL', 1, 0, email FROM a UNION ALL SELECT doc_id, text, 'EMAIL', 1, 1, email FROM a UNION ALL SELECT doc_id, text, 'PHONE_NUMBER', 2, 0, phone FROM a UNION ALL SELECT doc_id, text, 'NONE', 3, 0, 'x' FROM a) "
)


@query(_ANSWERS + "SELECT doc_id, label, pos, value FROM vals")
def parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.listed_values(_answers(spark, sf_dir)).select("doc_id", "label", "pos", "value")


@query(
    _ANSWERS
    + ", f AS (SELECT doc_id, k, pos, CASE label WHEN 'SSN' THEN 'US_SSN' WHEN 'EMAIL' THEN 'EMAIL_ADDRESS' ELSE label END AS entity_type, strpos(text, value) - 1 AS s, strpos(text, value) - 1 + length(value) AS e FROM vals WHERE label <> 'NONE' AND trim(value) <> '' AND strpos(text, value) > 0), "
    "l AS (SELECT doc_id, list({'k': k, 'p': pos, 's': s, 'e': e, 't': entity_type}) AS l FROM f GROUP BY doc_id), "
    "x AS (SELECT doc_id, unnest(list_reduce(list_prepend([], list_transform(list_sort(l), lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.s < x[1].e AND x[1].s < t.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM l) "
    "SELECT doc_id, x.t AS entity_type, CAST(x.s AS INTEGER) AS start, CAST(x.e AS INTEGER) AS \"end\", CAST(0.8 AS DOUBLE) AS score FROM x"
)
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.map_values(_records(spark, sf_dir), X.listed_values(_answers(spark, sf_dir)), RULES)


@query(
    f"WITH {REC}, vals AS (SELECT doc_id, text, 'phone_number' AS label, phone AS value FROM rec UNION ALL SELECT doc_id, text, 'email', upper(email) FROM rec UNION ALL SELECT doc_id, text, 'ssn', ssn FROM rec WHERE {S.checks('ssn')['ssn']} UNION ALL SELECT doc_id, text, 'bank_account_number', acct FROM rec WHERE NOT {S.digit_run('acct')}), "
    "p AS (SELECT doc_id, label, text, value, string_split(lower(text), lower(value)) AS p FROM vals), i AS (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM p) "
    "SELECT doc_id, label, CAST(s AS INTEGER) AS start, CAST(s + length(value) AS INTEGER) AS \"end\", substring(text, s + 1, length(value)) AS extracted_text "
    "FROM (SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(value) AS BIGINT) AS s FROM i)"
)
def match_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    values = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), v.alias("value")) for label, v in (("contact_number", F.col("phone")), ("EMAIL", F.upper("email")), ("us_ssn", F.col("ssn")), ("us_bank_number", F.col("acct")), ("nothing", F.col("email")))]))
    return X.match_values(records, records.select("doc_id", values.alias("v")).select("doc_id", "v.*"))


_CHOICES = "[[1], [2], [3], [1, 2], [1, 3], [2, 3], [1, 2, 3]]"


@query(
    "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), c AS (SELECT p_partkey, w, unnest(generate_series(1, CAST(power(2, least(len(w), 8)) AS BIGINT) - 1)) AS mask FROM w), "
    "s AS (SELECT DISTINCT p_partkey, array_to_string(list_filter(w, lambda x, i: (mask // CAST(power(2, i - 1) AS BIGINT)) % 2 = 1), ' ') AS choice FROM c) "
    "SELECT p_partkey, count(*) AS n, max(length(choice)) AS longest, CAST(sum(length(choice)) AS BIGINT) AS total, min(choice) AS first_choice FROM s GROUP BY p_partkey"
)
def name_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "part").select("p_partkey", F.explode(X.name_subsequences(F.col("p_name"))).alias("choice"))
    return each.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("choice")).cast("long").alias("longest"), F.sum(F.length("choice")).alias("total"), F.min("choice").alias("first_choice"))


@query(
    _BASE.rstrip()
    + _GROUPS.rstrip()
    + ", sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, overlap_group) AS n FROM grouped) SELECT doc_id, entity_type, start_ AS start, end_ AS \"end\" FROM sized WHERE n = 1 OR entity_type IN ('MEDICAL_LICENSE', 'DOD_ID') OR (entity_type = 'US_SSN' AND doc_id % 2 = 0)"
)
def verdict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts come as a JSON list of maps, the last of which counts."""
    records = _records(spark, sf_dir)
    raw = F.format_string('[{"US_SSN": "Correct", "MEDICAL_LICENSE": "Incorrect"}, {"MEDICAL_LICENSE": "CORRECT", "DOD_ID": "correct", "US_SSN": "%s"}]', F.when(F.col("doc_id") % 2 == 0, F.lit("correct")).otherwise(F.lit("Incorrect")))
    verdicts = records.select("doc_id", F.explode(X.merge_verdicts(raw)).alias("entity_type", "verdict"))
    return X.judged(D.detect(records, RULES), verdicts).select("doc_id", "entity_type", "start", "end")
