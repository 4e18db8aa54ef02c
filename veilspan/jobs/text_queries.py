"""More registered queries: all rules over the tables of texts, own rules and checks, labelled data, streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validators as V
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import values as X
from ..sources.folders import new_folder
from ..sources.rules import Rules
from ..sources.tables import ENTITY, planted_records, read_json_corpus, read_labelled, table, write_results
from ..streaming.classify import classify_stream, read_texts
from . import classification as C
from . import oracle as S
from .queries import NAMED, REC, RULES, SECRETS, query

_EVERY = list(S.SAID)
_PAGES = "src AS (SELECT page_id AS doc_id, html AS text FROM pages)"
_TURNS = "src AS (SELECT concat(conv_id, '_', turn) AS doc_id, text FROM conversations)"


@query(S.detection("documents", _EVERY))
def detect_all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(table(spark, sf_dir, "documents"), SECRETS)


@query(S.detection("src", _EVERY, _PAGES))
def detect_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), SECRETS)


@query(S.detection("src", _EVERY, _TURNS))
def detect_all_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("doc_id"), "text"), SECRETS)


_PLACES = f"SELECT doc_id, {NAMED} AS entity, concat(b - length(mark), '_', b) AS location, score AS confidence_score, v AS entity_value, CAST(b - length(mark) AS INTEGER) AS start_index, b AS end_index FROM (SELECT *, t AS entity_type FROM marks)"


@query(f"WITH {S.checked('documents', _EVERY)}, {S.redaction('documents')} {_PLACES}")
def classify_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API-shaped result over all documents, redacted, as rows of details."""
    out = C.entity_details(C.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=SECRETS, anonymize=True))
    return out.withColumn("confidence_score", F.round("confidence_score", 4))


@query(f"WITH {S.checked('documents', _EVERY)}, {S.redaction('documents')} SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 400 ELSE 200 END AS status, CASE WHEN text IS NULL THEN '' ELSE data END AS data FROM whole JOIN documents USING (doc_id)")
def redact_all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=SECRETS, anonymize=True).select("doc_id", "status", "data")


@query(f"WITH {REC}, {S.checked('rec', S.COUNTRY)}, {S.redaction('rec')} {_PLACES}")
def redacted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all 13 entities in the redacted text."""
    out = C.entity_details(C.classify(planted_records(spark, sf_dir, more=True).select("doc_id", "text"), rules=RULES, anonymize=True))
    return out.withColumn("confidence_score", F.round("confidence_score", 4))


_ROW_RULES = RULES.only("EMAIL_ADDRESS", "US_SSN").with_recognizer("RATE", [(r"\bRate [0-9]\b", 0.9)], country="XX")


@query(
    f"WITH {REC}, src AS (SELECT *, CASE WHEN doc_id % 40 = 5 THEN 'none' WHEN doc_id % 4 = 2 THEN 'XX' WHEN doc_id % 4 = 3 THEN 'both' ELSE 'US' END AS c FROM rec), {S.checked('rec', ['EMAIL_ADDRESS', 'US_SSN'])}, "
    "f AS (SELECT doc_id, CASE entity_type WHEN 'US_SSN' THEN 'us-ssn' ELSE 'email-address' END AS name, value FROM spans JOIN src USING (doc_id) WHERE c IN ('US', 'both') "
    "UNION ALL SELECT doc_id, 'rate', 'Rate 1' FROM src WHERE c IN ('XX', 'both')) "
    "SELECT src.doc_id, CASE c WHEN 'none' THEN 400 ELSE 200 END AS status, coalesce(string_agg(name || '=' || value, ',' ORDER BY name), '') AS found FROM src LEFT JOIN f USING (doc_id) GROUP BY src.doc_id, c"
)
def row_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row names its countries; one without rules is an error of that row alone."""
    n = F.col("doc_id")
    named = F.when(n % 40 == 5, F.array(F.lit("YY"))).when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, F.array(F.lit("US"))).when(n % 4 == 2, F.array(F.lit("XX"))).otherwise(F.array(F.lit("XX"), F.lit("US")))
    out = C.classify(planted_records(spark, sf_dir, more=True).select("doc_id", "text", named.alias("country_list")), countries=F.col("country_list"), rules=_ROW_RULES)
    shown = F.transform(F.array_sort(F.map_entries("entityDetails")), lambda e: F.concat_ws("=", e["key"], F.get(e["value"], 0)["entity_value"]))
    return out.select("doc_id", "status", F.array_join(shown, ",").alias("found"))


@query(S.detection("rec", ["EMAIL_ADDRESS", "DOD_ID"], REC))
def enabled_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of another method and one that is switched off find nothing."""
    kinds = {"US_SSN": {"methods": ("llm",)}, "PHONE_NUMBER": {"enabled": False}}
    rules = Rules(replace(r, **kinds.get(r.entity, {})) for r in RULES.only("US_SSN", "PHONE_NUMBER", "EMAIL_ADDRESS", "DOD_ID"))
    return D.detect(planted_records(spark, sf_dir, more=True), rules.enabled(["builtin"]))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' OR turn % 4 = 1 THEN 400 ELSE 200 END AS status FROM conversations")
def missing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the user without a text, and some of the others with an empty one."""
    text = F.when(F.col("role") == "user", F.lit(None)).when(F.col("turn") % 4 == 1, "").otherwise("x")
    return C.split_valid(table(spark, sf_dir, "conversations").withColumn("text", text)).select("conv_id", "turn", "status")


_OWN = "[b-df-hj-np-tv-z]{2,}e[drs]"


@query(f"WITH raw_ AS ({S.hits('documents', _OWN, 0.3, 'of the|in the', 'WORD', 0)}) SELECT doc_id, entity_type, start_ AS start, end_ AS \"end\", score, value FROM raw_ WHERE score >= 0.6 AND length(value) % 2 = 0")
def own_recognizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's rule without digits, with context and a user's check that gives null where it doesn't hold."""
    rules = Rules(()).with_recognizer("WORD", [(_OWN, 0.3)], ["of the", "in the"], "even_length")
    return D.detect(table(spark, sf_dir, "documents"), rules, validators={"even_length": lambda v, t: F.when(F.length(v) % 2 == 0, True)})


_GROUP = "[0-9a-fA-F]{1,4}"
_SIX = "|".join([f"({_GROUP}:){{7}}{_GROUP}", f"({_GROUP}:){{1,7}}:", *[f"({_GROUP}:){{1,{7 - n}}}(:{_GROUP}){{1,{n}}}" for n in range(1, 7)], f":(:{_GROUP}){{1,7}}"])
_RUN = S.digit_run("value")
_N_DIGITS = "length(regexp_replace(value, '[^0-9]', '', 'g'))"
_N_LETTERS = "length(regexp_replace(value, '[^\\p{L}]', '', 'g'))"
_PLAIN = f"NOT regexp_matches(value, '[A-Za-z]') AND NOT {_RUN}"
_AREA = "substring(value, 4, 2)"
#: label: (value from a customer's key k, name and segment, what DuckDB must say of it)
_LABELLED = {
    "us_itin": ("concat('9', lpad(cast(k % 100 as string), 2, '0'), lpad(cast(k * 7 % 100 as string), 2, '0'), lpad(cast(k % 9999 as string), 4, '0'))", f"{_PLAIN} AND length(value) = 9 AND ({_AREA} BETWEEN '50' AND '65' OR {_AREA} BETWEEN '70' AND '88' OR {_AREA} BETWEEN '90' AND '92' OR {_AREA} BETWEEN '94' AND '99')"),
    "ipv4": ("concat(cast(k % 300 as string), '.', cast(k * 7 % 290 as string), '.1.', cast(k % 40 as string))", "length(value) > 6 AND regexp_matches(value, '^((25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$')"),
    "ipv6": ("concat(case k % 7 when 0 then '2001:db8::' when 1 then '1:2:3:4:5:6:7:' when 2 then ':1:2:3::' when 3 then '1::2::3:' when 4 then '1:2:3:4:5:6:7:8:' when 5 then '::ffff:' else 'g001::1:' end, cast(k % 9000 as string))", f"length(value) > 6 AND regexp_matches(value, '^({_SIX})$')"),
    "contact_name": ("concat(case k % 3 when 0 then 'Jo' when 1 then 'R2D2 ' else 'Jane Q ' end, substring(segment, 1, cast(k % 6 as int)))", "length(value) > 5 AND length(regexp_replace(value, '[^0-9]', '', 'g')) < 3"),
    "date_of_birth": ("concat(lpad(cast(k % 33 as string), 2, '0'), case k % 2 when 0 then '/' else '.' end, lpad(cast(k % 14 as string), 2, '0'), case k % 2 when 0 then '/' else '.' end, cast(1950 + k % 60 as string))", "regexp_matches(text, '(?i)né\\(e\\) le|geb\\. *datum|f\\.n\\.') AND coalesce(try_strptime(translate(value, './', '--'), '%d-%m-%Y'), try_strptime(translate(value, './', '--'), '%m-%d-%Y')) IS NOT NULL"),
    "api_key": ("concat(substring(segment, 1, cast(k % 9 as int)), case k % 4 when 0 then 'x' else cast(k as string) end)", "length(value) >= 8 AND regexp_matches(value, '[0-9]')"),
    "medical_record_number": ("case k % 2 when 0 then segment else concat(segment, cast(k as string)) end", "regexp_matches(value, '[0-9]')"),
    "license_plate_number": ("case k % 3 when 0 then segment else cast(k as string) end", "regexp_matches(value, '[0-9]')"),
    "credit_card": ("lpad(cast(k * 7919 as string), cast(9 + k % 13 as int), '40')", f"{_PLAIN} AND {_N_DIGITS} BETWEEN 12 AND 19"),
    "us_bank_number": ("lpad(cast(k * 7919 as string), cast(4 + k % 14 as int), '70')", f"{_PLAIN} AND {_N_DIGITS} BETWEEN 6 AND 15"),
    "us_passport": ("concat(substring(segment, 1, cast(k % 7 as int)), lpad(cast(k * 31 as string), 6, '0'))", f"length(value) >= 8 AND regexp_matches(value, '[0-9]') AND {_N_LETTERS} <= 4 AND NOT {_RUN}"),
    "iban_code": ("concat('DE', lpad(cast(k * 31 as string), cast(4 + k % 20 as int), '0'))", f"length(value) >= 8 AND regexp_matches(value, '[0-9]') AND NOT {_RUN}"),
    "routing_number": ("lpad(cast(k * 141650939 % 1000000000 as string), 9, '0')", f"NOT {_RUN}"),
    "nothing": ("segment", "true"),
}
_NOTE = "case k % 5 when 0 then 'Né(e) le' when 1 then 'GEB. DATUM' when 2 then 'F.N.' when 3 then 'meeting' else 'geb.  Datum' end"
_BY_LABEL = " UNION ALL ".join(f"SELECT k, '{label}' AS label, value, coalesce({check}, false) AS valid FROM (SELECT k, {value} AS value, text FROM c)" for label, (value, check) in _LABELLED.items())


@query(f"WITH c AS (SELECT c_custkey AS k, c_mktsegment AS segment, {_NOTE} AS text FROM customer) {_BY_LABEL}")
def checks_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of each label, under one of its other names, on good and bad values."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")).withColumn("text", F.expr(_NOTE))
    each = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.expr(value).alias("value")) for label, (value, _) in _LABELLED.items()]))
    rows = c.select("k", "text", each.alias("v")).select("k", "text", "v.*")
    return rows.select("k", "label", "value", V.validate_extracted(F.col("label"), F.col("value"), F.col("text")).alias("valid"))


def _entity(label: str, value: Column) -> Column:
    return F.struct(F.lit(0).alias("start"), F.length(value).alias("end"), F.lit(label).alias("label"), value.alias("extracted_text"))


@query(f"WITH {REC} SELECT doc_id AS row_id, label, value FROM (SELECT doc_id, 'SSN' AS label, ssn AS value FROM v UNION SELECT doc_id, 'ssn', ssn FROM v UNION SELECT doc_id, 'EMAIL', email FROM v)")
def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a row, with repeats and blanks around them, each once."""
    ssn, email = F.col("ssn"), F.col("email")
    entities = F.array(_entity("SSN", ssn), _entity(" SSN", F.concat(ssn, F.lit("  "))), _entity("ssn", ssn), _entity("EMAIL", email), _entity("EMAIL", email))
    return E.entity_pairs(planted_records(spark, sf_dir, more=True).select(F.col("doc_id").alias("row_id"), entities.alias("e")), "e")


@query(f"WITH {REC} SELECT doc_id AS row_id, label, value FROM (SELECT doc_id, 'ssn' AS label, ssn AS value FROM v UNION ALL SELECT doc_id, 'SSN', phone FROM v)")
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold that was something else becomes the predictions of one label, in any case."""
    records = planted_records(spark, sf_dir, more=True)
    predicted = F.array(_entity("ssn", F.col("ssn")), _entity("EMAIL", F.col("email")), _entity("SSN", F.col("phone")))
    rows = records.select(F.col("doc_id").alias("row_id"), F.array(_entity("SSN", F.col("acct"))).alias("mapped_output"), predicted.alias("classification_results"))
    return E.relabel_from_predictions(rows, "Ssn").select("row_id", F.explode("mapped_output").alias("e")).select("row_id", "e.label", F.col("e.extracted_text").alias("value"))


@query(f"WITH {REC} SELECT fmt, doc_id AS row_id, text, label, value FROM rec, (VALUES ('csv'), ('json'), ('parquet')) AS f(fmt), LATERAL (SELECT 'SSN' AS label, ssn AS value UNION ALL SELECT 'EMAIL', email)")
def labelled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled records written in each format, read again under the schema; in CSV entities are printed lists with quotes and commas."""
    records = planted_records(spark, sf_dir, more=True)
    entities = F.array(_entity("SSN", F.col("ssn")), _entity("EMAIL", F.col("email"))).cast(f"array<{ENTITY}>")
    rows, out = records.select(F.col("doc_id").alias("row_id"), "text", entities.alias("mapped_output")), None
    for fmt in ("csv", "json", "parquet"):
        path = new_folder(spark)
        if fmt == "csv":
            printed = F.translate(F.to_json("mapped_output"), '"', "'")
            rows.withColumn("mapped_output", printed).write.options(header="true", quote='"', escape='"').csv(path)
        else:
            write_results(rows, path, fmt)
        part = read_labelled(spark, path, fmt).select(F.lit(fmt).alias("fmt"), "row_id", "text", F.explode("mapped_output").alias("e"))
        part = part.select("fmt", "row_id", "text", "e.label", F.col("e.extracted_text").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {REC} SELECT text, label, value FROM rec, LATERAL (SELECT 'SSN' AS label, ssn AS value UNION ALL SELECT 'EMAIL', email)")
def json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in files of a hundred, each one JSON list, read as a corpus."""
    entities = F.array(_entity("SSN", F.col("ssn")), _entity("EMAIL", F.col("email"))).cast(f"array<{ENTITY}>")
    items = planted_records(spark, sf_dir, more=True).select(F.floor(F.col("doc_id") / 100).alias("part"), F.struct(F.col("text").alias("Text"), entities.alias("Entities")).alias("item"))
    path = new_folder(spark)
    items.groupBy("part").agg(F.to_json(F.collect_list("item")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json_corpus(spark, path).select("text", F.explode("mapped_output").alias("e")).select("text", "e.label", F.col("e.extracted_text").alias("value"))


@query(f"WITH {S.checked('documents', ['EMAIL_ADDRESS', 'PHONE_NUMBER'])} SELECT doc_id, {NAMED} AS entity, concat(start_, '_', end_) AS location, score AS confidence_score, value AS entity_value, start_ AS start_index, end_ AS end_index FROM spans")
def stream_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents classified as they arrive, read from the table that the stream appends to."""
    path = new_folder(spark)
    # A glob, as a stream takes a table of one file by no plain name; where the table is a folder, its files are read.
    texts = read_texts(spark, f"{sf_dir}/{{documents}}.parquet")
    classify_stream(texts, path, f"{path}-state", once=True, rules=RULES.only("EMAIL_ADDRESS", "PHONE_NUMBER")).awaitTermination()
    return C.entity_details(spark.read.schema("doc_id long, status int, data string, entityDetails map<string, array<" + C.DETAIL + ">>").parquet(path)).withColumn("confidence_score", F.round("confidence_score", 4))


_NAME = "concat(p_name, ' Maria Josefa Carmen ', p_type, ' Dolores Fernandez Garcia')"
_SIGNED = "concat('Signed by ', p_name, ' carmen garcia; Josefa ', lower(p_type), ' FERNANDEZ, Garcia Maria and ', upper(p_name), ' maria josefa carmen.')"


@query(
    f"WITH n AS (SELECT p_partkey AS doc_id, string_split({_NAME}, ' ') AS w, {_SIGNED} AS text FROM part), c AS (SELECT doc_id, text, w, unnest(generate_series(1, CAST(power(2, len(w)) AS BIGINT) - 1)) AS mask FROM n), "
    "f AS (SELECT DISTINCT doc_id, text, array_to_string(list_filter(w, lambda x, i: (mask // CAST(power(2, i - 1) AS BIGINT)) % 2 = 1), ' ') AS form FROM c), "
    "p AS (SELECT doc_id, text, form, string_split(lower(text), lower(form)) AS p FROM f WHERE length(form) > 5 AND contains(lower(text), lower(form))), i AS (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM p), "
    "spans AS (SELECT doc_id, text, length(form) AS n, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(form) AS BIGINT) AS s FROM i), "
    + S.kept("{'n': -n, 's': s, 'e': s + n}")
    + " "
    "SELECT doc_id, 'name' AS label, CAST(x.s AS INTEGER) AS start, CAST(x.e AS INTEGER) AS \"end\", substring(text, x.s + 1, x.e - x.s) AS extracted_text FROM k JOIN n USING (doc_id)"
)
def match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nine words and more, found by any choice of their words in order."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_NAME).alias("value"), F.expr(_SIGNED).alias("text"))
    return X.match_values(parts, parts.select("doc_id", F.lit("contact_name").alias("label"), "value"))
