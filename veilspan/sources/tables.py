"""Reading and writing the tables that jobs work on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CLOSE, STAND_IN, let, pieces_of, without_mark
from .json_lists import read_json_list

ENTITY = "struct<start:int, `end`:int, label:string, extracted_text:string>"
LABELLED = f"row_id long, text string, mapped_output array<{ENTITY}>"

#: Values planted per customer, as expressions that Spark and DuckDB read alike.
PLANTED = {
    "ssn": "concat(lpad(cast(c_custkey % 899 + 1 as string),3,'0'),'-',lpad(cast(c_custkey % 99 + 1 as string),2,'0'),'-',lpad(cast(c_custkey % 9999 + 1 as string),4,'0'))",
    "dob": "concat(lpad(cast(c_custkey % 28 + 1 as string),2,'0'),'/',lpad(cast(c_custkey % 12 + 1 as string),2,'0'),'/',cast(1900 + c_custkey % 140 as string))",
    "emp": "concat('EMP-',lpad(cast(c_custkey * 7919 % 100000 as string),5,'0'))",
    "ein": "concat(lpad(cast(c_custkey % 90 + 10 as string),2,'0'),'-',lpad(cast(c_custkey * 104729 % 10000000 as string),7,'0'))",
    "svc": "concat('A',lpad(cast(c_custkey * 15485863 % 100000000 as string),8,'0'))",
    "dod": "concat('DOD-',lpad(cast(c_custkey * 32452843 % 1000000000 as string),10,'0'))",
    "va": "concat(lpad(cast(c_custkey * 49979687 % 1000 as string),3,'0'),' ',lpad(cast(c_custkey % 1000 as string),3,'0'),' ',lpad(cast(c_custkey * 31 % 1000 as string),3,'0'))",
    "lic": "concat('LIC-',lpad(cast(c_custkey * 6700417 % 1000000 as string),6,'0'))",
    "email": "concat('user',cast(c_custkey as string),'@mail.example.com')",
    "phone": "concat('(555) 555-',lpad(cast(c_custkey % 10000 as string),4,'0'))",
    "dl": "concat('D',lpad(cast(c_custkey * 86028121 % 10000000 as string),7,'0'))",
    "acct": "lpad(cast(c_custkey * 122949823 % 10000000000 as string),10,'0')",
    "aba": "lpad(cast(c_custkey * 141650939 % 1000000000 as string),9,'0')",
    "tok": "concat('ghp_',lpad(cast(c_custkey as string),36,'a'))",
    "aws": "concat('AKIA',lpad(cast(c_custkey as string),16,'Z'))",
}
RECORD = (
    "concat('Customer record ',cast(c_custkey as string),'. SSN: ',ssn,'. Date of birth: ',dob,'. Employee ID: ',emp,'. EIN: ',ein,'. Service number: ',svc,'. ',dod,'. VA claim number: ',va,"
    "'. Medical license: ',lic,'. Email: ',email,'. Phone: ',phone,'.')"
)
#: A second sentence, for entities that the first one lacks.
MORE = "concat(' Driver license ',dl,'. Checking account number ',acct,'. ABA routing ',aba,'. Rate 1.',acct,'. Token ',tok,' and ',aws,'.')"


#: One sentence for each kind of identifier, with the values above.
NOTES = [
    "concat('SSN: ', ssn)", "concat('driver license ', dl)", "concat('checking account number ', acct)", "concat('ABA routing ', aba)", "concat('Email: ', email)", "concat('mobile phone ', phone)",
    "concat('born on ', dob)", "concat('service number ', svc)", "dod", "concat('VA claim number ', va)", "concat('EIN ', ein)", "concat('Medical license ', lic)", "concat('Employee ID ', emp)", "tok", "aws",
    "concat('xoxb-', lpad(cast(c_custkey as string), 11, '1'), '-', emp)", "concat('tenant id ', lpad(cast(c_custkey as string), 8, '0'), '-0000-4000-8000-', lpad(cast(c_custkey as string), 12, '0'))",
]
NOTE = f"case c_custkey % {len(NOTES)} " + " ".join(f"when {i} then {n}" for i, n in enumerate(NOTES)) + " end"
#: The sentence somewhere in a text, by the row's number.
PLANTED_TEXT = "concat(substring(coalesce(raw, ''), 1, cast(c_custkey * 7919 % (length(coalesce(raw, '')) + 1) as int)), ' ', note, ' ', substring(coalesce(raw, ''), cast(c_custkey * 7919 % (length(coalesce(raw, '')) + 1) as int) + 1))"


def planted_texts(texts: DataFrame, number: Column, text: Column) -> DataFrame:
    """(doc_id, text): every text with one sentence that holds an identifier, whose kind and place the row's number tells."""
    values = texts.select(number.cast("long").alias("c_custkey"), text.alias("raw")).select("c_custkey", "raw", *[F.expr(x).alias(k) for k, x in PLANTED.items()])
    return values.withColumn("note", F.expr(NOTE)).select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.expr(PLANTED_TEXT))).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planted_records(spark: SparkSession, sf_dir: str, more: bool = False) -> DataFrame:
    """(doc_id, text, planted values): one record per customer."""
    # Keys alone are dealt to all cores: a small file is a single partition, and what follows is work for the processor.
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")
    values = keys.select(F.col("c_custkey"), F.col("c_custkey").alias("doc_id"), *[F.expr(x).alias(k) for k, x in PLANTED.items()])
    text = F.expr(f"concat({RECORD}, {MORE})" if more else RECORD)
    # A generated row is computed once; a projected text would be put together anew wherever a later expression reads it.
    return values.select("doc_id", F.explode(F.array(text)).alias("text"), *PLANTED)


#: What quotes enclose in a printed list, each with its own kind of quote; a backslash keeps the next character from ending it.
PRINTED_STRING = r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|[‘’][^’\\]*+(?:\\.[^’\\]*+)*+’"
#: Names of constants, and escapes that JSON writes otherwise.
CONSTANTS = {"None": "null", "True": "true", "False": "false"}
ESCAPES = {r"\\x([0-9A-Fa-f]{2})": r"\\u00$1", r"\\U0000([0-9A-Fa-f]{4})": r"\\u$1", r"\\a": r"\\u0007", r"\\v": r"\\u000b", r"\\0": r"\\u0000"}


def _json_string(token: Column) -> Column:
    """A printed string, quotes and all, as JSON: only its own kind of quote ended it, so others inside are plain characters."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    body = F.replace(inner, F.lit("\\\\"), F.lit(CLOSE))
    for quote in ("'", '"', "’"):
        body = F.replace(body, F.lit("\\" + quote), F.lit(quote))
    for escape, said in ESCAPES.items():
        body = F.regexp_replace(body, escape, said)
    # A backslash before any other letter is a backslash; names of characters and numbers beyond four digits stay unreadable.
    body = F.regexp_replace(F.replace(body, F.lit('"'), F.lit('\\"')), r'\\(?!["/bfnrtuUN])', r"\\\\")
    # Most strings have no backslash, and nothing but quotes to escape.
    plain = F.replace(inner, F.lit('"'), F.lit('\\"'))
    said = F.when(F.contains(token, F.lit("\\")), F.replace(body, F.lit(CLOSE), F.lit("\\\\"))).otherwise(plain)
    return F.concat(F.lit('"'), said, F.lit('"'))


def _json_between(piece: Column) -> Column:
    """What stands between strings, as JSON: constants by their names there, no comma before a closing bracket."""
    named = piece
    for name, said in CONSTANTS.items():
        named = F.regexp_replace(named, rf"\b{name}\b", said)
    closed = lambda x: F.regexp_replace(x, r",(\s*[\]}])", "$1")
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(piece, F.lit(x)) for x in parts])
    return F.when(has(*CONSTANTS), closed(named)).when(has(",") & has("]", "}"), closed(piece)).otherwise(piece)


def printed_as_json(text: Column) -> Column:
    """A printed Python list or dictionary as JSON; a text that is JSON already stays as it is."""
    parts = lambda p: F.transform(p, lambda x, i: F.when(i % 2 == 1, _json_string(x)).otherwise(_json_between(x)))
    clean = lambda t: F.when(F.contains(t, F.lit(CLOSE)), F.translate(t, CLOSE, STAND_IN)).otherwise(t)
    return let(let(without_mark(text), clean), lambda clean: F.array_join(let(pieces_of(clean, PRINTED_STRING), parts), ""))


def gold(text: Column) -> Column:
    """struct<entities, readable>: the entities of a printed list of dictionaries, or of JSON.

    Any quotes may stand in a value that another kind encloses.  A null or blank text is no gold and readable; one that is no list, or not
    as a whole, has no entities and is not readable.
    """
    none = F.array().cast(f"array<{ENTITY}>")

    # Bound, text and list are computed once, however often they are read here and whatever expression the text is.
    def read(text: Column) -> Column:
        blank = text.isNull() | (F.trim(text) == "")
        parsed = F.from_json(printed_as_json(text), f"array<{ENTITY}>", {"allowUnquotedControlChars": "true"})
        entities = lambda e: F.when(blank, none).otherwise(F.coalesce(F.filter(e, lambda x: x.isNotNull()), none))
        readable = lambda e: F.coalesce(blank | (e.isNotNull() & ~F.exists(e, lambda x: x.isNull())), F.lit(False))
        return let(F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), parsed), lambda e: F.struct(entities(e).alias("entities"), readable(e).alias("readable")))

    return let(text, read)


def parse_entities(text: Column) -> Column:
    """array<ENTITY> from a printed list of dictionaries; what cannot be read is an empty array."""
    return gold(text)["entities"]


def read_labelled(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = LABELLED, readable: str | None = None) -> DataFrame:
    """Texts with their gold entities, as Parquet, JSON or CSV with a header line, under the schema (None: the files' own).

    Entities may be arrays or printed lists, which are parsed.  ``readable`` names a column that says whether a row and its
    entities could be read, so that rows without entities are told from those whose entities are lost.
    """
    if not schema:
        return spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(path)
    fields = spark.createDataFrame([], schema).schema.fields
    nested = {f.name for f in fields if f.dataType.typeName() == "array"}
    if fmt in ("csv", "json"):
        bad = "_unreadable"
        flat = ", ".join([*(f"`{f.name}` {'string' if f.name in nested else f.dataType.simpleString()}" for f in fields), f"{bad} string"])
        options = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'} if fmt == "csv" else {}
        rows = spark.read.schema(flat).options(columnNameOfCorruptRecord=bad, **options).format(fmt).load(path)
        fine = F.col(bad).isNull()
    else:
        own = {f.name: f.dataType.typeName() for f in spark.read.format(fmt).load(path).schema}
        flat = ", ".join(f"`{f.name}` {'string' if f.name in nested and own.get(f.name) == 'string' else f.dataType.simpleString()}" for f in fields)
        rows, fine = spark.read.schema(flat).format(fmt).load(path), F.lit(True)
        nested = {c for c in nested if own.get(c) == "string"}
    if not nested:
        out = rows.withColumn(readable, fine) if readable else rows
        return out.select(*[f.name for f in fields], *([readable] if readable else []))
    # A generated row is parsed once, however many of its fields are read.
    parsed = rows.select("*", F.explode(F.array(F.struct(*[gold(F.col(c)).alias(c) for c in sorted(nested)]))).alias("__gold"))
    flag = [reduce(lambda a, b: a & b, [fine, *(F.col(f"__gold.{c}.readable") for c in sorted(nested))]).alias(readable)] if readable else []
    return parsed.select(*[F.col(f"__gold.{f.name}.entities").alias(f.name) if f.name in nested else F.col(f.name) for f in fields], *flag)


def readable_rows(rows: DataFrame, readable: str, quarantine: str | None = None, entities: str = "mapped_output") -> tuple[DataFrame, Observation]:
    """(the rows that could be read, counts), of rows that read_labelled() has flagged.

    The others are appended to ``quarantine``, if given, as JSON.  The counts are observed while the rows are used, in one pass:
    n_rows, n_unreadable, n_empty (readable, without entities) and n_entities of readable rows.
    """
    if quarantine:
        rows.where(~F.col(readable)).write.mode("append").json(quarantine)
    counts = Observation()
    fine, n = F.col(readable), lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    size = F.coalesce(F.size(F.col(entities)), F.lit(0))
    seen = rows.observe(counts, F.count(F.lit(1)).alias("n_rows"), n(~fine).alias("n_unreadable"), n(fine & (size == 0)).alias("n_empty"), n(F.when(fine, size).otherwise(0)).alias("n_entities"))
    return seen.where(readable).drop(readable), counts


def read_json_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """[{Text, Entities}] as (text, mapped_output); one large file is read by all tasks."""
    rows = read_json_list(spark, path, f"Text string, Entities array<{ENTITY}>")
    return rows.select(F.col("Text").alias("text"), F.col("Entities").alias("mapped_output"))


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite", only_partitions: bool = False) -> None:
    """Writes a table; with ``only_partitions``, overwriting replaces the partitions that df has rows of and leaves the others."""
    writer = df.write.mode(mode).format(fmt)
    if only_partitions:
        if not partition_by:
            raise ValueError("only_partitions needs partition_by")
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def concat_datasets(*datasets: DataFrame) -> DataFrame:
    """All rows of (text, mapped_output); gold given as arrays becomes JSON."""
    out = None
    for d in datasets:
        kind = d.schema["mapped_output"].dataType.typeName()
        gold = F.to_json("mapped_output") if kind == "array" else F.col("mapped_output")
        part = d.select("text", gold.alias("mapped_output"))
        out = part if out is None else out.unionByName(part)
    return out
