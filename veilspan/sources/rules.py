"""The rule table: which entities are looked for, how, and what a match must fulfil."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Pattern:
    """A shape with its score; ``needs`` finds something in every text that the shape matches (None: not known).

    ``checked`` is (validator, what values of the shape that pass it need as well); ``solid``, that it never matches the empty string.
    ``stricter`` is the shape without matches that its check never approves; where that check holds, it is searched in the shape's place.
    ``local`` says that a match of which a check can approve begins at most 32 characters before a word (between white space) that
    holds ``word`` (None: what it needs), and that it ends with that word or another such one.
    """

    regex: str
    score: float
    needs: str | None = None
    checked: tuple[str, str] | None = None
    solid: bool = False
    local: bool = False
    word: str | None = None
    stricter: str | None = None


@dataclass(frozen=True)
class Rule:
    entity: str
    name: str
    group: str
    patterns: tuple[Pattern, ...]
    context: tuple[str, ...] = ()
    validator: str | None = None
    guard_decimals: bool = False
    min_confidence: float = 0.6
    methods: tuple[str, ...] = ("builtin",)
    enabled: bool = True
    country: str = "US"
    output_key: str | None = None
    #: What a Python check of four arguments gets besides the entity and its threshold.
    parameters: tuple[tuple[str, Any], ...] = ()

    def check_parameters(self) -> dict[str, Any]:
        return {"entity": self.entity, "min_confidence": self.min_confidence, **dict(self.parameters)}


#: Four digits in a row, which most shapes hold.
FOUR = "[0-9]{4}"
ID, MONEY, CONTACT = "pii-identification", "pii-financial", "pii-contact"

# Entities, display names, patterns, scores and context words.  A word begins and ends at what is no ASCII letter, digit or
# underscore, an accented letter included; what \b says of those depends on the version of Java.
US_RULES = (
    Rule("US_SSN", "us-ssn", ID, (Pattern(r"[0-9](?<!\w[0-9])[0-9]{2}-?[0-9]{2}-?[0-9]{4}(?!\w)", 0.5, FOUR),), ("ssn", "social security", "taxpayer id", "social security number"), "ssn", True, output_key="SSN"),
    Rule("US_DRIVER_LICENSE", "us-drivers-license", ID, (Pattern(r"(?<!\w)[A-Za-z0-9]{7,12}(?!\w)", 0.5, "[A-Za-z0-9]{7}", ("driver_license", "[0-9](?:[A-Za-z]{0,4}[0-9]){3}"), stricter=r"(?<!\w)(?=[A-Za-z]{0,4}[0-9])[A-Za-z0-9]{8,12}(?!\w)"),), ("driver", "license", "dl", "driver's license"), "driver_license", True, output_key="DRIVER_LICENSE_NUMBER"),
    Rule("US_BANK_NUMBER", "us-bank-account-number", MONEY, (Pattern(r"(?i)(?<!\w)[0-9]{6,17}(?!\w)", 0.5, FOUR),), ("bank account", "account number", "checking", "savings"), "bank_account", True, output_key="US_BANK_NUMBER"),
    Rule("ROUTING_NUMBER", "bank-routing-number", MONEY, (Pattern(r"[0-9](?<!\w[0-9])[0-9]{8}(?!\w)", 0.5, FOUR),), ("routing", "aba", "routing number"), "no_digit_run", output_key="BANK_ROUTING_NUMBER"),
    Rule("EMAIL_ADDRESS", "email-address", CONTACT, (Pattern(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, "@"),), ("email", "contact", "email address", "contact email"), "email", output_key="EMAIL"),
    Rule("PHONE_NUMBER", "phone-number", CONTACT, (Pattern(r"\+[0-9]{1,3}[-. ]?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}", 0.6, FOUR), Pattern(r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}", 0.5, FOUR)), ("phone", "call", "contact", "mobile", "cell", "telephone", "reach at"), "phone", True, output_key="PHONE_NUMBER"),
    Rule("DATE_OF_BIRTH", "date-of-birth", ID, (Pattern(r"(?<!\w)(?:0[1-9]|[12][0-9]|3[01])[-/.](?:0[1-9]|1[0-2])[-/.][12][0-9]{3}(?!\w)", 0.85, FOUR), Pattern(r"[12](?<!\w[12])[0-9]{3}[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12][0-9]|3[01])(?!\w)", 0.85, FOUR)), ("born on", "dob", "date of birth", "birthday", "age", "born", "birth date", "born in"), "dob"),
    Rule("SERVICE_NUMBER", "service-number", ID, (Pattern(r"(?<!\w)[A-Za-z]{1,3}[0-9]{6,10}(?!\w)", 1.0, FOUR), Pattern(r"(?<!\w)[A-Za-z]{1,3}[-\s]?[0-9]{6,10}(?!\w)", 1.0, FOUR)), ("service number", "sn", "military id", "service id")),
    Rule("DOD_ID", "dodi-number", ID, (Pattern(r"(?i)(?<!\w)DOD[-\s]?[0-9]{8,12}(?!\w)", 0.95, FOUR),), ("dod id", "department of defense", "military id", "dod number")),
    Rule("VA_CLAIM_NUMBER", "va-claim-number", ID, (Pattern(r"[0-9](?<!\w[0-9])[0-9]{8}(?!\w)", 0.85, FOUR), Pattern(r"[0-9](?<!\w[0-9])[0-9]{2}\s[0-9]{3}\s[0-9]{3}(?!\w)", 0.9, r"[0-9]{3}\s[0-9]{3}", word="[0-9]{3}"), Pattern(r"[0-9](?<!\w[0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?!\w)", 0.9, FOUR)), ("va claim", "va claim number", "claim number", "va file number", "va file no", "claim #", "va benefits", "veterans affairs"), "va_claim"),
    Rule("BUSINESS_TAX_ID", "business-tax-id", ID, (Pattern(r"[0-9](?<!\w[0-9])[0-9]-[0-9]{7}(?!\w)", 0.8, FOUR), Pattern(r"[0-9](?<!\w[0-9])[0-9]{8}(?!\w)", 0.6, FOUR)), ("ein", "tax id", "tax identification", "business tax", "practice tax", "employer identification", "irs")),
    Rule("MEDICAL_LICENSE", "medical-license-number", ID, (Pattern(r"(?i)(?<!\w)(?:LIC|MD|DMC|MED)[-/]?[0-9]{4,10}(?!\w)", 1.0, FOUR),), ("medical license", "license number", "doctor license", "physician license", "medical registration")),
    Rule("EMPLOYEE_ID", "employee-id", ID, (Pattern(r"(?i)(?<!\w)(?:EMP|EID|STAFF|HR)[-_]?[0-9]{4,10}(?!\w)", 0.85, FOUR), Pattern(r"(?<!\w)[A-Za-z]{2,4}[0-9]{4,10}(?!\w)", 0.85, FOUR), Pattern(r"[A-Za-z]{2}-[0-9]{4}", 0.85, FOUR)), ("employee id", "employee code", "staff id", "staff code", "employee number", "staff number", "hr id", "personnel id", "payroll id", "employee id number")),
)

# Shapes of access tokens, off unless asked for.
SECRET_RULES = (
    Rule("github-token", "github-token", "secrets", (Pattern(r"(?<!\w)(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36,255}(?!\w)", 0.45, "gh[pousr]_"),), min_confidence=0.4),
    Rule("slack-token", "slack-token", "secrets", (Pattern(r"(?:xoxb|xoxp|xapp|xoxa|xoxr|xoxo|xoxs|xoxe)-[0-9]{10,13}-[a-zA-Z0-9-]*", 0.45, FOUR),), min_confidence=0.4),
    Rule("aws-access-key", "aws-access-key", "secrets", (Pattern(r"(?<!\w)(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}(?!\w)", 0.45, "A(?:KIA|BIA|CCA|SIA)[0-9A-Z]{16}"),), min_confidence=0.4),
    Rule("azure-key-id", "azure-key-id", "secrets", (Pattern(r"(?i)(?:azure|client|tenant|subscription).{0,20}[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", 0.45, "[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-"),), min_confidence=0.4),
)

_STRICT_EMPLOYEE = Pattern(r"(?<!\w)[A-Za-z]{2}-[0-9]{4}(?!\w)", 0.85, FOUR)


class Rules(tuple):
    """A set of rules; every method gives a new one."""

    def for_countries(self, countries: list[str] | None = None) -> Rules:
        """Rules of the countries (US if none is named); those of an unknown country are the GLOBAL ones."""
        wanted = countries or ["US"]
        known = {r.country for r in self}
        missing = [c for c in wanted if c not in known]
        if missing and "GLOBAL" not in known:
            raise ValueError(f"no rules for {', '.join(missing)}")
        chosen = {c if c in known else "GLOBAL" for c in wanted}
        return Rules(r for r in self if r.country in chosen)

    def enabled(self, methods: list[str] | None = None) -> Rules:
        return Rules(r for r in self if r.enabled and (methods is None or set(methods) & set(r.methods)))

    def only(self, *entities: str) -> Rules:
        return Rules(r for r in self if r.entity in entities)

    def with_recognizer(self, entity: str, patterns: list[tuple[str, float]], context: list[str] | None = None, validator: str | None = None, **options) -> Rules:
        """Adds a rule, or takes the place of the one for the same country and entity."""
        new = Rule(entity, options.pop("name", entity.lower().replace("_", "-")), options.pop("group", "custom"), tuple(Pattern(*p) for p in patterns), tuple(context or ()), validator, **options)
        return Rules([*(r for r in self if (r.country, r.entity) != (new.country, entity)), new])

    def with_threshold(self, min_confidence: float, *entities: str) -> Rules:
        return Rules(replace(r, min_confidence=min_confidence) if not entities or r.entity in entities else r for r in self)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per entity, for joins with spans; a few dozen rows whatever the data."""
        rows = list({r.entity: (r.country, r.entity, r.group, r.name, r.enabled, list(r.methods), r.min_confidence) for r in self}.values())
        return spark.createDataFrame(rows, "country string, entity_type string, group string, return_name string, enabled boolean, methods array<string>, min_confidence double")


def _solid(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """Marks the shapes above: each begins with letters, digits or signs that must be there, and ends in a word with what it needs."""
    return tuple(replace(r, patterns=tuple(replace(p, solid=True, local=True) for p in r.patterns)) for r in rules)


#: Rules as a table; a column that is missing, or a field that is null, means the value of Rule, but for the first four.
RULE_TABLE = (
    "country string, entity string, `group` string, patterns array<struct<regex:string, score:double, needs:string>>, name string, enabled boolean, methods array<string>, "
    "min_confidence double, validator string, guard_decimals boolean, context array<string>, output_key string, parameters map<string,string>"
)
NEEDED = ("country", "entity", "group", "patterns")
#: Methods that a rule may name; a rule table is driver data, so its size is checked.
METHODS, MOST_RULES = ("builtin", "regex", "llm"), 10_000


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """Rules as rows of RULE_TABLE, for a file that users change and read_rules() reads."""
    rows = [
        (r.country, r.entity, r.group, [(p.regex, float(p.score), p.needs) for p in r.patterns], r.name, r.enabled, list(r.methods), float(r.min_confidence), r.validator, r.guard_decimals, list(r.context), r.output_key, {k: str(v) for k, v in r.parameters})
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_TABLE)


def _table_schema(spark: SparkSession) -> StructType:
    return spark.createDataFrame([], RULE_TABLE).schema


def read_rule_table(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A table of rules, one a row, from JSON lines or Parquet; its columns and types are checked against RULE_TABLE."""
    wanted = _table_schema(spark)
    if fmt == "json":
        # Read under the schema, a field of another type would be null: what such rows say is kept and reported.
        found = spark.read.json(path).columns
        _known_columns(found, wanted)
        return spark.read.schema(StructType([*(f for f in wanted if f.name in found)]).add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").json(path)
    table = spark.read.format(fmt).load(path)
    _known_columns(table.columns, wanted)
    for f in table.schema:
        if f.dataType.simpleString() != wanted[f.name].dataType.simpleString():
            raise ValueError(f"rule table: {f.name} is {f.dataType.simpleString()}, not {wanted[f.name].dataType.simpleString()}")
    return table


def _known_columns(found: list[str], wanted: StructType) -> None:
    unknown = sorted(set(found) - set(wanted.names))
    if unknown:
        raise ValueError(f"rule table: no such field as {', '.join(unknown)}")


def _collected(table: DataFrame) -> list[dict[str, Any]]:
    rows = [r.asDict(recursive=True) for r in table.limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"rule table: more than {MOST_RULES} rules")
    for r in rows:
        if r.pop("_bad", None) is not None:
            raise ValueError(f"rule table: {r.get('country')}/{r.get('entity')}: a field is of another type than the table's")
    return rows


def _checked(spark: SparkSession, at: str, rule: Rule, validators: set[str] | None) -> Rule:
    """The rule, if all of it can be used; else an error that names the field."""
    if not 0 <= rule.min_confidence <= 1:
        raise ValueError(f"{at}: min_confidence {rule.min_confidence} is not between 0 and 1")
    odd = [m for m in rule.methods if m not in METHODS]
    if odd:
        raise ValueError(f"{at}: methods: no such method as {', '.join(odd)}")
    if rule.validator and validators is not None and rule.validator not in validators:
        raise ValueError(f"{at}: validator: no such check as {rule.validator}")
    for i, p in enumerate(rule.patterns):
        if p.score is None or not 0 <= p.score <= 1:
            raise ValueError(f"{at}: patterns[{i}].score {p.score} is not between 0 and 1")
        for field in ("regex", "needs"):
            said = getattr(p, field)
            if said is None and field == "needs":
                continue
            if not said:
                raise ValueError(f"{at}: patterns[{i}].{field} is empty")
            try:
                spark._jvm.java.util.regex.Pattern.compile(said)
            except (Py4JJavaError, IllegalArgumentException) as e:
                said = str(e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else e)
                raise ValueError(f"{at}: patterns[{i}].{field}: {said.splitlines()[0]}") from None
    return rule


def _values(row: Mapping[str, Any]) -> dict[str, Any]:
    """The fields of Rule that a row of the table gives."""
    out = {k: tuple(v) if k in ("methods", "context") else v for k, v in row.items() if v is not None and k not in ("patterns", "parameters")}
    if row.get("patterns") is not None:
        out["patterns"] = tuple(p if isinstance(p, Pattern) else Pattern(p["regex"], p["score"], p.get("needs")) if isinstance(p, Mapping) else Pattern(*p) for p in row["patterns"])
    if row.get("parameters") is not None:
        out["parameters"] = tuple(sorted(dict(row["parameters"]).items()))
    return out


def rules_from(table: DataFrame, validators: set[str] | None = None) -> Rules:
    """The rules of a table, checked one by one; of ``validators``, if given, are the names that a rule may use."""
    spark, out, seen = table.sparkSession, [], set()
    for n, row in enumerate(_collected(table)):
        at = f"rule table: {row.get('country')}/{row.get('entity')}"
        for k in NEEDED:
            if not row.get(k):
                raise ValueError(f"{at} (row {n}): {k} is missing")
        key = (row["country"], row["entity"])
        if key in seen:
            raise ValueError(f"{at}: stands in the table twice")
        seen.add(key)
        named = {"name": row["entity"].lower().replace("_", "-"), **_values(row)}
        out.append(_checked(spark, at, Rule(**named), validators))
    return Rules(out)


def overridden(rules: Rules, overrides: Mapping[tuple[str, str], Mapping[str, Any]] | DataFrame, spark: SparkSession | None = None, validators: set[str] | None = None) -> Rules:
    """Rules with some fields replaced, by (country, entity): a mapping, or a table like RULE_TABLE where null leaves a field as it is."""
    if isinstance(overrides, DataFrame):
        spark = overrides.sparkSession
        rows = _collected(overrides)
        overrides = {(r["country"], r["entity"]): {k: v for k, v in r.items() if k not in ("country", "entity") and v is not None} for r in rows}
        if len(overrides) < len(rows):
            raise ValueError("overrides: a rule stands in the table twice")
    spark = spark or SparkSession.active()
    known, out = {(r.country, r.entity) for r in rules}, []
    for key, given in overrides.items():
        if tuple(key) not in known:
            raise ValueError(f"overrides: no rule {'/'.join(map(str, key))}")
        odd = sorted(set(given) - {f.name for f in fields(Rule)} | set(given) & {"country", "entity"})
        if odd:
            raise ValueError(f"overrides: {'/'.join(map(str, key))}: no such field as {', '.join(odd)}")
    for r in rules:
        given = overrides.get((r.country, r.entity))
        out.append(r if given is None else _checked(spark, f"overrides: {r.country}/{r.entity}", replace(r, **_values(given)), validators))
    return Rules(out)


def read_rules(spark: SparkSession, path: str, fmt: str = "json", validators: set[str] | None = None) -> Rules:
    """The rules of a file or folder, JSON lines or Parquet, one rule a row of RULE_TABLE."""
    return rules_from(read_rule_table(spark, path, fmt), validators)


def load_rules(
    countries: list[str] | None = None,
    secrets: bool = False,
    strict_boundaries: bool = False,
    table: Rules | DataFrame | None = None,
    overrides: Mapping[tuple[str, str], Mapping[str, Any]] | DataFrame | None = None,
    validators: set[str] | None = None,
) -> Rules:
    """The rules of the countries; with access tokens and with word boundaries around plain employee numbers, if asked for.

    They are the built-in ones or those of ``table`` (read_rules(), or rows of RULE_TABLE), with ``overrides`` by (country, entity).
    """
    rules = (table if isinstance(table, Rules) else rules_from(table, validators)) if table is not None else _solid(US_RULES)
    rules = (*rules, *(_solid(SECRET_RULES) if secrets else ()))
    if strict_boundaries:
        rules = tuple(replace(r, patterns=(*r.patterns[:2], replace(_STRICT_EMPLOYEE, solid=True, local=True))) if r.entity == "EMPLOYEE_ID" else r for r in rules)
    out = Rules(rules) if overrides is None else overridden(Rules(rules), overrides, validators=validators)
    return out.for_countries(countries)
