"""DuckDB SQL that says the same as the detection jobs.  What the rules must find is written out here a second time, by hand."""

from __future__ import annotations

from collections.abc import Sequence

from ..sources.tables import MORE, NOTE, PLANTED, PLANTED_TEXT, RECORD

# Fixed values, apart from those of the rule table: shapes with scores, context words, check, decimal guard, threshold.
SAID: dict[str, tuple[list[tuple[str, float]], str, str | None, bool, float]] = {
    "US_SSN": ([(r"\b\d{3}-?\d\d-?\d{4}\b", 0.5)], "ssn|social security|taxpayer id|social security number", "ssn", True, 0.6),
    "US_DRIVER_LICENSE": ([(r"(?i)\b[a-z\d]{7,12}\b", 0.5)], "driver|license|dl|driver's license", "driver_license", True, 0.6),
    "US_BANK_NUMBER": ([(r"\b\d{6,17}\b", 0.5)], "bank account|account number|checking|savings", "bank_account", True, 0.6),
    "ROUTING_NUMBER": ([(r"\b\d{9}\b", 0.5)], "routing|aba|routing number", "no_digit_run", False, 0.6),
    "EMAIL_ADDRESS": ([(r"(?i)[a-z\d._%+-]+@[a-z\d-]+(?:\.[a-z\d-]+)*\.[a-z]{2,}", 1.0)], "email|contact|email address|contact email", "email", False, 0.6),
    "PHONE_NUMBER": ([(r"\+\d{1,3}[-. ]?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}", 0.6), (r"\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}", 0.5)], "phone|call|contact|mobile|cell|telephone|reach at", "phone", True, 0.6),
    "DATE_OF_BIRTH": (
        [(r"\b(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[012])[-/.][12]\d{3}\b", 0.85), (r"\b[12]\d{3}[-/.](?:0[1-9]|1[012])[-/.](?:0[1-9]|[12]\d|3[01])\b", 0.85)],
        "born on|dob|date of birth|birthday|age|born|birth date|born in",
        "dob",
        False,
        0.6,
    ),
    "SERVICE_NUMBER": ([(r"(?i)\b[a-z]{1,3}\d{6,10}\b", 1.0), (r"(?i)\b[a-z]{1,3}(?:-|[ \t\n\x0B\f\r])?\d{6,10}\b", 1.0)], "service number|sn|military id|service id", None, False, 0.6),
    "DOD_ID": ([(r"(?i)\bdod(?:-|[ \t\n\x0B\f\r])?\d{8,12}\b", 0.95)], "dod id|department of defense|military id|dod number", None, False, 0.6),
    "VA_CLAIM_NUMBER": (
        [(r"\b\d{9}\b", 0.85), (r"\b\d{3}[ \t\n\x0B\f\r]\d{3}[ \t\n\x0B\f\r]\d{3}\b", 0.9), (r"\b\d{3}-\d\d-\d{4}\b", 0.9)],
        "va claim|va claim number|claim number|va file number|va file no|claim #|va benefits|veterans affairs",
        "va_claim",
        False,
        0.6,
    ),
    "BUSINESS_TAX_ID": ([(r"\b\d\d-\d{7}\b", 0.8), (r"\b\d{9}\b", 0.6)], "ein|tax id|tax identification|business tax|practice tax|employer identification|irs", None, False, 0.6),
    "MEDICAL_LICENSE": ([(r"(?i)\b(?:lic|md|dmc|med)[-/]?\d{4,10}\b", 1.0)], "medical license|license number|doctor license|physician license|medical registration", None, False, 0.6),
    "EMPLOYEE_ID": (
        [(r"(?i)\b(?:emp|eid|staff|hr)[-_]?\d{4,10}\b", 0.85), (r"(?i)\b[a-z]{2,4}\d{4,10}\b", 0.85), (r"(?i)[a-z][a-z]-\d{4}", 0.85)],
        "employee id|employee code|staff id|staff code|employee number|staff number|hr id|personnel id|payroll id|employee id number",
        None,
        False,
        0.6,
    ),
    "github-token": ([(r"\bgh[pousr]_[a-zA-Z\d]{36,255}\b", 0.45)], "", None, False, 0.4),
    "slack-token": ([(r"(?:xox[bpaeors]|xapp)-\d{10,13}-[a-zA-Z\d-]*", 0.45)], "", None, False, 0.4),
    "aws-access-key": ([(r"\bA(?:KIA|BIA|CCA|SIA)[\dA-Z]{16}\b", 0.45)], "", None, False, 0.4),
    "azure-key-id": ([(r"(?i)(?:azure|client|tenant|subscription)[^\n\r\x{85}\x{2028}\x{2029}]{0,20}[a-f\d]{8}-[a-f\d]{4}-[a-f\d]{4}-[a-f\d]{4}-[a-f\d]{12}", 0.45)], "", None, False, 0.4),
}
SECRETS = ["github-token", "slack-token", "aws-access-key", "azure-key-id"]
COUNTRY = [e for e in SAID if e not in SECRETS]
# Five digits in a row that rise, fall or repeat.
RUNS = {
    "increasing": "01234|12345|23456|34567|45678|56789",
    "decreasing": "98765|87654|76543|65432|54321|43210",
    "repeated": "00000|11111|22222|33333|44444|55555|66666|77777|88888|99999",
}

DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def digit_run(v: str, kind: str | None = None) -> str:
    return f"(regexp_matches({v}, '^[0-9]+$') AND regexp_matches({v}, '{RUNS[kind] if kind else '|'.join(RUNS.values())}'))"


def checks(v: str) -> dict[str, str]:
    d = DIGITS.format(v=v)
    date = f"CAST(coalesce(try_strptime(translate({v}, './', '--'), '%d-%m-%Y'), try_strptime(translate({v}, './', '--'), '%Y-%m-%d')) AS DATE)"
    at = lambda i: f"coalesce(try_cast(substring({d}, {i}, 1) AS INTEGER), 0)"
    total = f"(({at(1)} + {at(4)} + {at(7)}) * 3 + ({at(2)} + {at(5)} + {at(8)}) * 7 + {at(3)} + {at(6)} + {at(9)})"
    letters = f"length(regexp_replace({v}, '[^\\p{{L}}]', '', 'g'))"
    return {
        "ssn": f"(length({d}) = 9 AND NOT regexp_matches({d}, '^(000|666|9)') AND substring({d}, 4, 2) <> '00' AND substring({d}, 6, 4) <> '0000' AND {d} NOT IN ('078051120', '219099999', '457555462'))",
        "bank_account": f"(length({d}) BETWEEN 6 AND 17 AND length({v}) <= 15 AND NOT regexp_matches({v}, '[A-Za-z]') AND NOT {digit_run(v)})",
        "routing": f"(length({d}) = 9 AND {total} % 10 = 0 AND {total} > 0)",
        "no_digit_run": f"(NOT {digit_run(v)})",
        "email": f"(contains({v}, '@') AND contains({v}, '.'))",
        "phone": f"(length({v}) BETWEEN 7 AND 30 AND NOT {digit_run(v)})",
        "dob": f"coalesce({date} <= DATE '2024-01-01' AND 2024 - year({date}) <= 120, false)",
        "va_claim": f"(length({d}) = 9 AND {d} NOT IN ('123456789', '987654321', '000000000') AND replace({d}, left({d}, 1), '') <> '')",
        "driver_license": f"(length({v}) >= 8 AND regexp_matches({v}, '[0-9]') AND {letters} <= 4 AND NOT {digit_run(v)})",
    }


def records(more: bool = False) -> str:
    """CTEs v (planted values) and rec (doc_id, text and the values)."""
    values = ", ".join(f"{x} AS {k}" for k, x in PLANTED.items())
    text = f"concat({RECORD}, {MORE})" if more else RECORD
    return f"v AS (SELECT c_custkey, c_custkey AS doc_id, {values} FROM customer), rec AS (SELECT *, {text} AS text FROM v)"


def planted(source: str, number: str, text: str) -> str:
    """CTE src (doc_id, text): planted_texts() of a table."""
    values = ", ".join(f"{x} AS {k}" for k, x in PLANTED.items())
    return f"pv AS (SELECT *, {values} FROM (SELECT {number} AS c_custkey, {text} AS raw FROM {source})), pn AS (SELECT *, {NOTE} AS note FROM pv), src AS (SELECT c_custkey AS doc_id, {PLANTED_TEXT} AS text FROM pn)"


def hits(source: str, shape: str, score: float, words: str, entity: str, i: int) -> str:
    """(doc_id, text, entity_type, pattern, start_, end_, base_score, score, value) of one shape."""
    rx = quoted(shape)
    sizes = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    start = f"{sizes.format('p[1:i]')} + {sizes.format('m[1:i - 1]')}"
    near = "lower(substring(text, greatest(start_ - 60, 0) + 1, least(start_, 60)))"
    lifted = f"CASE WHEN regexp_matches({near}, {quoted(f'(^|[^a-z])({words})($|[^a-z])')}) THEN least(1.0, greatest({score} + 0.35, 0.4)) ELSE {score} END" if words else str(score)
    return (
        f"SELECT doc_id, text, {quoted(entity)} AS entity_type, {i} AS pattern, start_, start_ + length(value) AS end_, CAST({score} AS DOUBLE) AS base_score, CAST(round({lifted}, 4) AS DOUBLE) AS score, value FROM "
        f"(SELECT doc_id, text, CAST({start} AS INTEGER) AS start_, m[i] AS value FROM (SELECT doc_id, text, m, p, unnest(generate_series(1, len(m))) AS i FROM "
        f"(SELECT doc_id, text, regexp_extract_all(text, {rx}) AS m, string_split_regex(text, {rx}) AS p FROM {source})))"
    )


def raw(source: str, entities: Sequence[str]) -> str:
    return " UNION ALL ".join(hits(source, shape, score, SAID[e][1], e, i) for e in entities for i, (shape, score) in enumerate(SAID[e][0]))


#: Whether a digit, or a point after or before one, touches a value.
IN_DECIMAL = (
    "((start_ > 0 AND regexp_matches(substring(text, start_, 1), '[0-9]')) OR (start_ > 1 AND substring(text, start_, 1) = '.' AND regexp_matches(substring(text, start_ - 1, 1), '[0-9]')) "
    "OR regexp_matches(substring(text, end_ + 1, 1), '[0-9]') OR (substring(text, end_ + 1, 1) = '.' AND regexp_matches(substring(text, end_ + 2, 1), '[0-9]')))"
)


def merged(passing: str) -> str:
    """CTEs ok_ and spans of rows that pass: without those inside a span of no lower score."""
    return (
        f"ok_ AS ({passing}), "
        "spans AS (SELECT * FROM ok_ s WHERE NOT EXISTS (SELECT 1 FROM ok_ t WHERE t.doc_id = s.doc_id AND t.entity_type = s.entity_type AND t.start_ <= s.start_ AND t.end_ >= s.end_ "
        "AND ((t.end_ - t.start_ > s.end_ - s.start_ AND t.score >= s.score) OR (t.end_ - t.start_ = s.end_ - s.start_ AND t.score > s.score))))"
    )


def checked(source: str, entities: Sequence[str]) -> str:
    """CTEs raw_, ok_ and spans: (doc_id, entity_type, start_, end_, score, value) that pass and are merged."""
    own = checks("value")

    def passes(e: str) -> str:
        _, _, check, guard, least = SAID[e]
        return f"(entity_type = {quoted(e)} AND score >= {least}" + (f" AND {own[check]}" if check else "") + (f" AND NOT {IN_DECIMAL}" if guard else "") + ")"

    passing = f"SELECT DISTINCT doc_id, entity_type, start_, end_, score, value FROM raw_ WHERE {' OR '.join(map(passes, entities))}"
    return f"raw_ AS ({raw(source, entities)}), {merged(passing)}"


def detection(source: str, entities: Sequence[str], ctes: str = "") -> str:
    return f'WITH {ctes + ", " if ctes else ""}{checked(source, entities)} SELECT doc_id, entity_type, start_ AS start, end_ AS "end", score, value FROM spans'


def kept(order: str) -> str:
    """CTEs l and k: of a document's spans, taken in ``order`` (a struct with s, e, t), those that overlap none taken before, as x."""
    taken = "list_reduce(list_prepend([], list_transform(list_sort(l), lambda x: [x])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.s < x[1].e AND x[1].s < t.e)) > 0 THEN acc ELSE list_concat(acc, x) END)"
    return f"l AS (SELECT doc_id, list({order}) AS l FROM spans GROUP BY doc_id), k AS (SELECT doc_id, unnest({taken}) AS x FROM l)"


#: The order of redaction: score and length falling, start, entity.
BEST = "{'a': -score, 'b': start_ - end_, 's': start_, 't': entity_type, 'e': end_, 'v': value}"


def redaction(source: str) -> str:
    """CTEs after spans: l, k, marks (kept spans with the escaped gap before and the places in the new text), whole (doc_id, data)."""
    escaped = lambda x: f"replace(replace({x}, '<', '&lt;'), '>', '&gt;')"
    by = "OVER (PARTITION BY k.doc_id ORDER BY x.s"
    return (
        f"{kept(BEST)}, g AS (SELECT k.doc_id, text, x.s AS s, x.e AS e, x.t AS t, x.v AS v, -x.a AS score, {escaped(f'substring(text, coalesce(lag(x.e) {by}), 0) + 1, x.s - coalesce(lag(x.e) {by}), 0))')} AS gap, "
        f"concat('&lt;', x.t, '&gt;') AS mark FROM k JOIN {source} USING (doc_id)), "
        "marks AS (SELECT *, CAST(sum(length(gap) + length(mark)) OVER (PARTITION BY doc_id ORDER BY s) AS INTEGER) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS back FROM g), "
        f"body AS (SELECT doc_id, string_agg(concat(gap, mark), '' ORDER BY s) AS front, max(e) AS last, count(*) AS n FROM marks GROUP BY doc_id), "
        f"whole AS (SELECT doc_id, concat(coalesce(front, ''), {escaped('substring(text, coalesce(last, 0) + 1)')}) AS data, coalesce(n, 0) AS n FROM {source} LEFT JOIN body USING (doc_id))"
    )
