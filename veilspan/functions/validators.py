"""Checks of extracted values, as boolean columns; a null or unparsable value is never valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Validator = Callable[[Column, Column, str], Column]

# Published numbers that were never assigned to a person; test numbers of claims; names of labels.
NEVER_ISSUED_SSN = ["078051120", "219099999", "457555462"]
TEST_CLAIMS = ["123456789", "987654321", "000000000"]
LABELS = {
    "iban": "iban",
    "ssn": "ssn",
    "passport_number": "passport_number",
    "passport": "passport_number",
    "driver_license_number": "driver_license_number",
    "credit_card_number": "credit_card_number",
    "name": "name",
    "company_name": "company",
    "street_address": "street_address",
    "email": "email",
    "phone_number": "phone_number",
    "date_of_birth": "date_of_birth",
    "bank_routing_number": "bank_routing_number",
    "bank_account_number": "bank_account_number",
    "swift_bic_code": "swift_bic_code",
    "api_key": "api_key",
    "private_keys": "private_keys",
    "bank_name": "company",
    "hospital_name": "company",
    "company_address": "street_address",
    "us-itin": "itin",
    "itin": "itin",
    "ip_address": "ip_address",
    "bban": "bban",
    "address": "street_address",
    "treating_physician": "name",
    "surgeon": "name",
    "contact_number": "phone_number",
    "ipv6": "ip_address",
    "ipv4": "ip_address",
    "provider_email": "email",
    "reference_contact_number": "phone_number",
    "residential_address": "street_address",
    "reference_name": "name",
    "contact_telephone_number": "phone_number",
    "contact_name": "name",
    "contact_ipv6_address": "ip_address",
    "person": "name",
    "us_ssn": "ssn",
    "us_passport": "passport_number",
    "us_driver_license": "driver_license_number",
    "email_address": "email",
    "llm_person": "name",
    "llm_organization": "company",
    "credit_card": "credit_card_number",
    "us_bank_number": "bank_account_number",
    "iban_code": "iban",
    "us_itin": "itin",
    "routing_number": "bank_routing_number",
    "swift_code": "swift_bic_code",
    "bban_code": "bban",
    "medical_record_number": "medical_record_number",
    "health_insurance_number": "health_insurance_number",
    "vehicle_vin": "vehicle_vin",
    "license_plate_number": "license_plate_number",
}
# Words for birth, English, German, French, Spanish, Finnish, Dutch and Swedish.
BIRTH_WORDS = [
    "Birth", "DOB", "Birthdate", "Born", "D.O.B.",
    "Geburtsdatum", "Geburtstag", "geboren am", "Geb. Datum",
    "Date de naissance", "DDN", "Né(e) le", "Date de n.",
    "Fecha de nacimiento", "F.N.", "Nacimiento", "Nacido el", "Fecha nacimiento", "Fecha de n.",
    "Syntymäaika", "Syntymäpäivä", "Syntymä", "Syntynyt",
    "Geboortedatum", "Geboren op", "Geboorte", "Geb. datum",
    "Födelsedatum", "Född den", "Födelsedag", "Född", "F.d.",
]
DATE_FORMATS = ["dd-MM-yyyy", "yyyy-MM-dd", "MM-dd-yyyy", "d MMMM yyyy", "MMMM d, yyyy"]

#: Five neighbouring digits that rise or fall by one, or repeat.
RUNS = {
    "increasing": ["".join(str(d + k) for k in range(5)) for d in range(6)],
    "decreasing": ["".join(str(d - k) for k in range(5)) for d in range(4, 10)],
    "repeated": [str(d) * 5 for d in range(10)],
}


def birth_regex() -> str:
    """Any of the words, in any case; words are apart by any white space, which a point before makes optional."""
    quoted = ["".join("\\" + c if c in ".()" else c for c in w) for w in BIRTH_WORDS]
    return "(?iu)(?:" + "|".join(w.replace(". ", ".\\s*").replace(" ", "\\s+") for w in quoted) + ")"


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def has_letters(value: Column) -> Column:
    return value.rlike("[A-Za-z]")


def count_letters(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"\p{L}"))


def has_any_digit(value: Column) -> Column:
    return value.rlike("[0-9]")


def digit_run(value: Column, kind: str | None = None) -> Column:
    """Whether a value that is all digits holds a run of five (of one kind, or of any)."""
    runs = RUNS[kind] if kind else [r for rs in RUNS.values() for r in rs]
    return value.rlike("^[0-9]+$") & value.rlike("|".join(runs))


def valid_dob(value: Column, as_of: str) -> Column:
    """A calendar date, day or year first, not after as_of and at most 120 years before."""
    plain = F.translate(value, "./", "--")
    date = F.coalesce(F.try_to_date(plain, "dd-MM-yyyy"), F.try_to_date(plain, "yyyy-MM-dd"))
    now = F.lit(as_of).cast("date")
    return F.coalesce((date <= now) & (F.year(now) - F.year(date) <= 120), F.lit(False))


def valid_va_claim(value: Column) -> Column:
    d = digits_only(value)
    return (F.length(d) == 9) & ~d.isin(TEST_CLAIMS) & (F.replace(d, F.left(d, F.lit(1)), F.lit("")) != "")


def valid_ssn(value: Column) -> Column:
    d = digits_only(value)
    return (F.length(d) == 9) & ~d.rlike("^(000|666|9)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000") & ~d.isin(NEVER_ISSUED_SSN)


def valid_itin(value: Column) -> Column:
    """Nine digits from 9, with a group number of 50-65, 70-88, 90-92 or 94-99."""
    d = digits_only(value)
    group = F.substring(d, 4, 2).try_cast("int")
    return F.coalesce((F.length(d) == 9) & d.startswith("9") & (group.between(50, 65) | group.between(70, 88) | group.between(90, 92) | group.between(94, 99)), F.lit(False))


def valid_bank_account(value: Column) -> Column:
    return (F.length(digits_only(value)).between(6, 17)) & (F.length(value) <= 15) & ~has_letters(value) & ~digit_run(value)


def valid_routing(value: Column) -> Column:
    """The 3-7-1 checksum of a nine-digit routing number."""
    d = digits_only(value)
    at = lambda i: F.coalesce(F.substring(d, i, 1).try_cast("int"), F.lit(0))
    total = (at(1) + at(4) + at(7)) * 3 + (at(2) + at(5) + at(8)) * 7 + at(3) + at(6) + at(9)
    return (F.length(d) == 9) & (total % 10 == 0) & (total > 0)


def valid_phone(value: Column) -> Column:
    return F.length(value).between(7, 30) & ~digit_run(value)


def valid_email(value: Column) -> Column:
    return value.contains("@") & value.contains(".")


def valid_length_for(label: Column, value: Column) -> Column:
    """Enough digits and not too many, by canonical label."""
    n = F.length(digits_only(value))
    return F.when(label == "ssn", (n == 9) & valid_ssn(value)).when(label == "itin", (n == 9) & valid_itin(value)).when(label == "credit_card_number", n.between(12, 19)).when(label == "phone_number", n.between(7, 30)).when(label == "bank_account_number", n.between(6, 15)).otherwise(True)


def valid_document_id(label: Column, value: Column) -> Column:
    short_letters = ~label.isin("passport_number", "driver_license_number") | (count_letters(value) <= 4)
    runs = ~label.isin("iban", "bban", "passport_number", "driver_license_number", "bank_routing_number") | ~digit_run(value)
    return (F.length(value) >= 8) & has_any_digit(value) & short_letters & runs


def valid_ip(value: Column) -> Column:
    """Four numbers up to 255, or eight groups of hexadecimal digits, fewer where :: stands once for groups of zeros; over six long."""
    numbers = F.transform(F.split(value, "[.]"), lambda p: p.try_cast("int"))
    four = value.rlike("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$") & F.forall(numbers, lambda n: n <= 255)
    groups = F.filter(F.split(value, ":"), lambda g: g != "")
    zeros = F.size(F.split(value, "::")) - 1
    whole = (zeros == 0) & (F.size(groups) == 8) & ~value.rlike("^:|:$")
    short = (zeros == 1) & (F.size(groups) <= 7) & ~value.rlike(":::|^:[^:]|[^:]:$")
    six = value.rlike("^[0-9A-Fa-f:]+$") & F.forall(groups, lambda g: F.length(g) <= 4) & (whole | short)
    return (F.length(value) > 6) & (four | six)


def valid_name(value: Column) -> Column:
    return (F.length(value) > 5) & (F.regexp_count(value, F.lit("[0-9]")) < 3)


def mentions_birth(text: Column) -> Column:
    return text.rlike(birth_regex())


def valid_birth_date(value: Column, text: Column, mentioned: Column | None = None) -> Column:
    """A date of eight characters or more in a text that mentions birth (``mentioned``, where that is known already)."""
    plain = F.translate(value, "./", "--")
    parsed = F.coalesce(*[F.try_to_date(plain, f) for f in DATE_FORMATS])
    return (F.length(value) >= 8) & (mentions_birth(text) if mentioned is None else mentioned) & parsed.isNotNull()


def valid_api_key(value: Column) -> Column:
    return (F.length(value) >= 8) & has_any_digit(value)


def canonical_label(label: Column) -> Column:
    """One name for the many that sources use; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.lower(label))


def validate_extracted(label: Column, value: Column, text: Column, mentioned: Column | None = None) -> Column:
    """The check that belongs to a label, whatever its alias; labels without one pass."""
    c = canonical_label(label)
    numeric = ~has_letters(value) & valid_length_for(c, value) & ~digit_run(value)
    return F.coalesce(
        F.when(c == "ip_address", valid_ip(value))
        .when(c == "email", valid_email(value))
        .when(c == "name", valid_name(value))
        .when(c == "date_of_birth", valid_birth_date(value, text, mentioned))
        .when(c.isin("ssn", "itin", "credit_card_number", "phone_number", "bank_account_number"), numeric)
        .when(c.isin("iban", "bban", "driver_license_number", "passport_number"), valid_document_id(c, value))
        .when(c == "bank_routing_number", ~digit_run(value))
        .when(c == "api_key", valid_api_key(value))
        .when(c.isin("health_insurance_number", "medical_record_number", "license_plate_number"), has_any_digit(value))
        .otherwise(True),
        F.lit(False),
    )


def normalize_token(value: Column, chars: str = r"[ \t\r\n\-._/,\\]") -> Column:
    return F.upper(F.regexp_replace(value, chars, ""))


def mrz_check_digit(value: Column) -> Column:
    """Weights 7, 3, 1 in turn, modulo 10; -1 if a character is neither digit, capital nor <."""
    places = F.sequence(F.lit(1), F.length(value))
    code = lambda i: F.ascii(F.substring(value, i, F.lit(1)))
    worth = lambda i: F.when(code(i) == 60, 0).when(code(i) < 65, code(i) - 48).otherwise(code(i) - 55)
    weight = lambda i: F.when(i % 3 == 1, 7).when(i % 3 == 2, 3).otherwise(1)
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + worth(i) * weight(i))
    return F.when(value == "", 0).when(value.rlike("^[0-9A-Z<]+$"), total % 10).otherwise(-1)


def valid_mod_11_10(value: Column) -> Column:
    """ISO 7064 MOD 11,10 over eleven digits."""
    digit = lambda i: F.substring(value, i, F.lit(1)).cast("int")

    def step(p: Column, i: Column) -> Column:
        s = (digit(i) + p) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    p = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(10), step)
    return F.coalesce(F.when(value.rlike("^[0-9]{11}$"), (11 - p) % 10 == F.substring(value, 11, 1).cast("int")), F.lit(False))


def registry(as_of: str) -> dict[str, Validator]:
    """Named checks of (value, text); a user's own function, plain or wrapped by pandas_udf, can be added."""
    return {
        "ssn": lambda v, t: valid_ssn(v),
        "bank_account": lambda v, t: valid_bank_account(v),
        "routing": lambda v, t: valid_routing(v),
        "email": lambda v, t: valid_email(v),
        "phone": lambda v, t: valid_phone(v),
        "dob": lambda v, t: valid_dob(v, as_of),
        "va_claim": lambda v, t: valid_va_claim(v),
        "driver_license": lambda v, t: valid_document_id(F.lit("driver_license_number"), v),
        "no_digit_run": lambda v, t: ~digit_run(v),
        "itin": lambda v, t: valid_itin(v),
        "ip": lambda v, t: valid_ip(v),
        "name": lambda v, t: valid_name(v),
        "birth_date": lambda v, t: valid_birth_date(v, t),
        "api_key": lambda v, t: valid_api_key(v),
        "any_digit": lambda v, t: has_any_digit(v),
        **{f"length_{label}": lambda v, t, label=label: valid_length_for(F.lit(label), v) for label in ("ssn", "itin", "credit_card_number", "phone_number", "bank_account_number")},
        **{f"extracted_{label}": lambda v, t, label=label: validate_extracted(F.lit(label), v, t) for label in sorted(set(LABELS.values()))},
    }
