from pyspark.sql import functions as F

from veilspan.functions import validators as V

CASES = [
    ("dob", lambda v, t: V.valid_dob(v, "2024-01-01"), ["21/05/1994", "1990-05-15", "01.01.2024", "01-01-1904"], ["31/02/2000", "02/01/2024", "31/12/1903", "x", None]),
    ("va", lambda v, t: V.valid_va_claim(v), ["321-45-7891", "111 111 112"], ["123-45-6789", "987654321", "000 000 000", "777777777", "12345678", None]),
    ("ssn", lambda v, t: V.valid_ssn(v), ["321-45-7891", "321457891"], ["000-45-7891", "666-45-7891", "900-45-7891", "321-00-7891", "321-45-0000", "078-05-1120", "32145789", None]),
    ("itin", lambda v, t: V.valid_itin(v), ["912-70-1234", "900501234"], ["912-69-1234", "812-70-1234", "91270123", "912-93-1234"]),
    ("bank", lambda v, t: V.valid_bank_account(v), ["120480", "000 1234 0009"], ["12345", "123450", "1204801204801204", "12a480", "999990"]),
    ("routing", lambda v, t: V.valid_routing(v), ["021000021", "011401533"], ["021000022", "000000000", "12345678"]),
    ("phone", lambda v, t: V.valid_phone(v), ["+1-555-123-4567", "5550102"], ["555010", "5551234567", "1" * 31]),
    ("email", lambda v, t: V.valid_email(v), ["a@b.c"], ["a@b", "a.b"]),
    ("increasing", lambda v, t: V.digit_run(v, "increasing"), ["12345", "9012349"], ["98765", "12-345", "1235"]),
    ("decreasing", lambda v, t: V.digit_run(v, "decreasing"), ["98765", "43210"], ["12345"]),
    ("any", lambda v, t: V.digit_run(v), ["11111", "012345"], ["12-345", "1111", ""]),
    ("ip", lambda v, t: V.valid_ip(v), ["10.20.30.40", "1:2:3:4:5:6:7:8", "::1:2:3:4"], ["256.1.1.1", "1.2.3", "1.1.1", "::1"]),
    ("name", lambda v, t: V.valid_name(v), ["Jane Doe"], ["Jane", "R2D2 C3PO"]),
    ("key", lambda v, t: V.valid_api_key(v), ["abcdefg1"], ["abcdefgh", "abc1"]),
    ("birth", lambda v, t: V.valid_birth_date(v, F.lit("Geburtsdatum: x")), ["21/05/1994", "May 15, 1990"], ["1/2/94", "not a date"]),
    *[(f"birth {w}", lambda v, t, w=w: V.valid_birth_date(v, F.lit(w)), ["21/05/1994"], []) for w in ("Né(e) le 3", "GEB. DATUM", "F.N.", "syntymäpäivä", "Född  den", "D.O.B.", "Date de naissance")],
    ("birth text", lambda v, t: V.valid_birth_date(v, F.lit("meeting")), [], ["21/05/1994"]),
    ("iso", lambda v, t: V.valid_mod_11_10(v), ["86095742719"], ["86095742718", "8609574271", "x6095742719"]),
    ("licence", lambda v, t: V.valid_document_id(F.lit("driver_license_number"), v), ["DL120480"], ["DL12048", "ABCDEF12", "12345678", "ABCDEFGH"]),
    ("iban", lambda v, t: V.validate_extracted(F.lit("IBAN_CODE"), v, t), ["DE89370400440532013000"], ["DE", "ABCDEFGH"]),
    ("plate", lambda v, t: V.validate_extracted(F.lit("license_plate_number"), v, t), ["KA 1"], ["KA"]),
    ("card", lambda v, t: V.validate_extracted(F.lit("credit_card"), v, t), ["4111 1121 1131 1141"], ["4111", "4111x1111111111"]),
    ("account", lambda v, t: V.validate_extracted(F.lit("us_bank_number"), v, t), ["120480"], ["12048", "1204801204801204"]),
    ("unknown", lambda v, t: V.validate_extracted(F.lit("whatever"), v, t), ["x"], []),
    ("letters", lambda v, t: V.has_letters(v), ["1a"], ["1"]),
]


def test_every_validator(spark):
    for name, check, good, bad in CASES:
        df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
        got = df.select("v", "want", F.coalesce(check(F.col("v"), F.lit("")), F.lit(False)).alias("got")).collect()
        assert [(r["v"], r["got"]) for r in got] == [(r["v"], r["want"]) for r in got], name


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(V.mrz_check_digit(F.lit("L898902C3"))) == 6
    assert value(V.mrz_check_digit(F.lit("740812"))) == 2
    assert value(V.mrz_check_digit(F.lit("ab"))) == -1
    assert value(V.normalize_token(F.lit("ab-c.d_e/f\\g, h"))) == "ABCDEFGH"
    assert value(V.count_letters(F.lit("aé1-"))) == 2
    assert value(V.canonical_label(F.lit("US_SSN"))) == "ssn"
    assert value(V.canonical_label(F.lit("zz"))) is None
