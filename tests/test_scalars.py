import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from lakeward.functions import masking as m
from lakeward.functions import scalars as s


def values(spark, kind, column, inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("x")).alias("y")).collect()]


D = dt.date

CASES = [
    (s.parse_date, {"2026-01-01": D(2026, 1, 1), "13/03/2025": D(2025, 3, 13), "03/25/2025": D(2025, 3, 25), "1/2/2025": D(2025, 2, 1), "18-Nov-2025": D(2025, 11, 18), "18-november-2025": D(2025, 11, 18), "2025-03-27 19:31:22": D(2025, 3, 27), "2025-03-27T19:31:22": D(2025, 3, 27), "20250327": D(2025, 3, 27), "27.03.2025": D(2025, 3, 27), "March 3, 2025": D(2025, 3, 3), "2025-02-30": None, "31/02/2025": None, "10:30": None, "invalid-date-string": None, " ": None, None: None}),
    (s.clean_gender, {"Male": "M", "male": "M", " M": "M", "Female": "F", "female": "F", "F": "F", "Other": "O", "other": "O", None: "U", "unknown_variant": "U"}),
    (s.clean_name, {"  vikram   mehta  ": "Vikram Mehta", "AMIT NAIK": "Amit Naik", None: None, "   ": None, "o'brien": "O'Brien", "mary-jane": "Mary-Jane", "3rd st": "3Rd St", "mcDONALD": "Mcdonald", "élan vital": "Élan Vital"}),
    (s.clean_phone, {"+91-7589770678": "917589770678", "7126048509": "7126048509", None: None, "none": None}),
    (s.clean_email, {"valid.user@example.com": "valid.user@example.com", "USER@DOMAIN.ORG": "user@domain.org", "invalid-email.example.com": None, "user name@example.com": None, None: None}),
    (s.claim_status, {"Approved ": "Approved", "REJECTED": "Rejected", "Pending": "Pending", None: "Pending", "on hold": "On Hold"}),
    (s.test_name, {"  creatinine  ": "CREATININE", "hb   a1c": "HB A1C", None: "UNKNOWN", " ": ""}),
    (s.insurer, {"STAR HEALTH ": "Star Health", "Niva-Bupa": "Niva Bupa", "max_bupa": "Niva Bupa", "starcare": "Star Health", "acme mutual": "Acme Mutual", " ": "Unknown", None: "Unknown", "care-health": "Care Health", "hdfc  ergo insurance": "HDFC ERGO"}),
    (m.mask_full_name, {"Rahul Rao": "R***", "": "***", None: "***", " kim": "K***"}),
    (m.mask_phone, {"9876543210": "******3210", "123": "******123", None: "******", "": "******"}),
    (m.mask_email, {"kunal.gowda83@example.com": "k***@example.com", None: None, "": None, "none": "***", "a@b@c": "a***@b@c", "@x.com": "***@x.com", " a@b.c ": "a***@b.c", "  ": "***"}),
    (m.mask_national_id, {"745923018779": "********8779", None: "********", " ": "********", "123": "****123", "12345": "*2345"}),
]


@pytest.mark.parametrize(("function", "pairs"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_text_functions(spark, function, pairs):
    assert dict(zip(pairs, values(spark, "string", function, list(pairs)), strict=True)) == pairs


def test_ages_bands_and_stays(spark):
    as_of = F.lit("2026-01-01").cast("date")
    assert values(spark, "date", lambda c: s.age(c, as_of), [D(2000, 1, 1), D(2000, 1, 2), D(2030, 1, 1), None]) == [26, 25, 0, None]
    assert values(spark, "date", lambda c: s.age(c, F.lit("2025-02-28").cast("date")), [D(2000, 2, 29)]) == [24]
    assert values(spark, "int", s.age_band, [26, 0, 105, None]) == ["20-29", "0-9", "100-109", "Unknown"]
    assert values(spark, "date", lambda c: s.length_of_stay(F.lit("2026-01-01").cast("date"), c), [D(2026, 1, 5), D(2025, 12, 31), None]) == [4, -1, None]
    assert values(spark, "date", lambda c: m.mask_date_of_birth(c, as_of), [D(1979, 5, 16)]) == ["40-49"]


def test_lab_flags(spark):
    flag = lambda c: s.lab_flag(c, F.lit(4.0), F.lit(5.6))
    assert values(spark, "string", flag, ["5.2", "9.8", "pending", "5.2d", "1_000", "inf", "nan", None, "4.0", " 5.6 "]) == ["normal", "abnormal", "abnormal", "abnormal", "abnormal", "abnormal", "abnormal", "abnormal", "normal", "normal"]
    assert values(spark, "string", lambda c: s.lab_flag(c, F.lit(None), F.lit(5.6)), ["9.8", "x"]) == ["normal", "abnormal"]


def test_rounding_is_half_even_on_the_scaled_value(spark):
    assert values(spark, "double", lambda c: s.half_even(c, 2), [1.005, 2.675, 0.125, 2.5, None]) == [1.0, 2.68, 0.12, 2.5, None]


def test_tokens_hide_the_salt(spark):
    df = m.with_token(spark.createDataFrame([("P001",), (" P001 ",), ("",), (None,)], "id string"), "id", "s3cret", "token")
    want = hashlib.sha256(b"s3cretP001").hexdigest()
    assert [r["token"] for r in df.collect()] == [want, want, "", ""]
    assert "s3cret" not in df._jdf.queryExecution().toString()


def test_timestamps_are_read_one_by_one(spark):
    got = values(spark, "string", s.parse_timestamp, ["2026-01-01 10:00:00", "2026-01-01T10:00:00", "01/02/2026 09:30", "2026-01-03", "junk", None])
    assert [x and x.isoformat() for x in got] == ["2026-01-01T10:00:00", "2026-01-01T10:00:00", "2026-02-01T09:30:00", "2026-01-03T00:00:00", None, None]


def test_policies(spark):
    m.register_policies(spark, as_of="date'2026-01-01'")
    got = lambda name, *x: spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, v string").orderBy("k").selectExpr(f"{name}(v)").collect()
    assert [r[0] for r in got("policy_dob", "1990-01-01", "not a date", None, "1985-12-31")] == ["30-39", "Unknown", "Unknown", "40-49"]
    assert [r[0] for r in got("policy_email", "a@b@c", "none", None, "@x")] == ["a***@b", "***", None, "@***@x"]
    assert [r[0] for r in got("policy_full_name", " kim", " ", None)] == ["K***", "***", "***"]
    assert [r[0] for r in got("policy_phone", "+1 23-456", None)] == ["******3456", "******"] and [r[0] for r in got("policy_national_id", "12", "123456", None)] == ["********12", "********3456", "********"]
    m.register_policies(spark, exempt="true")
    assert [r[0] for r in got("policy_email", "a@b", None)] == ["a@b", None]


def test_plain_dates_are_read_without_formats_and_alike(spark, monkeypatch):
    """Dates and moments of the plain form are cast, with the values that the formats give; the formats read the rest."""
    texts = ["2020-02-29", "2021-02-29", "0000-01-01", "0001-12-31", "9999-12-31", "1582-10-10", "2020-13-01", "2020-01-01 23:59:59", "2020-01-01 24:00:00", "2020-01-01 00:60:00", "2020-02-30 10:00:00", "1899-01-01 00:00:00", " 2020-01-01 08:00:00 ", "2020-1-1", "2020-01-01T08:00:00", "2020-01-01 x", "01/02/2020", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    read = lambda: [tuple(r) for r in df.select(s.parse_date(F.col("x")).cast("string"), s.parse_timestamp(F.col("x")).cast("string")).collect()]
    plain = read()
    monkeypatch.setattr(s, "PLAIN_DATE", "^never$")
    monkeypatch.setattr(s, "PLAIN_MOMENT", "^never$")
    assert plain == read()
