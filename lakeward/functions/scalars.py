"""Cleansing and derivation as column expressions; no Python runs on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}$"
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Formats in order of preference; the day precedes the month where both can be read.
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "yyyy/M/d", "yyyy-M-d H:m:s", "d-M-yyyy")
#: Further formats, month first, that a lenient reader also takes. A bare year or time is not a date here.
LENIENT_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd'T'HH:mm", "yyyy-M-d H:m:s.SSS", "yyyy-M-d H:m", "yyyyMMdd", "M.d.yyyy", "d.M.yyyy", "M/d/yy", "d/M/yy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
#: Which of these formats can read a text, by its shape: a text is tried with two or three, not with all.
_SHAPES = {
    r"^\d+/\d+/\d+$": [f for f in DATE_FORMATS + LENIENT_FORMATS if f.count("/") == 2],
    r"^[+-]?\d+-[^ ]*[ T].*:": [f for f in DATE_FORMATS + LENIENT_FORMATS if "H" in f],
    r"^[+-]?\d+-": [f for f in DATE_FORMATS + LENIENT_FORMATS if "-" in f and "H" not in f],
    r"^\d+$": ["yyyyMMdd"],
    r"^\d+\.\d+\.": [f for f in LENIENT_FORMATS if "." in f and "H" not in f],
    r"\p{L}.*\d|\d.*\p{L}": [f for f in LENIENT_FORMATS if "MMM" in f],
}
#: A date, or a moment to the second, as it is mostly written: read by a cast, without formats.
PLAIN_DATE = r"^\d{4}-\d{2}-\d{2}( ([01]\d|2[0-3]):[0-5]\d:[0-5]\d)?$"
PLAIN_MOMENT = r"^\d{4}-\d{2}-\d{2} ([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"
#: What names a payer, in order of preference.
PAYERS = (("star", "Star Health"), ("icici", "ICICI Lombard"), ("hdfc", "HDFC ERGO"), ("bajaj", "Bajaj Allianz"), ("care", "Care Health"), ("niva", "Niva Bupa"), ("bupa", "Niva Bupa"))
#: What states a claim's outcome, in order of preference.
STATUSES = (("APPROV", "Approved"), ("REJECT", "Rejected"), ("PEND", "Pending"))


def trimmed(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.trim(c.cast("string"), F.lit(" \t\n\x0b\f\r"))


def filled(c: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"\s+", " ")


def _once(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, with c computed once: repeated in place, many formats outgrow what a generated method may hold."""
    return F.transform(F.array(c), body)[0]


def parse_date(c: Column) -> Column:
    """Date of a text in any known format, else null. A text of ISO shape is read as ISO or not at all."""

    def read(s: Column) -> Column:
        out = F.when(s.rlike(ISO), F.try_to_date(s, "yyyy-MM-dd"))
        for shape, formats in _SHAPES.items():
            known = [F.try_to_timestamp(s, F.lit(f)).cast("date") if "H" in f else F.try_to_date(s, f) for f in formats]
            out = out.when(s.rlike(shape), F.coalesce(*known))
        return out

    s = filled(c)
    return F.coalesce(F.when(s.rlike(PLAIN_DATE), s.try_cast("date")), _once(s, read))


def parse_timestamp(c: Column) -> Column:
    """Timestamp without zone; each value is read by itself."""
    formats = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSS", "yyyy-M-d'T'H:m:s[.SSSSSS][XXX]", "yyyy-M-d H:m:s.SSS", "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d H:m", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d-MMM-yyyy H:m:s")
    s = filled(c)
    known = _once(s, lambda x: F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in formats)))
    return F.coalesce(F.when(s.rlike(PLAIN_MOMENT), s.try_cast("timestamp")), known, parse_date(c).cast("timestamp")).cast("timestamp_ntz")


def title_case(c: Column) -> Column:
    """Upper case at the start of each run of letters, lower case elsewhere."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def clean_gender(c: Column) -> Column:
    s = F.upper(trimmed(c))
    return F.when(s.isin("M", "MALE"), "M").when(s.isin("F", "FEMALE"), "F").when(s.isin("O", "OTHER"), "O").otherwise("U")


def clean_name(c: Column) -> Column:
    return F.nullif(title_case(squeezed(c)), F.lit(""))


def clean_phone(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c.cast("string"), r"\D", ""), F.lit(""))


def clean_email(c: Column) -> Column:
    s = F.lower(trimmed(c))
    return F.when(s.rlike(EMAIL), s)


def age(birth: Column, as_of: Column) -> Column:
    """Full calendar years, at least 0; null without a birth date."""
    early = (F.month(as_of) * 100 + F.day(as_of)) < (F.month(birth) * 100 + F.day(birth))
    return F.when(birth.isNotNull(), F.greatest(F.lit(0), F.year(as_of) - F.year(birth) - early.cast("int")))


def age_band(years: Column) -> Column:
    low = F.floor(years / 10).cast("int") * 10
    return F.when(years.isNull(), "Unknown").otherwise(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")))


def length_of_stay(admitted: Column, discharged: Column) -> Column:
    return F.date_diff(discharged, admitted)


def lab_flag(value: Column, low: Column, high: Column) -> Column:
    """abnormal unless numeric; with both bounds normal between them; with a bound missing normal."""
    s = trimmed(value)
    x = F.when(s.rlike(NUMBER), s.try_cast("double"))
    inside = F.when(low.isNull() | high.isNull(), True).otherwise(x.between(low, high))
    return F.when(x.isNull(), "abnormal").when(inside, "normal").otherwise("abnormal")


def claim_status(c: Column) -> Column:
    s = F.upper(trimmed(c))
    out = F.when(s.isNull(), "Pending")
    for cue, name in STATUSES:
        out = out.when(s.contains(cue), name)
    return out.otherwise(title_case(s))


def test_name(c: Column) -> Column:
    return F.coalesce(F.upper(squeezed(c)), F.lit("UNKNOWN"))


def insurer(c: Column) -> Column:
    s = filled(c)
    norm = F.lower(s)
    out = F.when(s.isNull(), "Unknown")
    for cue, name in PAYERS:
        out = out.when(norm.contains(cue), name)
    return out.otherwise(title_case(s))


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def half_even(x: Column, digits: int) -> Column:
    """Rounds the scaled value half to even, as array libraries do; round() works on decimal text, half up."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def is_iso_date(c: Column) -> Column:
    s = trimmed(c)
    return s.rlike(ISO) & F.try_to_date(s, "yyyy-MM-dd").isNotNull()


def is_phone(c: Column) -> Column:
    return trimmed(c).rlike(r"^\d{10,12}$")


def is_email(c: Column) -> Column:
    return trimmed(c).rlike(EMAIL)
