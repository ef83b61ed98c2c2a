from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions import dates, display, numbers, text
from rollbook.functions import emails as E

TEXT = T.StringType()


def apply(frame, function, values):
    df = frame(["id", "v"], [(str(i), v) for i, v in enumerate(values)])
    rows = df.select("id", function(F.col("v")).alias("out")).collect()
    return [row["out"] for row in sorted(rows, key=lambda r: int(r["id"]))]


STRICT = {
    "$5,000": 5000.0, " 10,000.50 ": 10000.5, "(250)": -250.0, "( $1,200 )": -1200.0, "-3": -3.0, "+4.": 4.0, ".5": 0.5,
    "12.5%": None, "1e3": None, "N/A": None, "": None, "abc": None, "5 apples": None, "1" * 121: None, "1d": None, "NaN": None,
}


def test_strict_number(frame):
    assert apply(frame, lambda c: numbers.strict_number(c, TEXT), STRICT) == list(STRICT.values())


def test_lenient_number_takes_percent_and_exponent(frame):
    cases = {"$5,000": 5000.0, "12.5%": 12.5, "1e3": 1000.0, "(250)": None, " ": None, "NaN": None, "1d": None, "-75": -75.0}
    assert apply(frame, lambda c: numbers.lenient_number(c, TEXT), cases) == list(cases.values())


DATES = {
    "2024-05-17": date(2024, 5, 17), "2024/5/7": date(2024, 5, 7), "3/9/2023": date(2023, 3, 9), "7/4/22": date(2022, 7, 4),
    "7/4/75": date(1975, 7, 4), "12-31-2024": date(2024, 12, 31), "March 5, 2024": date(2024, 3, 5), "march 5 2024": date(2024, 3, 5),
    "Jan 2, 2025": date(2025, 1, 2), "SEP 30 2021": date(2021, 9, 30), "February 2023": date(2023, 2, 1), "Dec 2020": date(2020, 12, 1),
    "2020": date(2020, 1, 1), "2024-05-17 23:30:00": date(2024, 5, 17), "2024-05-17T23:30:00-05:00": date(2024, 5, 18),
    "2024-02-30": None, "13/1/2024": None, "bad date": None, "": None, "N/A": None, "5": None, None: None,
}


def test_strict_date(frame):
    assert apply(frame, lambda c: dates.strict_date(c, TEXT), DATES) == list(DATES.values())


def test_dates_do_not_depend_on_the_session_zone(spark, frame):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert apply(frame, lambda c: dates.strict_date(c, TEXT), DATES) == list(DATES.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_numbers_as_dates(frame):
    df = frame(None, [(2018.0,), (45659.0,), (0.0,), (2958466.0,), (float("nan"),), (45659.75,)], "v double")
    got = [r[0] for r in df.select(dates.strict_date(F.col("v"), T.DoubleType())).collect()]
    assert got == [date(2018, 1, 1), date(2025, 1, 2), None, None, None, date(2025, 1, 2)]


ADDRESSES = {
    "ada@alpha.edu": ["ada@alpha.edu"],
    "Ben@Mail.ALPHA.edu; ben@mail.alpha.edu": ["Ben@mail.alpha.edu"],
    "Dana Fox <dana@example.org>, dana@beta.com": ["dana@example.org", "dana@beta.com"],
    "a@b.co|c@d.org": ["a@b.co", "c@d.org"],
    "x@alpha.edu.evil.com": ["x@alpha.edu.evil.com"],
    ".bad@alpha.edu": [], "bad.@alpha.edu": [], "a..b@alpha.edu": [], "no address": [], "x@localhost": [], "x@-a.com": [],
    f"{'l' * 65}@a.com": [], "none": [], "": [], None: [],
    "a+b@c.io\nsecond@c.io": ["a+b@c.io", "second@c.io"],
}


def test_extract_emails(frame):
    assert apply(frame, E.extract_emails, ADDRESSES) == list(ADDRESSES.values())


@pytest.mark.parametrize(
    ("domain", "expected", "below", "result"),
    [
        ("alpha.edu", "alpha.edu", True, True), ("mail.alpha.edu", "@Alpha.edu.", True, True), ("mail.alpha.edu", "alpha.edu", False, False),
        ("notalpha.edu", "alpha.edu", True, False), ("alpha.edu.evil.com", "alpha.edu", True, False), ("ALPHA.EDU.", "alpha.edu", True, True),
        (None, "alpha.edu", True, False), ("alpha.edu", "", True, False),
    ],
)
def test_domain_matches(frame, domain, expected, below, result):
    assert apply(frame, lambda c: E.domain_matches(c, [expected], below), [domain]) == [result]


def test_matching_and_masked_emails(frame):
    cell = "ada@alpha.edu, Ben@beta.com"
    assert apply(frame, lambda c: E.matching_emails(E.email_tokens(c), ["alpha.edu"]), [cell]) == [["ada@alpha.edu"]]
    assert apply(frame, lambda c: E.matching_emails(E.email_tokens(c), ["alpha.edu"], negated=True), [cell]) == [["Ben@beta.com"]]
    assert apply(frame, E.mask_emails, [cell, "plain"]) == ["a***@alpha.edu, B***@beta.com", "plain"]


def test_text_forms(frame):
    assert apply(frame, text.norm_text, ["  AT&T -- Labs!", None]) == ["at t labs", None]
    assert apply(frame, text.norm_title, ["AT&T -- Labs!"]) == ["at&t labs"]
    assert apply(frame, text.norm_compact, ["O'Brien-Smith 2"]) == ["obriensmith2"]
    names = ["Capitol One, Inc.", "Google (YouTube) LLC", "Northrop Gruman Corp", "Co Inc", "Coca Company Holdings"]
    assert apply(frame, text.norm_company, names) == ["capital one", "google", "northrop grumman", "", "coca holdings"]
    assert [text.fold_company(n) for n in names] == ["capital one", "google", "northrop grumman", "", "coca holdings"]
    assert apply(frame, text.norm_member, [" New   York ", "N/A", ""]) == ["new york", None, None]


def test_terms(frame):
    terms = ["ai", "data scientist", "m&a", "c++ lead"]

    def found(c):
        return text.has_term(text.norm_title(c), terms)

    def first(c):
        return text.first_term(text.norm_title(c), terms)

    titles = ["AI Engineer", "Maintainer", "Senior Data  Scientists", "M&A Analyst", "Lead, data-scientist and AI", None, "C Lead"]
    assert apply(frame, found, titles) == [True, False, True, True, True, False, True]
    assert apply(frame, first, titles) == ["ai", None, "data scientist", "m&a", "ai", None, "c++ lead"]
    assert apply(frame, lambda c: text.has_term(c, []), ["x"]) == [False]


def test_clean_text(frame):
    assert apply(frame, lambda c: text.clean_text(c), ["<b>a</b>\t  b\n\n\n\nc\x00 ", None]) == ["a b\n\nc", ""]
    assert apply(frame, lambda c: text.clean_text(c, 10), ["abcdefgh jklmn"]) == ["abcdefgh..."]


def test_formats(frame):
    def number(c):
        return display.format_value(c.cast("double"))

    assert apply(frame, number, ["1234", "1234.5", None]) == ["1,234", "1,234.50", "Not available"]

    def compact(**options):
        return lambda c: display.format_compact(c.cast("double"), **options)

    assert apply(frame, compact(currency=True), ["1250000", "123456", "999.6"]) == ["$1.2M", "$123.5K", "$1,000"]
    assert apply(frame, compact(year=True), ["2018"]) == ["2018"]
    assert apply(frame, compact(), ["1234.5", "7", None]) == ["1,234.5", "7", "—"]


def test_full_name(frame):
    df = frame(["f", "l", "n", "p"], [("Ada", "Cho", "x", "y"), ("Ada", " ", "Ada C.", "y"), (None, "Cho", "nan", "Addie"), (None,) * 4])
    names = [r[0] for r in df.select(text.full_name(*(F.col(c) for c in df.columns))).collect()]
    assert names == ["Ada Cho", "Ada C.", "Addie", ""]
