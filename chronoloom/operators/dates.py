"""Dates, ranges and durations written in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
NAMES = r"(?i)\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"


def _month(c: Column) -> Column:
    """Number of a month by the first three letters of its name."""
    return F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)))[F.lower(F.substring(c, 1, 3))]


def _all(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def dates_in(df: DataFrame, *, id: str, text: str, reference: str) -> DataFrame:
    """(``id``, layer, label, start, end, months, days), one row for each expression, as often as it is written.

    Layers: iso (2026-03-11, and 2026-03 for its first day), written (March 11,
    2026; 11 March 2026; Mar 2026), relative to the date of ``reference``
    (today, yesterday, tomorrow, last week, last month, 3 days ago; each word
    once), fiscal (Q3 2026, FY26 or FY2026 as calendar years) and duration (for
    or over 3 weeks, months or days). Dates that don't exist are left out; null
    texts have none. Everything is a built-in expression over one array a
    layer, one explode and no shuffle.
    """
    t = F.col(text)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    ex = lambda x, p, g: F.regexp_extract(x, p, g)
    none_d, none_i = F.lit(None).cast("date"), F.lit(None).cast("int")

    def row(layer, label, start, end=none_d, months=none_i, days=none_i):
        return F.struct(F.lit(layer).alias("layer"), label.alias("label"), start.alias("start"), end.alias("end"), months.alias("months"), days.alias("days"))

    ref = F.to_date(reference)
    iso = r"\b\d{4}-\d{2}-\d{2}\b"
    ym = r"\b\d{4}-\d{2}\b(?!-\d)"
    dmy, mdy, my = r"\b(\d{1,2}) " + NAMES[4:].replace(r"\b(", "(") + r" (\d{4})\b", NAMES + r" (\d{1,2}), (\d{4})\b", NAMES + r" (\d{4})\b"
    dmy = "(?i)" + dmy
    layers = [
        F.transform(_all(text, iso), lambda x: row("iso", x, F.try_to_date(x, "yyyy-MM-dd"))),
        F.transform(_all(text, ym), lambda x: row("iso", x, F.try_to_date(F.concat(x, F.lit("-01")), "yyyy-MM-dd"))),
        F.transform(_all(text, mdy), lambda x: row("written", x, day(ex(x, mdy, 3), _month(ex(x, mdy, 1)), ex(x, mdy, 2)))),
        F.transform(_all(text, dmy), lambda x: row("written", x, day(ex(x, dmy, 3), _month(ex(x, dmy, 2)), ex(x, dmy, 1)))),
        # a month and year inside a longer date has its day before it
        F.transform(F.regexp_extract_all(F.regexp_replace(t, dmy, " "), F.lit(my), F.lit(0)), lambda x: row("written", x, day(ex(x, my, 2), _month(ex(x, my, 1)), F.lit("1")))),
        *(
            F.when(t.rlike(rf"(?i)\b{w}\b"), F.array(row("relative", F.lit(w), F.date_add(ref, n))))
            for w, n in (("today", 0), ("yesterday", -1), ("tomorrow", 1), ("last week", -7), ("last month", -30))
        ),
        F.transform(
            _all(text, r"(?i)\b\d{1,3} (?:days?|weeks?) ago\b"),
            lambda x: row("relative", x, F.date_add(ref, -(ex(x, r"^(\d+)", 1).cast("int") * F.when(x.rlike("(?i)week"), 7).otherwise(1)))),
        ),
        F.transform(
            _all(text, r"(?i)\bQ[1-4] \d{4}\b"),
            lambda x: row("fiscal", x, day(ex(x, r"(\d{4})$", 1), F.substring(x, 2, 1).cast("int") * 3 - 2, F.lit("1")), F.last_day(day(ex(x, r"(\d{4})$", 1), F.substring(x, 2, 1).cast("int") * 3, F.lit("1")))),
        ),
        F.transform(
            _all(text, r"\bFY(?:\d{4}|\d{2})\b"),
            lambda x: row("fiscal", x, day(F.concat(F.lit("20"), F.right(x, F.lit(2))), F.lit("1"), F.lit("1")), day(F.concat(F.lit("20"), F.right(x, F.lit(2))), F.lit("12"), F.lit("31"))),
        ),
        F.transform(
            _all(text, r"(?i)\b(?:for|over) \d{1,3} (?:months?|weeks?|days?)\b"),
            lambda x: row(
                "duration", x, none_d, none_d,
                F.when(x.rlike("(?i)month"), ex(x, r"(\d+)", 1).cast("int")),
                F.when(~x.rlike("(?i)month"), ex(x, r"(\d+)", 1).cast("int") * F.when(x.rlike("(?i)week"), 7).otherwise(1)),
            ),
        ),
    ]
    empty = F.array().cast("array<struct<layer: string, label: string, start: date, end: date, months: int, days: int>>")
    every = F.concat(*(F.coalesce(x, empty) for x in layers))
    return df.select(id, F.explode(every).alias("x")).select(id, "x.*").filter("layer = 'duration' OR start IS NOT NULL")
