"""Whether a text reads as a date, as a column expression.

A text is an optional weekday, a date and an optional time with an optional zone, the date
first or last. Dates are numbers in the order year, month, day, or month and day (either
way round) and year, with one kind of separator, or a month's name with a day, a year or
both. Months and days must exist in the calendar, hours and minutes on the clock. A bare
number is no date but for eight digits that are one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names as calendars have them, by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
FULL_MONTHS = "january february march april may june july august september october november december".split()
FULL_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

_MONTH = "(" + "|".join(f"{m}(?:{f[3:]})?" if f[3:] else m for m, f in zip(MONTHS, FULL_MONTHS)) + "|sept)"
_WEEKDAY = "(?:" + "|".join(f"{d}(?:{f[3:]})?" for d, f in zip(DAYS, FULL_DAYS)) + ")"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_YEAR = r"'?(\d{4}|\d{2})"
_ZONE = r"(?:z|utc|gmt|est|edt|cst|cdt|mst|mdt|pst|pdt|cet|cest|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?)"
_CLOCK = r"(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?)?\s*([ap]\.?m\.?)?"
#: A time has minutes, or an hour with am or pm.
_TIME = rf"(?:(?=\d{{1,2}}:|\d{{1,2}}\s*[ap]\.?m){_CLOCK})(?:\s*{_ZONE})?"

#: Pattern of a date, and which of its groups are year, month and day; 0 for none.
FORMS = [
    (r"^(\d{4})-(\d{1,2})(?:-(\d{1,2}))?$", (1, 2, 3)),
    (r"^(\d{4})/(\d{1,2})(?:/(\d{1,2}))?$", (1, 2, 3)),
    (r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{4})年(\d{1,2})月(?:(\d{1,2})日)?$", (1, 2, 3)),
    (r"^((?:1[5-9]|2[01])\d{2})(\d{2})(\d{2})$", (1, 2, 3)),
    *((rf"^(\d{{1,2}}){s}(\d{{1,2}}){s}(\d{{4}}|\d{{2}})$", order) for s in ("/", "-", r"\.") for order in ((3, 1, 2), (3, 2, 1))),
    (r"^(\d{1,2})[/-](\d{4})$", (2, 1, 0)),
    (rf"^{_DAY}[\s.\-/]*(?:of\s+)?{_MONTH}\.?,?[\s.\-/]*{_YEAR}$", (3, 2, 1)),
    (rf"^{_MONTH}[\s.\-/]*{_DAY},?[\s\-/]+{_YEAR}$", (3, 1, 2)),
    (rf"^{_MONTH}[\s.,\-/]+'?(\d{{4}})$", (2, 1, 0)),
    (rf"^(\d{{4}})[\s.,\-/]+{_MONTH}\.?(?:[\s.\-/]+{_DAY})?$", (1, 2, 3)),
]


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _in_calendar(d: Column) -> Column:
    """Whether d, of texts y, m and d, is a day of the calendar."""
    year = F.when(F.length(d["y"]) == 2, F.concat(F.lit("20"), d["y"])).otherwise(d["y"]).try_cast("int")
    name = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(d["m"], 1, 3)).cast("int")
    number = F.coalesce(d["m"].try_cast("int"), F.nullif(name, F.lit(0)))
    day = F.coalesce(d["d"], F.lit("1")).try_cast("int")

    def exists(n: Column) -> Column:
        leap = ((n["y"] % 4 == 0) & (n["y"] % 100 != 0)) | (n["y"] % 400 == 0)
        last = F.when(n["m"] == 2, 28 + leap.cast("int")).otherwise(F.lit(30) + F.pmod(n["m"] + F.floor(n["m"] / 8), F.lit(2)))
        return (n["y"] >= 1) & n["m"].between(1, 12) & n["d"].between(1, last)

    return _once(F.struct(year.alias("y"), number.alias("m"), day.alias("d")), exists)


def _of_form(date: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    """Whether the text has the form and names a day; the form's parts are read only where it has."""
    parts = [(_number(date, pattern, g) if g else F.lit(None).cast("string")).alias(n) for g, n in zip(groups, "ymd")]
    return F.when(date.rlike(pattern), F.coalesce(_once(F.struct(*parts), _in_calendar), F.lit(False))).otherwise(F.lit(False))


def is_date(text: Column) -> Column:
    """Whether the whole text reads as a date by FORMS, with or without weekday and time."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    plain = F.regexp_replace(plain, rf"^{_WEEKDAY}\.?,?\s+", "")
    after, before = rf"(?:\s*t(?=\d)|,?\s+(?:at\s+)?){_TIME}$", rf"^{_TIME},?\s+"

    def parted(p: Column) -> Column:
        """The date, and the time: cut off once, at the end or else at the start."""
        timed = p.rlike(r":|\d\s*[ap]\.?m")
        at_end, at_start = timed & p.rlike(after), timed & p.rlike(before)
        date = F.when(at_end, F.regexp_replace(p, after, "")).when(at_start, F.regexp_replace(p, before, "")).otherwise(p)
        of = lambda k: F.when(at_end, F.regexp_extract(p, after, k)).when(at_start, F.regexp_extract(p, before, k)).otherwise(F.lit(""))
        numbers = [F.coalesce(F.nullif(of(k), F.lit("")).try_cast("int"), F.lit(0)).alias(n) for k, n in ((1, "hour"), (2, "minute"), (3, "second"))]
        return F.struct(F.regexp_replace(date, rf",?\s+{_WEEKDAY}$|z$", "").alias("date"), *numbers, (of(4) != "").alias("half"))

    def verdict(x: Column) -> Column:
        clock = F.when(x["half"], x["hour"].between(1, 12)).otherwise(x["hour"] <= 23) & (x["minute"] <= 59) & (x["second"] <= 59)
        return clock & reduce(lambda a, b: a | b, [_of_form(x["date"], p, g) for p, g in FORMS])

    return F.coalesce(_once(_once(plain, parted), verdict), F.lit(False))
