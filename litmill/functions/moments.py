"""Parsing of delivered date and time texts into fields, as Column expressions.

Every function takes and returns Columns, so the whole parse stays in generated
code. Accepted forms (blanks at both ends and letter case do not matter):

* ``2020-05-26``, ``2020/05/26`` with an optional time after ``T`` or a blank
* ``20200526``, ``202005261200``, ``20200526120059``
* ``26 May 2020``, ``Tue, 26 May 2020 12:00:59 +0200``
* ``May 26, 2020``, ``May 26, 2020 at 2:05 PM``
* ``26.05.2020`` (day first), ``05/26/2020 02:05 PM`` (month first; day first
  only where the first number can be no month)
* ``2020年5月26日 14:05``
* seconds (10 digits), milliseconds (13) or microseconds (16) since 1970
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by their first three letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)

# Zone abbreviations in common use, in minutes east of UTC.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60,
    "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "jst": 540, "kst": 540,
    "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
}

#: (pattern with the date's parts and the rest as groups, group of year, month, day, rest)
FAMILIES = [
    (r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})((?:t|\s).*|z)?$", 1, 3, 4, 5),
    (r"^(\d{4})(\d{2})(\d{2})(t?(?:\d{4}|\d{6})(?:\D.*)?)?$", 1, 2, 3, 4),
    (rf"^(?:[a-z]{{3,9}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+({_MONTH})\.?,?[\s-]+(\d{{4}})((?:,|\s).*)?$", 3, 2, 1, 4),
    (rf"^(?:[a-z]{{3,9}},\s+)?({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})((?:,|\s).*)?$", 3, 1, 2, 4),
    (r"^(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})((?:,|\s).*)?$", 3, 2, 1, 4),
    (r"^(\d{4})\s?年\s?(\d{1,2})\s?月\s?(\d{1,2})\s?日(.*)?$", 1, 2, 3, 4),
    (r"^(1[3-9]|2\d|3[01])/(0?[1-9]|1[0-2])/(\d{4})((?:,|\s).*)?$", 3, 2, 1, 4),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})((?:,|\s).*)?$", 3, 1, 2, 4),
]
_TAIL = (
    r"^(?:t|,|\s|at\s)*(?:(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap]\.?m\.?)?)?"
    r"\s*(z|(?:utc|gmt)?\s*[+-]\d{1,2}:?(?:\d{2})?|[a-z]{2,5})?$"
)


def date_parts(v: Column) -> Column:
    """Array of year, month, day and rest, as texts, that a trimmed, lower-case text has; of one element where it has none.

    Every family rewrites the text to ``|year|month|day|rest``, which no later family matches.
    """
    out = v
    for pattern, y, m, d, rest in FAMILIES:
        out = F.regexp_replace(out, pattern, f"|${y}|${m}|${d}|${rest}")
    return F.split(out, r"\|", 5)


def time_parts(parts: Column) -> Column:
    """Array of hour, minute, second, fraction, half and zone of the rest of a text; of one element if it can't be read."""
    return F.split(F.regexp_replace(F.get(parts, F.lit(4)), _TAIL, "|$1|$2|$3|$4|$5|$6"), r"\|", 7)


def epoch_us(v: Column) -> Column:
    """Microseconds named by a text of 10, 13 or 16 digits, else null."""
    n = v.try_cast("long")
    return (
        F.when(v.rlike(r"^[0-9]{10}$"), n * 1000000)
        .when(v.rlike(r"^[0-9]{13}$"), n * 1000)
        .when(v.rlike(r"^[0-9]{16}$"), n)
    )


def calendar_day(parts: Column) -> Column:
    """The existing day that the parts name, else null."""
    part = lambda i: F.get(parts, F.lit(i))
    y, d = part(1).try_cast("int"), part(3).try_cast("int")
    named = (F.instr(F.lit(MONTHS), F.substring(part(2), 1, 3)) + 2) / 3
    m = F.when(part(2).rlike(r"^\d+$"), part(2).try_cast("int")).otherwise(named.cast("int"))
    iso = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when((F.size(parts) == 5) & y.between(1, 9999), iso.try_cast("date"))


def local_us(day: Column, time: Column) -> Column:
    """Microseconds since 1970-01-01 on the text's own clock; null unless day and time exist."""
    part = lambda i: F.get(time, F.lit(i))
    h, mi, s = (F.coalesce(part(i).try_cast("int"), F.lit(0)) for i in (1, 2, 3))
    half = F.substring(part(5), 1, 1)
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    us = F.rpad(part(4), 6, "0").try_cast("long")
    ok = (F.size(time) == 7) & hour.between(0, 23) & (mi <= 59) & (s <= 59)
    secs = F.unix_date(day).cast("long") * 86400 + hour * 3600 + mi * 60 + s
    return F.when(ok, secs * 1000000 + us)


def zone_text(time: Column) -> Column:
    """The zone that a text names, without blanks; null where it names none."""
    z = F.regexp_replace(F.get(time, F.lit(6)), r"\s", "")
    return F.when(z != "", z)


def zone_minutes(z: Column) -> Column:
    """Minutes east of UTC of a zone text; null if it is not known."""
    signed = F.split(F.regexp_replace(z, r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$", "$1|$2|0$3"), r"\|", 3)
    hours, mins = F.get(signed, F.lit(1)).try_cast("int"), F.get(signed, F.lit(2)).try_cast("int")
    numeric = F.when((hours <= 18) & (mins <= 59), F.when(F.get(signed, F.lit(0)) == "-", -1).otherwise(1) * (hours * 60 + mins))
    names = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    return F.coalesce(numeric, F.try_element_at(names, z))
