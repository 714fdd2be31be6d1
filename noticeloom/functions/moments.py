"""Moments of a call: many notations, precisions and zones, one unambiguous instant.

An ordered cascade of anchored patterns, each parsed strictly: a text that no pattern covers whole, or whose fields
form no date, is no moment. The first pattern that covers the text takes all its fields out in one pass, in one order for
all notations; what follows is arithmetic on them. Everything is a Spark expression, in steps of a projection each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Names of zones in texts. Letter zones with a season are fixed offsets, the others are regions.
ZONES = {
    "KST": "+09:00", "JST": "+09:00", "SGT": "+08:00", "UTC": "+00:00", "GMT": "+00:00", "BST": "+01:00", "CET": "+01:00",
    "CEST": "+02:00", "EST": "-05:00", "EDT": "-04:00", "PST": "-08:00", "PDT": "-07:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "Z": "+00:00", "ET": "America/New_York", "PT": "America/Los_Angeles", "CT": "America/Chicago",
    "한국시간": "Asia/Seoul", "Berlin time": "Europe/Berlin", "London time": "Europe/London", "Seoul time": "Asia/Seoul",
    "Tokyo time": "Asia/Tokyo", "Singapore time": "Asia/Singapore", "New York time": "America/New_York",
    "Los Angeles time": "America/Los_Angeles", "Paris time": "Europe/Paris",
}
#: Month names.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

DAY = r"(?:\s?\((?:월|화|수|목|금|토|일)(?:요일)?\))?"
CLOCK = r"(?:\s+(오전|오후)?\s*(\d{1,2})(?::|시)\s*(?:(\d{1,2})분?)?(?::(\d{2})(?:[.,]\d{1,9})?)?\s*(AM|PM|am|pm)?)?"
ZONE = r"(?:\s*\(?(Z|[+-]\d{2}:?\d{2}|[A-Z][A-Za-z]+/[A-Za-z_/]+|(?:한국|현지)\s?시간|[A-Z][A-Za-z]+(?: [A-Z][a-z]+)? time|[A-Z]{2,4})\)?)?"
YEAR2 = r"['‘’`]?(\d{2})"


@dataclass(frozen=True)
class Form:
    """One notation. groups: places of year, month, day, half of day, hour, minute, second, AM/PM and zone, 0 for none."""

    name: str
    pattern: str
    groups: tuple[int, ...]


_CLOCKED = (1, 2, 3, 4, 5, 6, 7, 8, 9)
#: The first form whose pattern covers the whole text decides.
FORMS = (
    Form("iso", r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d{1,9})?)?)?" + ZONE, (1, 2, 3, 0, 4, 5, 6, 0, 7)),
    Form("dotted", r"(\d{4})[./]\s?(\d{1,2})[./]\s?(\d{1,2})\.?" + DAY + CLOCK + ZONE, _CLOCKED),
    Form("korean", r"(\d{4})년\s?(\d{1,2})월\s?(\d{1,2})일" + DAY + CLOCK + ZONE, _CLOCKED),
    Form("short year", YEAR2 + r"[.]\s?(\d{1,2})[.]\s?(\d{1,2})\.?" + DAY + CLOCK + ZONE, _CLOCKED),
    Form("compact", r"(20\d{2})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(?:\d{2})?)?", (1, 2, 3, 0, 4, 5, 0, 0, 0)),
    Form("day first", r"(\d{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? (\d{4})" + CLOCK + ZONE, (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    Form("month first", r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? (\d{1,2}), (\d{4})" + CLOCK + ZONE, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    Form("no year", r"(\d{1,2})\.\s?(\d{1,2})\.?" + DAY + CLOCK + ZONE, (0, 1, 2, 3, 4, 5, 6, 7, 8)),
    Form("no year, korean", r"(\d{1,2})월\s?(\d{1,2})일" + DAY + CLOCK + ZONE, (0, 1, 2, 3, 4, 5, 6, 7, 8)),
)


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def strip_frame(text: Column) -> Column:
    """A period stands for its end; words around a deadline are dropped."""
    end = F.element_at(F.split(text, r"[~∼～〜]"), -1)
    return F.trim(F.regexp_replace(end, r"(?U)^\s*(?:마감\s*:?)?\s*|\s*(?:까지|마감|한)?\s*$", ""))


def _hour24(half: Column, hour: Column) -> Column:
    """12-hour clocks go from 12 (0) to 11; null where the hour can't be."""
    pm = half.isin("오후", "PM", "pm")
    return F.when(half == "", F.when(hour <= 24, hour)).when((hour >= 1) & (hour <= 12), F.pmod(hour, F.lit(12)) + F.when(pm, 12).otherwise(0))


def clock_minutes(text: Column) -> Column:
    """Minutes of the day of a text that is a clock time only, else null."""
    p = r"^\s*(오전|오후)?\s*(\d{1,2})(?::|시)\s*(?:(\d{1,2})분?)?(?::\d{2})?\s*(AM|PM|am|pm)?\s*$"
    g = [F.regexp_extract(text, p, i) for i in (1, 2, 3, 4)]
    hour = _hour24(F.concat(g[0], g[3]), _int(g[1]))
    minute = F.coalesce(_int(g[2]), F.lit(0))
    total = hour * 60 + minute
    return F.when((minute < 60) & (total <= 1440), total)


def _shift(day: Column, minutes: Column, zone: Column) -> Column:
    """The instant, as UTC without zone, of a local day and minutes since its start.

    A clock time that occurs twice is the earlier one; one that is skipped counts with the offset before the change:
    both are what the zone rules of java.time do for a local time. An unknown zone gives null.
    """
    wall = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(mins=minutes)
    return F.when(zone.rlike(r"^(?:[A-Z][A-Za-z]+/[A-Za-z_/]+|[+-]\d{2}:\d{2}|UTC)$"), F.convert_timezone(zone, F.lit("UTC"), wall))


def _zone(word: Column, default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    tight = F.regexp_replace(word, r"(국|지)\s시간", "$1시간")
    offset = F.regexp_replace(word, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    return (
        F.when((word == "") | (tight == "현지시간"), default)
        .when(word.rlike(r"^[+-]\d"), offset)
        .when(word.contains("/"), word)
        .otherwise(F.element_at(table, tight))
    )


#: Between the fields of a text, in the order of Form.groups; no notation has it.
_GAP = "\u0001"


def _fields(text: Column) -> Column:
    """The nine fields of the first form that covers the text, empty where the form hasn't one; null where none covers it."""
    out = None
    for f in FORMS:
        p = f"^(?:{f.pattern})$"
        century = "20" if f.name == "short year" else ""
        row = F.regexp_replace(text, p, _GAP.join([century * (k == 0) + (f"${i}" if i else "") for k, i in enumerate(f.groups)]))
        out = F.when(text.rlike(p), row) if out is None else out.when(text.rlike(p), row)
    return F.split(out, _GAP)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def with_moment(df: DataFrame, text: str, posted: str, zone: str, out: str, bare_minutes: str | None = None) -> DataFrame:
    """Adds the minute in UTC (timestamp without zone) that a text names, or null.

    posted: when the notice was posted, for dates without year. zone: IANA name for times that state none.
    bare_minutes: minutes of the day that stand for a bare date, 23:59 where null. All are columns of df.
    Seconds and fractions are dropped; 24:00 is the start of the next day. Null and empty texts name no moment.
    """
    own = df.columns
    df = df.withColumn("_t", strip_frame(F.col(text)))
    df = df.withColumn("_g", _fields(F.col("_t")))
    g = [F.get("_g", F.lit(i)) for i in range(9)]
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    hour, minute = _hour24(F.concat(g[3], g[7]), _int(g[4])), F.coalesce(_int(g[5]), F.lit(0))
    bare = F.coalesce(bare_minutes, F.lit(1439)) if bare_minutes else F.lit(1439)
    df = df.select(
        *own, "_t", _int(g[0]).alias("_y"), F.coalesce(_int(g[1]), F.element_at(names, g[1])).alias("_m"), _int(g[2]).alias("_d"), (g[0] == "").alias("_any"),
        F.when(g[4] == "", bare).when((minute < 60) & (hour * 60 + minute <= 1440), hour * 60 + minute).alias("_min"), _zone(g[8], F.col(zone)).alias("_z"),
    )
    at = lambda y: _date(y, F.col("_m"), F.col("_d"))
    # the 29th of February may be up to eight years away
    years = F.filter(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: at(F.year(posted) + k)), lambda d: d.isNotNull() & (d >= F.to_date(posted)))
    df = df.withColumn("_day", F.when(F.col("_any"), F.try_element_at(years, F.lit(1))).otherwise(at(F.col("_y"))))
    t = F.col("_t")
    seconds = F.when(t.rlike(r"^1\d{9}$"), t.try_cast("bigint")).when(t.rlike(r"^1\d{12}$"), F.floor(t.try_cast("bigint") / 1000))
    epoch = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    named = F.when(F.col("_day").isNotNull() & F.col("_min").isNotNull(), _shift(F.col("_day"), F.col("_min"), F.col("_z")))
    return df.select(*own, F.when(seconds.isNotNull(), epoch + F.make_dt_interval(mins=F.floor(seconds / 60).cast("int"))).otherwise(named).alias(out))
