"""Dates and sums named in a quote, to hold values against."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Notations of dates with four and two digits of the year, and without year.
NOTATIONS = (
    r"[0-9]{4}\s*[.\-/년]\s*[0-9]{1,2}\s*[.\-/월]\s*[0-9]{1,2}",
    r"['‘’`´]\s*[0-9]{2}\s*[.\-/]\s*[0-9]{1,2}\s*[.\-/]\s*[0-9]{1,2}",
    r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{2}(?![0-9])",
    r"(?<![0-9][.\-/년]\s?)[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일",
    r"(?<![0-9.])[0-9]{1,2}\s*\.\s*[0-9]{1,2}\s*\.(?!\s*[0-9])",
    r"(?<![0-9.])[0-9]{1,2}\s*\.\s*[0-9]{1,2}\s*\(\s*[월화수목금토일]",
)
#: Any of them; of two that begin at one place the first counts.
DATE = "|".join(NOTATIONS)


def dates(text: Column) -> Column:
    """Distinct (year or null, month, day) of a text in order of appearance; months 1 to 12 and days 1 to 31, the calendar isn't asked.

    One scan over all notations, so a period's start comes before its end. Null for null.
    """
    numbers = F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), lambda m: F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int")))
    year = lambda n: F.when(F.size(n) == 3, F.when(n[0] < 100, n[0] + 2000).otherwise(n[0]))
    found = F.transform(numbers, lambda n: F.struct(year(n).alias("year"), F.element_at(n, -2).alias("month"), F.element_at(n, -1).alias("day")))
    return F.array_distinct(F.filter(found, lambda z: z["month"].between(1, 12) & z["day"].between(1, 31)))


def last_full_date(text: Column) -> Column:
    """The last date with a year, in any notation, which in a period is its end; as yyyy-m-d."""
    full = F.filter(dates(text), lambda z: z["year"].isNotNull())
    last = F.try_element_at(full, F.lit(-1))
    return F.when(last.isNotNull(), F.concat_ws("-", last["year"].cast("string"), last["month"].cast("string"), last["day"].cast("string")))


def names_date(iso: Column, text: Column) -> Column:
    """Whether an ISO date is among the text's dates; those without year match any."""
    y, m, d = (F.regexp_extract(iso, r"^([0-9]{4})-([0-9]{2})-([0-9]{2})\z", i).try_cast("int") for i in (1, 2, 3))
    return F.coalesce(F.exists(dates(text), lambda z: (z["month"] == m) & (z["day"] == d) & (z["year"].isNull() | (z["year"] == y))), F.lit(False))


#: Won that a unit counts; ten thousand counts alone only before won.
SUM_UNITS = {"억": 1e8, "천만": 1e7, "백만": 1e6, "만원": 1e4, "만": 1e4, "원": 1.0}


def sums(text: Column) -> Column:
    """Distinct sums in won, rounded; 1억 5천만원 gives the whole and its part. Null for null.

    One scan marks each number that has a unit; a fold over the marks then reads it with the next where only blanks are
    between them. A bare ten thousand, and won of less than four digits, count as parts only.
    """
    marked = F.regexp_replace(F.regexp_replace(text, ",", ""), r"([0-9]+(?:\.[0-9]+)?)\s*(억|천만|백만|만\s*원|만|원)", "\u0001$1\u0002$2\u0003")
    cells = F.transform(F.slice(F.split(marked, "\u0001"), 2, F.length(marked)), lambda x: F.split(F.regexp_replace(x, r"만\s+원\u0003", "만원\u0003"), "[\u0002\u0003]"))
    unit = F.create_map(*[F.lit(x) for kv in SUM_UNITS.items() for x in kv])
    value = lambda c: c[0].cast("double") * F.element_at(unit, c[1])
    whole = lambda c, i: value(c) + F.coalesce(F.when((c[1] == "억") & (F.trim(c[2]) == ""), F.when(F.get(cells, i + 1)[1].isin("천만", "백만", "만", "만원"), value(F.get(cells, i + 1)))), F.lit(0.0))
    counts = lambda c: (c[1] != "만") & ((c[1] != "원") | c[0].rlike(r"^[0-9]{4,}$|\.[0-9]{4,}$"))
    won = F.transform(cells, lambda c, i: F.when(counts(c), F.floor(F.when(c[1] == "원", F.regexp_extract(c[0], "[0-9]+$", 0).cast("double")).otherwise(whole(c, i)) + 0.5).cast("bigint")))
    return F.array_distinct(F.filter(won, lambda x: x.isNotNull()))


def names_sum(won: Column, text: Column) -> Column:
    return F.coalesce(F.array_contains(sums(text), won), F.lit(False))


def loose_date(text: Column) -> Column:
    """A date in eight digits or with separators anywhere in a text, else null."""
    p = r"((?:19|20)[0-9]{2})[-./년 ]{0,2}([0-9]{1,2})[-./월 ]{0,2}([0-9]{1,2})"
    y, m, d = (F.regexp_extract(text, p, i) for i in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def registered(record: Column) -> Column:
    """The day a domain was registered, out of a registry's JSON (its registration event) or text record; null where neither says."""
    events = F.from_json(record, "events array<struct<eventAction:string,eventDate:string>>")["events"]
    event = F.get(F.filter(events, lambda e: e["eventAction"] == "registration"), F.lit(0))["eventDate"]
    said = F.regexp_extract(record, r"(?i)(?:registered date|creation date|created)\s*:\s*([0-9]{4}[-./] ?[0-9]{2}[-./] ?[0-9]{2})", 1)
    return F.try_to_date(F.coalesce(F.substring(event, 1, 10), F.regexp_replace(said, "[./] ?", "-")), "yyyy-MM-dd")
