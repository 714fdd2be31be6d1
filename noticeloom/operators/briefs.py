"""Briefs: a notice's extraction with its verdicts as one record, as JSON and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.functions import text as tx
from noticeloom.operators import checks

SECTIONS = ("requirements", "exclusions", "documents", "schedule", "risk_points")
#: Headings of the sections, and the mark of what isn't verified.
HEADINGS = {"requirements": "자격 요건", "exclusions": "제외 대상", "documents": "필요 서류", "schedule": "일정", "risk_points": "탈락·감점 위험"}
UNVERIFIED = " ⚠(원문 확인 필요)"


def assembled(extractions: DataFrame, source_documents: DataFrame, contacts: DataFrame) -> DataFrame:
    """extraction_id, overview, the five sections as arrays of (shown, quote, verified), contact, quotes_total, quotes_passed and held.

    Verdicts are those of the checks; contacts are the notice's distinct ones. A section that is null is empty. Every
    extraction has a row, whatever it lacks; repeated rows count once.
    """
    own = ["notice_id", "overview", *SECTIONS]
    x = extractions.groupBy("extraction_id").agg(F.min_by(F.struct(*own), F.xxhash64("notice_id", "overview")).alias("e")).select("extraction_id", "e.*")
    show = {"documents": lambda r: F.concat(F.coalesce(r["name"], F.lit("")), F.when(r["note"] != "", F.concat(F.lit(" — "), r["note"])).otherwise("")), "schedule": lambda r: F.concat(F.coalesce(r["label"], F.lit("")), F.lit(": "), F.coalesce(r["date_text"], F.lit("")))}
    verdicts = checks.section_verdicts(extractions, source_documents).where("verified").groupBy("extraction_id").agg(F.collect_set(F.concat("section", F.lit("["), F.col("ord").cast("string"), F.lit("]"))).alias("good"))
    x = x.join(verdicts, "extraction_id", "left").join(checks.verification(extractions, source_documents), "extraction_id", "left")
    reach = contacts.select("notice_id", F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("phones", "emails")]).alias("c")).groupBy("notice_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("contact"))
    x = x.join(reach, "notice_id", "left")
    good = F.coalesce("good", F.array().cast("array<string>"))
    items = lambda s: F.coalesce(F.transform(F.col(s), lambda r, i: F.struct(F.coalesce(show.get(s, lambda r: r["text"])(r), F.lit("")).alias("shown"), r["evidence"]["quote"].alias("quote"), F.array_contains(good, F.concat(F.lit(f"{s}["), i.cast("string"), F.lit("]"))).alias("verified"))), F.array().cast("array<struct<shown:string,quote:string,verified:boolean>>"))
    brief = x.select("extraction_id", "overview", *[items(s).alias(s) for s in SECTIONS], F.filter(F.coalesce("contact", F.array().cast("array<string>")), lambda c: c.isNotNull()).alias("contact"), "quotes_total", "quotes_passed", "held")
    return tx.publishable_record(brief)


def advice(extractions: DataFrame, source_documents: DataFrame) -> DataFrame:
    """extraction_id, ord, segment and advice of each verified requirement that has any."""
    x = extractions.groupBy("extraction_id").agg(F.min_by(F.struct("requirements"), F.xxhash64("notice_id", "overview")).alias("e"))
    rows = x.select("extraction_id", F.posexplode("e.requirements").alias("ord", "r")).select("extraction_id", "ord", F.explode("r.branch_advice").alias("segment", "advice"))
    good = checks.section_verdicts(extractions, source_documents).where("section = 'requirements' AND verified").select("extraction_id", "ord")
    return rows.join(good, ["extraction_id", "ord"])


#: Rules in order: what the place begins with, and how many of such places are asked about.
INQUIRIES, MOST = (("overview.apply_end", 1), ("overview.amount_max_krw", 1), ("requirements[", 3), ("documents[", 2)), 8


def inquiries(verified: DataFrame) -> DataFrame:
    """extraction_id and places to ask about: the held ones by rule, at most so many a rule and MOST in all."""
    number = lambda h: F.coalesce(F.regexp_extract(h, r"\[([0-9]+)\]", 1).try_cast("int"), F.lit(0))
    one = lambda start, n: F.slice(F.transform(F.array_sort(F.transform(F.filter("held", lambda h: h.startswith(start)), lambda h: F.struct(number(h).alias("n"), h.alias("h")))), lambda x: x["h"]), 1, n)
    places = F.slice(F.concat(*[one(start, n) for start, n in INQUIRIES]), 1, MOST)
    return verified.select("extraction_id", places.alias("places")).where(F.size("places") > 0)


def for_agents() -> Column:
    """A row of assembled as text for a program that must not take it for orders: no contacts, quotes numbered and apart."""
    quotes = F.transform(F.filter(F.flatten(F.array(*SECTIONS)), lambda r: r["verified"]), lambda r: r["quote"])
    parts = [F.when(F.size(s) > 0, F.concat(F.lit(f"{HEADINGS[s]}\n"), F.array_join(F.transform(s, lambda r: F.concat(F.lit("- "), r["shown"], F.when(~r["verified"], UNVERIFIED).otherwise(""))), "\n"))) for s in SECTIONS]
    data = F.when(F.size(quotes) > 0, F.concat(F.lit("<quotes>\n"), F.array_join(F.transform(quotes, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n"), F.lit("\n</quotes>")))
    return F.concat_ws("\n\n", F.coalesce("overview.title", F.lit("")), *parts, data)


def markdown() -> Column:
    """The Markdown of a row of assembled; a section without items is left out, requirements are never."""
    o = F.col("overview")
    some = lambda c, *parts: F.when(c.isNotNull() & (c != ""), F.concat(F.lit("**"), *parts, F.lit("**")))
    sum_ = F.when(o["amount_max_krw"].isNotNull(), F.concat(F.lit("**지원금: 최대 "), tx.money(o["amount_max_krw"]), F.lit("**"))).otherwise(some(o["amount_note"], o["amount_note"]))
    end = F.concat(F.lit("**마감: "), F.coalesce(o["apply_end"], F.lit("공고 확인")), F.coalesce(F.concat(F.when(o["apply_end"].isNotNull(), F.lit(" ")), o["apply_end_time"]), F.lit("")), F.lit("**"))
    facts = F.concat_ws(" · ", some(o["organizer"], F.lit("주관: "), o["organizer"]), sum_, some(o["support_scale"], F.lit("규모: "), o["support_scale"]), end, some(o["self_funding_note"], F.lit("자부담: "), o["self_funding_note"]))
    line = lambda r, quoted: F.concat(F.lit("- "), r["shown"], F.when(r["verified"], F.concat(F.lit('\n  > "'), r["quote"], F.lit('"')) if quoted else F.lit("")).otherwise(UNVERIFIED))
    part = lambda s: F.concat(F.lit(f"## {HEADINGS[s]}\n"), F.array_join(F.transform(s, lambda r: line(r, s == "requirements")), "\n"))
    parts = [part(s) if s == "requirements" else F.when(F.size(s) > 0, part(s)) for s in SECTIONS]
    reach = F.when(F.size("contact") > 0, F.concat(F.lit("## 문의처\n- "), F.array_join("contact", ", ")))
    foot = F.concat(F.lit("---\n인용 검증 "), F.col("quotes_passed").cast("string"), F.lit("/"), F.col("quotes_total").cast("string"), F.lit(" 통과"), F.when(F.size("held") > 0, F.concat(F.lit(" · 보류 "), F.size("held").cast("string"), F.lit("건"))).otherwise(""))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce(o["title"], F.lit(""))), facts, *parts, reach, foot)


def terminal(text: Column) -> Column:
    """Markdown for a terminal: headings set off, quotes indented."""
    t = F.regexp_replace(text, r"(?m)^# (.+)$", "\n━━━ $1 ━━━")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)^## (.+)$", "\n■ $1"), r"(?m)^> ", "  ")


def write_briefs(briefs: DataFrame, folder: str) -> None:
    """Each brief as a line of JSON (brief) and its Markdown, partitioned by nothing: one row a brief, whatever its size."""
    briefs.select("extraction_id", F.to_json(F.struct("*")).alias("brief"), markdown().alias("markdown")).write.mode("error").json(folder)
