"""Rules on pages and quotes: trust in a source, risks, index pages, quotes that exist, values that they bear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.functions import facts, text as tx, urls

#: Signs of risk with their reasons, of announcements, of a notice's structure, and of lists.
RISKS = (
    (r"선\s*입금|보증금[^\n]{0,10}(?:입금|송금|납부)|수수료[^\n]{0,10}(?:입금|송금|납부|결제)", "advance payment"),
    (r"계좌[^\n]{0,12}(?:입금|송금|이체)|(?:아래|하단|하기)\s*계좌", "payment to an account"),
    (r"주민\s*등록\s*번호[^\n]{0,12}(?:요구|기재|입력|제출|전송|보내|필요|등록)", "resident number"),
    (r"텔레그램|(?i:telegram)|오픈\s*채팅|오픈\s*카톡|오픈카톡", "private messenger"),
    (r"(?:카카오톡|카톡)[^\n]{0,12}(?:개인|1:1|일대일|상담원|친구\s*추가)", "private chat"),
)
ANNOUNCING = (r"접수\s*기간", r"신청\s*기간", r"신청\s*방법", r"제출\s*서류", r"지원\s*대상", r"지원\s*자격", r"신청\s*자격", r"모집\s*공고", r"공고문", r"사업\s*개요", r"지원\s*내용", r"지원\s*규모", r"마감")
STRUCTURE = (r"접수\s*기간", r"신청\s*기간", r"신청\s*방법", r"제출\s*서류", r"지원\s*대상", r"지원\s*자격", r"신청\s*자격", r"사업\s*개요", r"지원\s*내용")
LISTING = (r"모집\s*공고", "마감", "공고")
MIN_HITS, MAX_STRUCTURE, MIN_REPEATS, NEW_DAYS = 3, 1, 8, 90


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    return sum((text.rlike(p).cast("int") for p in patterns[1:]), text.rlike(patterns[0]).cast("int"))


def risk(text: Column) -> Column:
    """The reason of the first risk sign, null where there is none."""
    return F.coalesce(*[F.when(text.rlike(p), reason) for p, reason in RISKS])


def is_index(text: Column) -> Column:
    """A list of notices rather than one: hardly any structure, but many markers."""
    return (hits(text, STRUCTURE) <= MAX_STRUCTURE) & (F.greatest(*[F.regexp_count(text, F.lit(p)) for p in LISTING]) >= MIN_REPEATS)


def _bits(text: Column, patterns: tuple[str, ...]) -> Column:
    """A bit for each pattern that occurs."""
    return sum((F.when(text.rlike(p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(patterns[1:], 1)), F.when(text.rlike(patterns[0]), F.lit(1)).otherwise(F.lit(0)))


#: The bits of ANNOUNCING that are signs of a notice's structure too; all of these are among them.
_STRUCTURE_BITS = sum(1 << ANNOUNCING.index(p) for p in STRUCTURE)
#: Signs of a text's edges that are kept to see what two texts make together; no pattern is longer without its blanks.
EDGE = 12


def document_signs(source_documents: DataFrame) -> DataFrame:
    """notice_id and docs: for each document, in order, what the rules need of it, so that no text is shuffled.

    docs has doc_ord, src_doc_id, risk, announcing (bits), listing (counts) and the text's edges without
    blanks. Repeated src_doc_id count once, of differing rows the smallest; null texts are left out.
    """
    t = F.col("text")
    signs = source_documents.where("text IS NOT NULL AND notice_id IS NOT NULL").select(
        "notice_id", "src_doc_id", "doc_ord", risk(t).alias("risk"), _bits(t, ANNOUNCING).alias("announcing"),
        F.array(*[F.regexp_count(t, F.lit(p)) for p in LISTING]).alias("listing"), F.substring(F.ltrim(t, F.lit(" \t\n\r")), 1, EDGE).alias("head"), F.right(F.rtrim(t, F.lit(" \t\n\r")), F.lit(EDGE)).alias("tail"),
    )
    own = [c for c in signs.columns if c != "src_doc_id"]
    one = signs.groupBy("src_doc_id").agg(F.min(F.struct(*own)).alias("d")).select("src_doc_id", "d.*")
    return one.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("doc_ord", "src_doc_id", "risk", "announcing", "listing", "head", "tail"))).alias("docs"))


def _together(docs: Column) -> dict[str, Column]:
    """Of the documents' texts with line ends between: bits of announcing, the largest count of listing."""
    seams = F.transform(F.slice(docs, F.lit(2), F.greatest(F.size(docs) - 1, F.lit(0))), lambda d, i: F.struct(F.get(docs, i)["tail"].alias("tail"), d["head"].alias("head")))
    both = F.transform(seams, lambda x: F.concat(x["tail"], F.lit("\n"), x["head"]))
    announcing = F.aggregate(F.concat(F.transform(docs, lambda d: d["announcing"]), F.transform(both, lambda x: _bits(x, ANNOUNCING))), F.lit(0), lambda a, x: a.bitwiseOR(x))
    across = lambda p: F.aggregate(seams, F.lit(0), lambda a, x: a + F.regexp_count(F.concat(x["tail"], F.lit("\n"), x["head"]), F.lit(p)) - F.regexp_count(x["tail"], F.lit(p)) - F.regexp_count(x["head"], F.lit(p)))
    total = lambda i: F.aggregate(docs, F.lit(0), lambda a, d: a + d["listing"][i])
    counts = [total(i) + across(p) for i, p in enumerate(LISTING)]
    return {"announcing": announcing, "listing": F.greatest(*counts)}


def precheck(notices: DataFrame, source_documents: DataFrame, public: tuple[str, ...], age_days: DataFrame | None = None) -> DataFrame:
    """notice_id, tier, reason and verdict: reject, pass_fast or needs_llm. The first rule that holds decides.

    age_days (host, days) is the age of domains, where it is known; a host that isn't there passes.
    """
    n = notices.groupBy("notice_id").agg(F.min(F.coalesce("final_url", "url")).alias("url"))
    n = n.withColumn("tier", urls.tier(F.col("url"), public)).join(document_signs(source_documents), "notice_id", "left")
    young = F.lit(False)
    if age_days is not None:
        n = n.withColumn("host", urls.host(F.col("url"))).join(age_days, "host", "left")
        young = F.coalesce(F.col("days") < NEW_DAYS, F.lit(False))
    n = n.withColumns(_together(F.col("docs"))).withColumn("first_risk", F.get("docs", F.lit(0))["risk"])
    index = F.coalesce((F.bit_count(F.col("announcing").bitwiseAND(F.lit(_STRUCTURE_BITS))) <= MAX_STRUCTURE) & (F.col("listing") >= MIN_REPEATS), F.lit(False))
    reason = F.when(F.col("tier") == "tier3", "source").when(F.col("first_risk").isNotNull(), F.col("first_risk")).when((F.col("tier") == "tier2") & young, "new domain").when(index, "index page")
    fast = (F.col("tier") == "tier1") & (F.coalesce(F.bit_count("announcing"), F.lit(0)) >= MIN_HITS)
    verdict = F.when(reason.isNotNull(), "reject").when(fast, "pass_fast").otherwise("needs_llm")
    return n.select("notice_id", "tier", reason.alias("reason"), verdict.alias("verdict"))


def quotes_exist(evidence: DataFrame, source_documents: DataFrame) -> DataFrame:
    """evidence_id, section, notice_id and found: whether any document of the notice holds the quote.

    Compared in match form, of at least four signs, or in tight form. Every document is brought into form once, before
    the join; a null quote is not found.
    """
    e = evidence.groupBy("evidence_id").agg(F.min(F.struct("notice_id", "section", "quote")).alias("e")).select("evidence_id", "e.*")
    d = source_documents.where("text IS NOT NULL").select("notice_id", "text").distinct()
    e, d = tx.with_nfkc(e, "quote", "q"), tx.with_nfkc(d, "text", "t")
    e = e.withColumn("q", tx.match_form(F.col("q"))).withColumn("qt", tx.tight_form(F.col("q")))
    d = d.select("notice_id", tx.match_form(F.col("t")).alias("t")).withColumn("tt", tx.tight_form(F.col("t")))
    hit = (F.length("q") >= 4) & (F.contains("t", "q") | (F.length("qt") >= 4) & F.contains("tt", "qt"))
    pairs = e.join(d, "notice_id", "left").select("evidence_id", "section", "notice_id", F.coalesce(hit, F.lit(False)).alias("hit"))
    return pairs.groupBy("evidence_id", "section", "notice_id").agg(F.max("hit").alias("found"))


CHECKED = ("apply_end", "apply_start", "amount_max_krw", "support_scale")


def _found(asked: DataFrame, keys: list[str], source_documents: DataFrame) -> DataFrame:
    """keys, quote and found: whether any document of the notice (column notice_id) holds the quote, see quotes_exist."""
    distinct = asked.where("quote IS NOT NULL").select("notice_id", "quote").distinct().withColumn("evidence_id", F.sha2(F.concat_ws("\u0000", "notice_id", "quote"), 256)).withColumn("section", F.lit(""))
    hits = quotes_exist(distinct, source_documents).select("evidence_id", "found")
    return asked.withColumn("evidence_id", F.sha2(F.concat_ws("\u0000", "notice_id", "quote"), 256)).join(hits, "evidence_id", "left").select(*keys, "quote", F.coalesce("found", F.lit(False)).alias("found"))


def _extracted(extractions: DataFrame) -> DataFrame:
    own = ["notice_id", "overview", "overview_evidence", "eligibility", "eligibility_evidence", "requirements", "exclusions", "documents", "schedule", "risk_points"]
    return extractions.groupBy("extraction_id").agg(F.min_by(F.struct(*own), F.xxhash64(*own[:2])).alias("e")).select("extraction_id", "e.*")


def value_checks(extractions: DataFrame, source_documents: DataFrame) -> DataFrame:
    """extraction_id, field, verdict, held and mismatched of deadlines, starts, sums and scales against their quotes.

    A null value is skipped. ok: some quote exists in a document of the notice and bears the value (a scale needs only
    the first); no_evidence: there is no quote; mismatch: none does both. held is whether the verdict isn't ok;
    mismatched counts quotes that exist but bear another value, also where another one is right.
    """
    x = _extracted(extractions).select("extraction_id", "notice_id", "overview", "overview_evidence")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"overview.{f}").cast("string").alias("value")) for f in CHECKED])
    rows = x.select("extraction_id", "notice_id", "overview_evidence", F.explode(cells).alias("c")).where("c.value IS NOT NULL").select("extraction_id", "notice_id", "c.field", "c.value", F.filter("overview_evidence", lambda e: e["field"] == F.col("c.field")).alias("own"))
    quotes = rows.select("extraction_id", "notice_id", "field", "value", F.explode_outer("own").alias("e")).select("extraction_id", "notice_id", "field", "value", F.col("e").isNotNull().alias("given"), "e.quote")
    q = _found(quotes, ["extraction_id", "field", "value", "given"], source_documents)
    bears = F.when(F.col("field").startswith("apply"), facts.names_date(F.col("value"), F.col("quote"))).when(F.col("field") == "amount_max_krw", facts.names_sum(F.col("value").try_cast("bigint"), F.col("quote"))).otherwise(True)
    out = q.groupBy("extraction_id", "field").agg(F.max("given").alias("given"), F.max(F.col("found") & bears).alias("ok"), F.count_if(F.col("found") & ~bears).alias("mismatched"))
    verdict = F.when(~F.col("given"), "no_evidence").when(F.col("ok"), "ok").otherwise("mismatch")
    return out.select("extraction_id", "field", verdict.alias("verdict"), (verdict != "ok").alias("held"), "mismatched")


def section_verdicts(extractions: DataFrame, source_documents: DataFrame) -> DataFrame:
    """extraction_id, section, ord, verified, held and counted of each item of the five sections.

    Without evidence or with an empty quote an item isn't verified; without evidence it is not held either, and only a
    quote counts. One with a quote is verified where a document of the notice holds it, else held.
    """
    x = _extracted(extractions)
    item = lambda s: F.transform(F.coalesce(F.col(s), F.filter(F.col(s), lambda r: F.lit(False))), lambda r, i: F.struct(F.lit(s).alias("section"), i.alias("ord"), r["evidence"].isNotNull().alias("given"), r["evidence"]["quote"].alias("quote")))
    arrays = [F.coalesce(item(s), F.array().cast("array<struct<section:string,ord:int,given:boolean,quote:string>>")) for s in ("requirements", "exclusions", "documents", "schedule", "risk_points")]
    rows = x.select("extraction_id", "notice_id", F.explode(F.concat(*arrays)).alias("i")).select("extraction_id", "notice_id", "i.*")
    q = _found(rows, ["extraction_id", "section", "ord", "given"], source_documents)
    return q.select("extraction_id", "section", "ord", F.col("found").alias("verified"), (F.col("given") & ~F.col("found")).alias("held"), (F.coalesce(F.col("quote") != "", F.lit(False))).alias("counted"))


def eligibility_verdicts(extractions: DataFrame, source_documents: DataFrame) -> DataFrame:
    """extraction_id, field and verdict (verified or unknown) of each eligibility field with a value: whether any of its quotes exists."""
    x = _extracted(extractions)
    fields = x.schema["eligibility"].dataType
    given = lambda f: F.coalesce(F.size(F.col(f"eligibility.{f.name}")) > 0, F.lit(False)) if f.dataType.typeName() == "array" else F.col(f"eligibility.{f.name}").isNotNull()
    named = F.filter(F.array(*[F.when(given(f), F.lit(f.name)) for f in fields]), lambda n: n.isNotNull())
    rows = x.select("extraction_id", "notice_id", "eligibility_evidence", F.explode(named).alias("field")).select("extraction_id", "notice_id", "field", F.explode_outer(F.filter("eligibility_evidence", lambda e: e["field"] == F.col("field"))).alias("e")).select("extraction_id", "notice_id", "field", "e.quote")
    q = _found(rows, ["extraction_id", "field"], source_documents)
    return q.groupBy("extraction_id", "field").agg(F.when(F.max("found"), "verified").otherwise("unknown").alias("verdict"))


def verification(extractions: DataFrame, source_documents: DataFrame) -> DataFrame:
    """extraction_id, quotes_total, quotes_passed and held: counters over items and checked values, and what is held, in order of name.

    A value with several quotes counts each; eligibility isn't counted.
    """
    items = section_verdicts(extractions, source_documents)
    values = value_checks(extractions, source_documents).select("extraction_id", F.concat(F.lit("overview."), F.col("field")).alias("place"), "held")
    places = items.select("extraction_id", F.concat("section", F.lit("["), F.col("ord").cast("string"), F.lit("]")).alias("place"), "held").unionByName(values)
    held = places.where("held").groupBy("extraction_id").agg(F.array_sort(F.collect_list("place")).alias("held"))
    x = _extracted(extractions)
    quotes = x.select("extraction_id", "notice_id", F.explode(F.filter("overview_evidence", lambda e: e["field"].isin(*CHECKED) & F.coalesce(e["quote"] != "", F.lit(False)))).alias("e"), "overview").select("extraction_id", "notice_id", "e.quote", F.coalesce(*[F.when(F.col("e.field") == f, F.col(f"overview.{f}").isNotNull()) for f in CHECKED]).alias("given")).where("given")
    counted = items.where("counted").select("extraction_id", F.col("verified").alias("found")).unionByName(_found(quotes, ["extraction_id"], source_documents).select("extraction_id", "found"))
    sums = counted.groupBy("extraction_id").agg(F.count("*").alias("quotes_total"), F.count_if("found").alias("quotes_passed"))
    rows = x.select("extraction_id").join(sums, "extraction_id", "left").join(held, "extraction_id", "left").fillna(0, ["quotes_total", "quotes_passed"])
    return rows.select("extraction_id", "quotes_total", "quotes_passed", F.coalesce("held", F.array().cast("array<string>")).alias("held"))


def deadline_conflicts(evidence: DataFrame) -> DataFrame:
    """extraction_id and dates of extractions whose quotes for the deadline end on different days, in any notation with a year."""
    q = evidence.where("field = 'apply_end' AND quote IS NOT NULL").select("extraction_id", facts.last_full_date(F.col("quote")).alias("day")).where("day IS NOT NULL")
    days = q.distinct().groupBy("extraction_id").agg(F.count("*").alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return days.where("n_days > 1")
