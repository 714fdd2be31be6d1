from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import facts, text as tx, urls
from noticeloom.operators import agreement, briefs, checks, collection, reports

KIND = """extraction_id bigint, notice_id bigint, run int, overview struct<title:string,organizer:string,apply_start:string,apply_end:string,apply_end_time:string,amount_max_krw:bigint,amount_note:string,support_scale:string,self_funding_note:string>,
overview_evidence array<struct<field:string,quote:string,source_url:string>>, eligibility struct<allows_pre_startup:boolean,excludes_pre_startup:boolean,requires_business_registration:boolean,min_startup_years:double,max_startup_years:double,min_age:int,max_age:int,max_revenue_krw:bigint,max_employees:int,target_regions:array<string>,required_certifications:array<string>,excluded_targets:array<string>>,
eligibility_evidence array<struct<field:string,quote:string,source_url:string>>, requirements array<struct<text:string,evidence:struct<quote:string,source_url:string>,branch_advice:map<string,string>>>, exclusions array<struct<text:string,evidence:struct<quote:string,source_url:string>>>,
risk_points array<struct<text:string,evidence:struct<quote:string,source_url:string>>>, documents array<struct<name:string,note:string,evidence:struct<quote:string,source_url:string>>>, schedule array<struct<label:string,date_text:string,evidence:struct<quote:string,source_url:string>>>, confidence double, field string"""


def run(i, notice, n, overview=None, evidence=None, eligibility=None, requirements=None, documents=None, confidence=0.5):
    o = {"title": "공고", **dict.fromkeys("organizer apply_start apply_end apply_end_time amount_max_krw amount_note support_scale self_funding_note".split()), **(overview or {})}
    e = {**dict.fromkeys("allows_pre_startup excludes_pre_startup requires_business_registration min_startup_years max_startup_years min_age max_age max_revenue_krw max_employees target_regions required_certifications excluded_targets".split()), **(eligibility or {})}
    quoted = lambda q: None if q is None else {"quote": q, "source_url": "u"}
    reqs = [{"text": t, "evidence": quoted(q), "branch_advice": None} for t, q in requirements or []]
    docs = [{"name": t, "note": None, "evidence": quoted(q)} for t, q in documents or []]
    ev = [{"field": f, "quote": q, "source_url": "u"} for f, q in evidence or []]
    return {"extraction_id": i, "notice_id": notice, "run": n, "overview": o, "overview_evidence": ev, "eligibility": e, "eligibility_evidence": [], "requirements": reqs, "exclusions": None, "risk_points": None, "documents": docs, "schedule": None, "confidence": confidence, "field": "x"}


def table(spark, *rows):
    return spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in ("extraction_id", "notice_id", "run", "overview", "overview_evidence", "eligibility", "eligibility_evidence", "requirements", "exclusions", "risk_points", "documents", "schedule", "confidence", "field")) for r in rows], KIND)


def test_two_runs(spark):
    a = run(1, 7, 1, {"organizer": "가나 재단", "apply_end": "ＡＢ·c", "amount_max_krw": 5}, [("organizer", "x"), ("title", "t"), ("apply_end", "y")], {"min_age": 3, "target_regions": ["서울", "부산", "부산"]}, [("첫째", "같은 문장이다"), ("둘째", "가"), ("셋째", None)], confidence=0.9)
    b = run(2, 7, 2, {"organizer": "가나  재단", "apply_end": "ab・c", "amount_max_krw": 6}, [], {"min_age": 3, "target_regions": [" 부산"]}, [("다른", "여기 같은 문장이다."), ("둘째", ""), ("셋째", "")], confidence=0.4)
    df = table(spark, a, a, b, run(3, 8, 1, confidence=0.7))
    got = {r["field"]: r["agreed"] for r in agreement.scalar_agreement(df).collect()}
    assert got == {"overview.organizer": True, "overview.apply_end": False, "overview.amount_max_krw": False, "eligibility.min_age": True}
    assert [tuple(r)[2:] for r in agreement.array_agreement(df).collect()] == [(3, 2, False)]
    # one quote in the other; under four signs quotes stand for nothing, but an empty one leaves the texts to decide
    assert {r["ord"]: r["stable"] for r in agreement.item_stability(df).collect()} == {0: True, 1: True, 2: True}
    rows = {r["notice_id"]: r for r in agreement.confirmed(df).collect()}
    assert rows[7]["dropped"] == ["overview.amount_max_krw", "overview.apply_end"] and rows[7]["n_overview"] == 2 and rows[7]["confidence"] == 0.4
    assert rows[8]["dropped"] is None and rows[8]["confidence"] == 0.7
    assert tuple(agreement.agreement_counts(df).first()) == (5, 2, 3, 3)
    assert agreement.scalar_agreement(df.limit(0)).collect() == [] and agreement.confirmed(df.limit(0)).collect() == []


def test_value_and_section_verdicts(spark):
    docs = spark.createDataFrame([(7, "신청은 2026. 8. 1. ~ 2026. 8. 14. 까지, 최대 5천만원 지원\n규모 20개사", "x")], "notice_id bigint, text string, quote string")
    x = run(1, 7, 1, {"apply_end": "2026-08-14", "apply_start": "2026-08-02", "amount_max_krw": 50_000_000, "support_scale": "20개사"}, [("apply_end", "2026. 8. 1. ~ 2026. 8. 14."), ("apply_end", "2026. 8. 13."), ("apply_start", "2026. 8. 1."), ("amount_max_krw", "총 5천만원을 준다")], {"min_age": 3}, [("a", "신청은 2026"), ("b", "없는 문장"), ("c", None)])
    df = table(spark, x, x)
    got = {r["field"]: (r["verdict"], r["mismatched"]) for r in checks.value_checks(df, docs).collect()}
    # a quote that no document has doesn't bear a value, whatever it names
    assert got == {"apply_end": ("ok", 0), "apply_start": ("mismatch", 1), "amount_max_krw": ("mismatch", 0), "support_scale": ("no_evidence", 0)}
    assert sorted(tuple(r)[2:] for r in checks.section_verdicts(df, docs).collect()) == [(0, True, False, True), (1, False, True, True), (2, False, False, False)]
    assert [tuple(r) for r in checks.eligibility_verdicts(df, docs).collect()] == [(1, "min_age", "unknown")]
    v = checks.verification(df, docs).first()
    assert (v["quotes_total"], v["quotes_passed"], v["held"]) == (6, 3, ["overview.amount_max_krw", "overview.apply_start", "overview.support_scale", "requirements[1]"])
    contacts = spark.createDataFrame([(7, ["02-1", None], None), (7, ["02-1"], ["a@b"])], "notice_id bigint, phones array<string>, emails array<string>")
    text = briefs.assembled(df, docs, contacts).select(briefs.markdown().alias("m")).first()["m"]
    assert text.startswith("# 공고\n\n**지원금: 최대 5,000만원** · **규모: 20개사** · **마감: 2026-08-14**\n\n## 자격 요건\n- a\n  > \"신청은 2026\"\n- b ⚠(원문 확인 필요)") and "- 02-1, a@b" in text and text.endswith("인용 검증 3/6 통과 · 보류 4건")
    apart = briefs.assembled(df, docs, contacts).select(briefs.for_agents().alias("t")).first()["t"]
    assert "02-1" not in apart and apart.endswith("<quotes>\n1. 신청은 2026\n</quotes>") and "- b ⚠(원문 확인 필요)" in apart
    assert briefs.inquiries(checks.verification(df, docs)).first()["places"] == ["overview.amount_max_krw", "requirements[1]"]
    assert briefs.advice(df, docs).collect() == []
    shown = spark.createDataFrame([(text,)], "t string").select(briefs.terminal(F.col("t"))).first()[0]
    assert "━━━ 공고 ━━━" in shown and "\n■ 자격 요건" in shown
    assert checks.verification(df.limit(0), docs).collect() == []


def test_write_briefs(spark, tmp_path):
    df = table(spark, run(1, 7, 1))
    docs = spark.createDataFrame([], "notice_id bigint, text string")
    contacts = spark.createDataFrame([], "notice_id bigint, phones array<string>, emails array<string>")
    briefs.write_briefs(briefs.assembled(df, docs, contacts), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == 1


@pytest.mark.parametrize(("text", "days", "last"), [("기간 '25. 3. 4. ~ ’25. 9. 8.", [(2025, 3, 4), (2025, 9, 8)], "2025-9-8"), ("5월 6일부터 2025년 7월 8일", [(None, 5, 6), (2025, 7, 8)], "2025-7-8"), ("3. 4(수) 25.01.02", [(None, 3, 4), (2025, 1, 2)], "2025-1-2"), ("1. 2. 3. 4.", [(None, 3, 4)], None), ("14. 40.", [], None), ("", [], None), (None, None, None)])
def test_dates_in_order(spark, text, days, last):
    r = spark.createDataFrame([(text,)], "t string").select(facts.dates(F.col("t")).alias("d"), facts.last_full_date(F.col("t")).alias("l")).first()
    assert (None if r["d"] is None else [tuple(x) for x in r["d"]], r["l"]) == (days, last)


@pytest.mark.parametrize(("text", "won"), [("2억 3백만원", [203_000_000, 3_000_000]), ("0.5억", [50_000_000]), ("7만", []), ("7만 원, 999원, 12,500원", [70_000, 12_500]), ("3억, 4천만원", [340_000_000, 40_000_000]), (None, None)])
def test_sums_by_scan(spark, text, won):
    assert spark.createDataFrame([(text,)], "t string").select(facts.sums(F.col("t"))).first()[0] == won


def test_small_forms(spark):
    one = lambda v, make, kind="string": spark.createDataFrame([(v,)], f"v {kind}").select(make(F.col("v"))).first()[0]
    assert [one(x, tx.money, "bigint") for x in (3 * 10**8, 123_456_789, 45_678_901, 0, None)] == ["3억원", "1.2억원", "4,568만원", "0만원", None]
    now = F.lit(datetime(2026, 1, 1, 12)).cast("timestamp")
    assert [one(x, lambda c: tx.days_left(c, now)) for x in ("2026-01-01", "2026-01-03", "2025-12-30", "", None)] == ["D-1", "D-3", "마감", "상시/미확인", "상시/미확인"]
    assert one("https://k-startup.go.kr/a/bizpbanc-deadline.do?pbancSn=3", urls.sibling) == "https://k-startup.go.kr/a/bizpbanc-ongoing.do?pbancSn=3" and one("https://blog.other.example/", urls.sibling) is None
    assert one("문의 Telegram 으로", checks.risk) == "private messenger" and one("TELEGRAM", checks.risk) == "private messenger"


def test_percentile_by_stretches(spark):
    rows = [("a", float(v)) for v in [1] * 50 + list(range(100)) + [10**6]] + [("b", 7.0)] * 9 + [("c", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY v)").alias("p")).collect()}
    assert {r["g"]: r["p90"] for r in reports.durations(df, "g", "v").collect()} == want
    assert reports.durations(df.limit(0), "g", "v").collect() == []


def at_second(n):
    return datetime(2026, 1, 1) + timedelta(seconds=n)


def test_throttle_by_slices(spark):
    at = [0, 1, 3599, 3601, 7300, 7301, 20000]
    df = spark.createDataFrame([("k", i, at_second(t)) for i, t in enumerate(at)] + [("k", 9, None), (None, 8, at_second(1))], "k string, i int, t timestamp")
    assert {(r["i"], r["gap_us"]) for r in collection.throttled(df, "k", "t", "i", 3).collect()} == {(1, 10**6), (3, 2 * 10**6), (5, 10**6)}


def test_precheck_over_seams(spark):
    notices = spark.createDataFrame([(1, "https://a.go.kr/1", None), (2, "https://b.example/2", None), (3, "https://b.example/3", None)], "notice_id bigint, url string, final_url string")
    docs = spark.createDataFrame([(1, 1, 0, "접수"), (2, 1, 1, " 기간 신청 방법"), (3, 1, 2, "제출 서류"), (4, 2, 0, "아래 계좌로"), (5, 3, 0, "모집"), (6, 3, 1, "공고 " + "모집 공고 " * 7), (6, 3, 1, "공고 " + "모집 공고 " * 7)], "src_doc_id bigint, notice_id bigint, doc_ord int, text string")
    got = {r["notice_id"]: (r["verdict"], r["reason"]) for r in checks.precheck(notices, docs, ()).collect()}
    assert got == {1: ("pass_fast", None), 2: ("reject", "payment to an account"), 3: ("reject", "index page")}
