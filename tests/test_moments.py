from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeloom.functions.moments import clock_minutes, with_moment
from noticeloom.operators.call_times import call_moments, same_minute

POSTED = datetime(2024, 3, 1)
CASES = [
    ("2024-04-07T07:00:00Z", "Asia/Seoul", "2024-04-07 07:00"), ("2024. 3. 30.(토) 24:00", "Asia/Seoul", "2024-03-30 15:00"),
    ("'24. 6. 24.", "Asia/Seoul", "2024-06-24 14:59"), ("‘25.10.9. 00:00", "Asia/Seoul", "2025-10-08 15:00"), ("20240505", "Asia/Seoul", "2024-05-05 14:59"),
    ("202406071700", "Asia/Seoul", "2024-06-07 08:00"), ("1717815600", "Asia/Seoul", "2024-06-08 03:00"), ("1712761140250", "Asia/Seoul", "2024-04-10 14:59"),
    ("2024년 12월 3일(화) 오후 4시", "Asia/Seoul", "2024-12-03 07:00"), ("2024년 11월 7일(목) 오전 12시", "Asia/Seoul", "2024-11-06 15:00"),
    ("2025. 1. 31. 15:00 (한국시간)", "Europe/Berlin", "2025-01-31 06:00"), ("2025-02-23 15:00 (현지시간)", "Europe/Berlin", "2025-02-23 14:00"),
    ("21 Feb 2025 12:00 KST", "Europe/Berlin", "2025-02-21 03:00"), ("Aug 1, 2024 5:00 AM EDT", "Asia/Seoul", "2024-08-01 09:00"),
    ("6 Jul 2025 10:00 PT", "Asia/Seoul", "2025-07-06 17:00"), ("1 Jun 2025 11:30 Berlin time", "Asia/Seoul", "2025-06-01 09:30"),
    ("2024-08-01T23:59:00.123456-0700", "Asia/Seoul", "2024-08-02 06:59"), ("2024/06/07 12:30 AM", "Asia/Seoul", "2024-06-06 15:30"),
    ("6. 28.(일) 18:00", "Asia/Seoul", "2024-06-28 09:00"), ("2월 27일 오전 8시 59분", "Asia/Seoul", "2025-02-26 23:59"), ("2. 29.", "Asia/Seoul", "2028-02-29 14:59"),
    ("2024-06-21 ~ 2024. 9. 6.(금) 23:59", "Asia/Seoul", "2024-09-06 14:59"), ("~ 25.09.25까지", "Asia/Seoul", "2025-09-25 14:59"), ("2024.10.4 마감", "Asia/Seoul", "2024-10-04 14:59"),
    # twice: the earlier; skipped: the offset before the change
    ("2024-11-03 01:30", "America/New_York", "2024-11-03 05:30"), ("2024-03-10 02:30", "America/New_York", "2024-03-10 07:30"),
    ("2024년 4월 중", "Asia/Seoul", None), ("8월 중순", "Asia/Seoul", None), ("예산 소진 시까지", "Asia/Seoul", None), ("2024-02-30", "Asia/Seoul", None), ("2024-04-01 25:00", "Asia/Seoul", None),
    ("2024-04-01 10:00", None, None), ("2024-04-01 10:00 XYZ", "Asia/Seoul", None), ("", "Asia/Seoul", None), (None, "Asia/Seoul", None), ("x" * 100_000, "Asia/Seoul", None),
]


def test_moments(spark):
    rows = [(i, t, z, POSTED) for i, (t, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string, z string, p timestamp")
    got = {r["i"]: r["m"] for r in with_moment(df, "t", "p", "z", "m").select("i", F.date_format("m", "yyyy-MM-dd HH:mm").alias("m")).collect()}
    assert {c[0]: got[i] for i, c in enumerate(CASES)} == {c[0]: c[2] for c in CASES}


@pytest.mark.parametrize(("text", "minutes"), [("17:00", 1020), ("오후 12시", 720), ("오전 2시 30분", 150), ("24:00", 1440), ("25:00", None), ("", None), (None, None)])
def test_clock(spark, text, minutes):
    assert spark.createDataFrame([(text,)], "t string").select(clock_minutes(F.col("t"))).first()[0] == minutes


def test_same_minute(spark):
    kind = "extraction_id bigint, notice_id bigint, overview struct<apply_end:string,apply_end_time:string>, schedule array<struct<label:string,date_text:string>>, extra string"
    rows = [(1, 1, ("2024-05-02", "17:00"), [("a", "2024-05-02 08:00 UTC"), ("b", None), ("c", "2024-05-02")], "x")] * 2 + [(2, 9, ("2024-05-02", None), None, "x"), (3, 1, None, [], "x")]
    notices = spark.createDataFrame([(1, "S", POSTED), (1, "S", POSTED), (None, None, None)], "notice_id bigint, site_id string, posted_at timestamp")
    sites = spark.createDataFrame([("S", "Asia/Seoul")], "site_id string, time_zone string")
    ext = spark.createDataFrame(rows, kind)
    assert [tuple(r) for r in same_minute(ext, notices, sites).collect()] == [(1, 0)]
    assert [(r["extraction_id"], r["ord"]) for r in call_moments(ext, notices, sites).orderBy("ord").collect()] == [(1, 0), (1, 1), (1, 2)]
    assert same_minute(ext.limit(0), notices.limit(0), sites.limit(0)).collect() == []
