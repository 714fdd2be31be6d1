import random

import pytest

from noticeloom.functions.money import hangul_number, parse_note
from noticeloom.operators.amount_units import amounts_in_won, wrong_amounts


@pytest.mark.parametrize(
    ("note", "got"),
    [
        ("과제당 금 사천오백만원 한도", ("amount", "KRW", 45e6, None)), ("최소 0.5억 원에서 최대 2억 5천만원", ("amount", "KRW", 250e6, None)), ("트랙에 따라 1,000만 원 ~ 50백만원", ("amount", "KRW", 50e6, None)),
        ("기업당 5백만 원, 전체 사업비 일금 50,000,000원정", ("amount", "KRW", 5e6, None)), ("총 예산 일금 300,000,000원정 / 기업당 최대 금 삼천만원", ("amount", "KRW", 30e6, None)),
        ("24개사 선정, 총 1억원 규모 중 개사당 최대 0.1억원", ("amount", "KRW", 10e6, None)), ("총 사업비의 70% 이내, 최대 45,000천원", ("amount", "KRW", 45e6, None)),
        ("팀당 4천 달러 이내", ("amount", "USD", 4000.0, None)), ("20천 유로 한도 (현지 집행)", ("amount", "EUR", 20000.0, None)), ("50 million KRW", ("amount", "KRW", 50e6, None)), ("US$20,000 한도", ("amount", "USD", 20000.0, None)),
        ("(단위: 백만원)", ("unit", "KRW", None, 1e6)), ("금액 단위는 원임", ("unit", "KRW", None, 1.0)), ("현물 지원", (None,) * 4), ("", (None,) * 4), (None, (None,) * 4), ("x" * 50_000, (None,) * 4),
    ],
)
def test_notes(note, got):
    assert parse_note(note) == got


def test_hangul():
    assert [hangul_number(x) for x in ("천만", "이억오천만", "십오억", "구백만", "삼")] == [10**7, 25 * 10**7, 15 * 10**8, 9 * 10**6, 3]


KIND = "extraction_id bigint, overview struct<amount_max_krw:bigint,amount_note:string>, amount string"


def test_wrong(spark):
    rows = [(1, (50, "단위 백만원"), "x"), (2, (50, "단위 원"), "x"), (3, (10**7, "최대 1,000만 원"), "x"), (4, (10, "최대 1,000만 원"), "x"), (4, (10, "최대 1,000만 원"), "x"), (5, (None, "최대 1만원"), "x"), (6, (7, None), "x"), (7, (1000, "최대 USD 1,000"), "x"), (8, None, "x")]
    rates = spark.createDataFrame([("USD", 1385.0), ("USD", 1385.0)], "currency string, krw_per_unit double")
    out = amounts_in_won(spark.createDataFrame(rows, KIND), rates)
    assert sorted(r[0] for r in wrong_amounts(out).collect()) == [1, 4, 7]
    assert amounts_in_won(spark.createDataFrame([], KIND), rates).collect() == []


def test_mixture_finds_units(spark):
    stated = [(i, (10**7, f"최대 {n}만 원"), "x") for i, n in enumerate([500, 1000, 2000, 3000, 5000, 7000, 10000] * 20)]
    bare = [(1000 + i, (n, None), "x") for i, n in enumerate([5, 10, 20, 30, 50, 70, 100] * 10)]  # in millions
    out = amounts_in_won(spark.createDataFrame(stated + bare, KIND), spark.createDataFrame([], "currency string, krw_per_unit double"))
    units = [r["unit"] for r in out.where("extraction_id >= 1000").collect()]
    assert units.count("백만원") > 0.9 * len(units)


def test_mixture_is_calibrated(spark):
    """Half of the notes are hidden; of the numbers that the mixture is sure of, 95 in 100 must come out right."""
    rng = random.Random(4)
    factors = [1, 1, 1, 1, 1, 1, 10**3, 10**4, 10**6]
    rows, truth = [], {}
    for i in range(3000):
        won = rng.choice([5, 10, 15, 20, 30, 40, 50, 60, 70, 100, 120, 150, 200, 300, 500]) * 10**6
        number = won // rng.choice(factors)
        rows.append((i, (number, None if i % 2 else f"최대 {won:,}원"), "x"))
        truth[i] = won
    rates = spark.createDataFrame([("USD", 1385.0), ("JPY", 9.25)], "currency string, krw_per_unit double")
    out = amounts_in_won(spark.createDataFrame(rows, KIND), rates).collect()
    sure = [r for r in out if r["basis"] == "none" and not r["unsure"]]
    right = sum(r["amount_krw"] == truth[r["extraction_id"]] for r in sure)
    assert len(sure) > 600 and right >= 0.95 * len(sure)
    assert {r["extraction_id"] for r in wrong_amounts(spark.createDataFrame(out)).collect()} == {r["extraction_id"] for r in out if r["basis"] == "amount" and r["amount_max_krw"] != truth[r["extraction_id"]]}
