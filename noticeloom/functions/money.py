"""Sums of money in free text: amounts, units and currencies, as won.

parse_note reads one note with a small grammar; notes_to_won does it for an Arrow batch, each distinct note once.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex as re

#: Korean numerals and scales.
DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
SMALL = {"십": 10, "백": 100, "천": 1000}
SCALES = {"천": 1e3, "만": 1e4, "십만": 1e5, "백만": 1e6, "천만": 1e7, "억": 1e8, "십억": 1e9, "백억": 1e10, "조": 1e12, "million": 1e6, "billion": 1e9, "thousand": 1e3, "m": 1e6, "k": 1e3}
#: Names and signs of currencies.
CURRENCIES = {
    "원": "KRW", "원정": "KRW", "KRW": "KRW", "₩": "KRW", "won": "KRW", "달러": "USD", "미국달러": "USD", "미달러": "USD", "불": "USD", "USD": "USD", "US$": "USD", "$": "USD",
    "유로": "EUR", "EUR": "EUR", "€": "EUR", "엔": "JPY", "JPY": "JPY", "¥": "JPY", "싱가포르달러": "SGD", "싱가포르 달러": "SGD", "싱달러": "SGD", "SGD": "SGD", "S$": "SGD",
    "파운드": "GBP", "GBP": "GBP", "£": "GBP",
}

_SCALE = r"(?:십억|백억|십만|백만|천만|천|만|억|조)"
_WORD = "|".join(sorted((re.escape(c) for c in CURRENCIES), key=len, reverse=True))
_NUM = r"\d[\d,]*(?:\.\d+)?"
#: A sum: numerals in letters, or numbers with scales, with a currency before or after.
SUM = re.compile(
    rf"(?P<letters>(?:일금|금)\s*(?P<hangul>[영공일이삼사오육칠팔구십백천만억조]+)\s*원정?)"
    rf"|(?P<before>{_WORD})?\s*(?P<parts>{_NUM}\s*{_SCALE}?(?:\s*{_NUM}\s*{_SCALE})*)\s*(?P<english>million|billion|thousand)?\s*(?P<after>{_WORD})?",
    re.IGNORECASE,
)
_PART = re.compile(rf"({_NUM})\s*({_SCALE})?")
#: A note that names only the unit of the number.
UNIT = re.compile(rf"^\W*(?:금액)?\s*단위\s*(?:는|:|：)?\s*(?P<scale>{_SCALE})?\s*(?P<currency>{_WORD})\s*(?:임|이다|입니다)?\W*$", re.IGNORECASE)
#: Words that tell that a sum isn't the most one recipient can get.
TOTAL = re.compile(r"(?:전체|총|총액|총규모)\s*(?:사업비|예산|규모|금액|지원금|액)?\s*(?:은|는|:)?\s*$")
FLOOR = re.compile(r"(?:최소|최저|하한)\s*(?:은|는|:)?\s*$")
GOLD = re.compile(r"(?:일금|금)\s*$")
RANGE_AFTER = re.compile(r"^\s*(?:~|∼|～|부터|에서|이상|내지|[-–]\s*\d)")
TOTAL_AFTER = re.compile(r"^\s*(?:규모(?!의)|의\s*예산|예산)")


def hangul_number(s: str) -> int:
    """Numeral in Korean letters: 사천오백만 is 45,000,000."""
    total = section = digit = 0
    for c in s:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in SMALL:
            section += (digit or 1) * SMALL[c]
            digit = 0
        else:
            total += ((section + digit) or 1) * int(SCALES[c])
            section = digit = 0
    return total + section + digit


def parse_note(note: str | None) -> tuple[str | None, str | None, float | None, float | None]:
    """(basis, currency, amount, factor): basis amount, unit or None.

    The amount is the largest sum that one recipient can get in the currency's own units; totals of the programme,
    lower bounds and starts of ranges are left out. For a unit, factor is what a number counts.
    """
    if not note or not note.strip():
        return None, None, None, None
    text = unicodedata.normalize("NFKC", note)
    if m := UNIT.match(text):
        return "unit", CURRENCIES.get(m["currency"].upper(), CURRENCIES.get(m["currency"])), None, SCALES.get(m["scale"] or "", 1.0)
    best: tuple[float, str] | None = None
    for m in SUM.finditer(text):
        if m["letters"]:
            value, currency = float(hangul_number(m["hangul"])), "KRW"
        else:
            word = m["before"] or m["after"]
            if not word:
                continue
            currency = CURRENCIES.get(word) or CURRENCIES.get(word.upper()) or CURRENCIES.get(word.lower())
            value = sum(float(n.replace(",", "")) * SCALES.get(s or "", 1.0) for n, s in _PART.findall(m["parts"]))
            value *= SCALES[m["english"].lower()] if m["english"] else 1.0
        head, tail = GOLD.sub("", text[: m.start()]), text[m.end() :]
        if TOTAL.search(head) or FLOOR.search(head) or RANGE_AFTER.match(tail) or TOTAL_AFTER.match(tail):
            continue
        if best is None or value > best[0]:
            best = value, currency
    return ("amount", best[1], best[0], None) if best else (None, None, None, None)


def notes_to_won(notes: pd.Series) -> pd.DataFrame:
    """parse_note for a batch."""
    codes, distinct = pd.factorize(notes, use_na_sentinel=False)
    parsed = [parse_note(x if isinstance(x, str) else None) for x in distinct]
    out = [parsed[c] for c in codes]
    return pd.DataFrame(out, columns=["basis", "currency", "amount", "factor"]).astype({"amount": "float64", "factor": "float64"})
