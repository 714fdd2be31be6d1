"""One form for text that looks the same.

A quick check by Unicode's own properties, behind a coarse character class, finds the segments that a canonical form could change; only those are normalised,
with the character before them as context, as a mark or a final consonant joins it, and put back into the unchanged
rest. Invisible signs are dropped, blanks become a space, widths and fonts are folded, look-alike letters become Latin
ones, and what is left is composed. Enclosed digits, fractions and units stay, as they look different; no letter
becomes a digit; line ends stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Letters of other scripts that look like a Latin one, after Unicode's confusables.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХҮԌԚԜѴ": "ABESIJKMHOPCTYXYGQWV", "авесіјорсухѕԁһԛԝѵӏ": "aвecijopcyxsdhqwvl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ": "ABEZHIKMNOPTYXCj", "αινορυγϲ": "aivopuyc", "ɑɡıⲞⲟ": "agiOo",
    "ՍՕօոսհցզ": "UOonuhgq", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎽ": "ABCDEGHJKLMPRSTVWZY", "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
}
#: Signs that look like a common one.
SIGNS = {
    "-": "‐‑‒–﹘⁃˗−➖﹣－", "·": "·•‧∙⋅・･ㆍᆞ᛫", "~": "∼～〜˜⁓", "'": "‘’‛′ʹʼˈ＇", '"': "“”‟″〝〞＂", ":": "：∶꞉︰ː", ",": "‚，", ".": "․．", "/": "⁄∕／", "*": "∗＊", "|": "∣｜ǀ", "<": "‹＜", ">": "›＞", "○": "◯⚪",
}
@lru_cache(maxsize=1)
def table() -> dict[int, str | None]:
    """What each sign becomes; a rule over Unicode's own properties, and the fixed values."""
    out: dict[int, str | None] = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code < 0xD7A4 or 0x20000 <= code < 0x2F800 or 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out[code] = None
        elif kind == "Zs":
            out[code] = " "
        elif (way := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>", "<font>")) or 0x2160 <= code < 0x2180 or 0xFB00 <= code < 0xFB07 or 0x2E80 <= code < 0x2FE0 or way and way[0] != "<" and " " not in way:
            out[code] = unicodedata.normalize("NFKC", c)
    out[0x09] = " "
    for a, b in LOOKALIKES.items():
        out |= {ord(x): y for x, y in zip(a, b, strict=True) if x != y and y.isascii()}
    for b, many in SIGNS.items():
        out |= {ord(x): b for x in many if x != b}
    return out


@lru_cache(maxsize=1)
def unstable() -> frozenset[str]:
    """The quick check, from Unicode's properties: signs that the table changes, whose composed form is another, or that
    may join with the sign before them (second parts of compositions, vowels and finals of Hangul)."""
    codes = {c for c in table() if c >= 0x80 or c == 9} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for code in range(0x80, sys.maxunicode + 1):
        way = unicodedata.decomposition(chr(code))
        if way and way[0] != "<":
            codes.update(int(x, 16) for x in way.split()[1:])
            if not unicodedata.is_normalized("NFC", chr(code)):
                codes.add(code)
    return frozenset(map(chr, codes))


#: Wider than unstable(), but one class that patterns are quick with, in the JVM too: all but line ends, ASCII, Hangul
#: syllables and common signs that are stable.
COARSE = r"[^\n -~가-힣·○●□■▲▼△※㎡ⓒ©「」『』①-⓿]"
_SEGMENT = regex.compile(r"[\s\S]?" + COARSE + "+")


def _folded(m) -> str:
    segment = m[0]
    if unstable().isdisjoint(segment):
        return segment
    t = table()
    # a fold may give a sign that another entry folds on, as width forms of look-alikes do
    return unicodedata.normalize("NFC", segment.translate(t).translate(t))


def canonical(text: str | None) -> str | None:
    """The canonical form; null stays null, and the form of a canonical text is the text."""
    if not text:
        return text
    return _SEGMENT.sub(_folded, text)


def _canonical_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([canonical(t) if isinstance(t, str) else None for t in texts], dtype="object")


_UDF = F.pandas_udf(_canonical_batches, T.StringType())


def canonical_column(df: DataFrame, text: str, out: str, if_changed: bool = False) -> DataFrame:
    """Adds the canonical form of a column; only texts that fail the quick check reach Python.

    if_changed: null where the form is the text itself.
    """
    odd = F.col(text).rlike(COARSE)
    asked = df.withColumn(out, _UDF(F.when(odd, F.col(text))))
    same: Column = F.lit(None).cast("string") if if_changed else F.col(text)
    return asked.withColumn(out, F.when(odd & ~F.col(out).eqNullSafe(F.col(text)), F.col(out)).otherwise(same))


def quotes_that_look_equal(evidence: DataFrame, source_documents: DataFrame) -> DataFrame:
    """evidence_id, literal and alike of each quote that has a text of the same notice and URL.

    literal: the quote occurs character for character in one such text; alike: its canonical form does in the text's.
    Null or empty quotes and texts and null URLs are in no result; repeated rows of an evidence_id count once, of
    differing ones the smallest. Texts are put into canonical form once each, before the join, and shipped a second
    time only where they change. The join's hot keys are split by the adaptive plan, as nothing is grouped by them.
    """
    quotes = evidence.where("quote <> '' AND source_url IS NOT NULL").groupBy("evidence_id").agg(F.min(F.struct("notice_id", "source_url", "quote")).alias("q"))
    quotes = canonical_column(quotes.select("evidence_id", F.col("q.notice_id").alias("notice_id"), F.col("q.source_url").alias("url"), F.col("q.quote").alias("quote")), "quote", "quote_form", True)
    docs = canonical_column(source_documents.where("text <> ''").select("notice_id", "url", "text"), "text", "text_form", True)
    pairs = quotes.join(docs, ["notice_id", "url"])
    literal = F.contains(F.col("text"), F.col("quote"))
    alike = F.contains(F.coalesce("text_form", "text"), F.coalesce("quote_form", "quote"))
    return pairs.select("evidence_id", literal.alias("literal"), (literal | alike).alias("alike")).groupBy("evidence_id").agg(F.max("literal").alias("literal"), F.max("alike").alias("alike"))


def lookalike_quotes(evidence: DataFrame, source_documents: DataFrame) -> DataFrame:
    return quotes_that_look_equal(evidence, source_documents).where("alike AND NOT literal").select("evidence_id")
