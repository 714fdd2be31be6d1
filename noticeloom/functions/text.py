"""Scalar text functions as Spark expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Patterns of contacts, titles and dangerous schemes.
PHONE = r"(?<![0-9-])(?:0[0-9]{1,2}[-.)\s]?[0-9]{3,4}[-.\s]?[0-9]{4}|1[5-9][0-9]{2}[-.\s]?[0-9]{4})(?![0-9-])"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
TITLES = "주무관|사무관|서기관|연구원|연구사|주임연구원|매니저|팀장|과장|부장|차장|대리|담당자|담당|선임|책임|주임"
SCHEMES = r"(?i)\b(javascript|vbscript|data)\s*:"

#: Signs that NFKC may change, or that join with the sign before them.
_UNSTABLE = r"[^\n -~가-힣]"


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([unicodedata.normalize("NFKC", t) if isinstance(t, str) else None for t in texts], dtype="object")


def with_nfkc(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the NFKC form; texts of ASCII and Hangul only don't reach Python."""
    odd = F.col(text).rlike(_UNSTABLE)
    asked = df.withColumn(out, F.pandas_udf(_nfkc, T.StringType())(F.when(odd, F.col(text))))
    return asked.withColumn(out, F.when(odd, F.col(out)).otherwise(F.col(text)))


def match_form(text: Column) -> Column:
    """The form that quotes are compared in; text is in NFKC already. Null stays null."""
    t = F.regexp_replace(text, "[​-‍﻿]", "")
    t = F.regexp_replace(t, "[\"'「」『』]", '"')
    t = F.regexp_replace(F.regexp_replace(t, "[·ㆍ•]", "·"), r"\|", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ | $", ""))


def tight_form(form: Column) -> Column:
    """match_form without blanks and dashes."""
    return F.regexp_replace(form, r"(?U)[\s\-–—]", "")


def compact_form(text: Column) -> Column:
    """Lower case without blanks; text is in NFKC already."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def contacts(text: Column) -> Column:
    """Struct of distinct phones and emails in order of appearance, trimmed."""
    found = lambda p: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.trim(x)), lambda x: x != ""))
    return F.struct(found(PHONE).alias("phones"), found(EMAIL).alias("emails"))


def has_contact(found: Column) -> Column:
    """Whether a struct of contacts() holds any."""
    return F.coalesce(F.size(found["phones"]) > 0, F.lit(False)) | F.coalesce(F.size(found["emails"]) > 0, F.lit(False))


def mask_contacts(text: Column) -> Column:
    """E-mails, phones, names after a role and names before a title, in this order."""
    t = F.regexp_replace(F.regexp_replace(text, EMAIL, "[이메일]"), PHONE, "[연락처]")
    t = F.regexp_replace(t, r"((?:담당자|담당|문의자|작성자)\s*[:：]?\s*)([가-힣]{2,4})(?![가-힣])", "$1[담당자]")
    return F.regexp_replace(t, rf"[가-힣]{{2,4}}(\s*(?:{TITLES}))(?![가-힣])", "[담당자]$1")


def publishable(text: Column) -> Column:
    """Text that can't be read as markup: no control codes, brackets full-width, schemes broken."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(F.translate(t, "<>[]", "＜＞［］"), SCHEMES, "$1：")


def publishable_record(df: DataFrame, keep: tuple[str, ...] = ("url", "source_url")) -> DataFrame:
    """publishable for every string of every column, however nested, but for fields named in keep."""

    def build(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StringType):
            return c if name in keep else publishable(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: build(x, kind.elementType, name))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: build(v, kind.valueType, name))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[build(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[build(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def json_part(reply: Column) -> Column:
    """The outermost braces of a reply, null where there are none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def one_line(text: Column, n: int) -> Column:
    """Blanks collapsed, at most n signs, the last an ellipsis where cut."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def money(won: Column) -> Column:
    """A sum in units of a hundred million from there on, with one decimal where it isn't whole, else of ten thousand, rounded."""
    big = F.when(won % 100_000_000 == 0, F.format_string("%d억원", F.floor(won / 100_000_000))).otherwise(F.format_string("%.1f억원", won / 100_000_000))
    return F.when(won >= 100_000_000, big).otherwise(F.concat(F.format_number(F.floor(won / 10_000 + 0.5), 0), F.lit("만원")))


def overview_line(o: Column) -> Column:
    """Organizer, sum or note, scale and deadline on one line, missing ones left out. Zero and empty values count as missing."""
    some = lambda c, make: F.when(c.isNotNull() & (c != ""), make)
    amount = F.when(o["amount_max_krw"] != 0, F.concat(F.lit("지원금 최대 "), F.format_number(F.floor(o["amount_max_krw"] / 10_000 + 0.5), 0), F.lit("만원"))).otherwise(some(o["amount_note"], o["amount_note"]))
    parts = [some(o["organizer"], F.concat(F.lit("주관 "), o["organizer"])), amount, some(o["support_scale"], F.concat(F.lit("규모 "), o["support_scale"])), some(o["apply_end"], F.concat(F.lit("마감 "), o["apply_end"]))]
    return F.concat_ws(" · ", *parts)


#: What each stage's failure is called.
STAGES = {"collect": "원문 수집 실패", "classify": "공고 판정 실패", "extract": "추출 실패", "verify": "검증 게이트 미통과 (발행 보류)"}


def failure_line(stage: Column, reason: Column, no_programme: Column) -> Column:
    """What became of a notice that gave no brief; an unknown stage stands for itself."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), stage), stage)
    return F.when(F.coalesce(no_programme, F.lit(False)), F.concat(F.lit("지원사업 공고가 아닌 것으로 판정: "), F.coalesce(reason, F.lit("")))).otherwise(F.concat(name, F.lit(": "), F.coalesce(reason, F.lit(""))))


def days_left(iso: Column, now: Column) -> Column:
    """Days, rounded up, from a moment (timestamp) to the end of an ISO date in Korea: D-n, closed, or always open for no date."""
    end = F.to_utc_timestamp(F.concat(iso, F.lit(" 23:59:59")).try_cast("timestamp_ntz").cast("timestamp"), "Asia/Seoul")
    diff = F.ceil((F.unix_micros(end) - F.unix_micros(now)) / 86_400_000_000)
    return F.when(iso.isNull() | (iso == ""), "상시/미확인").when(diff < 0, "마감").otherwise(F.concat(F.lit("D-"), diff.cast("string")))


def reason_key(text: Column, n: int = 90) -> Column:
    """Reasons that differ in numbers only are one."""
    return F.substring(F.trim(F.regexp_replace(text, "[0-9]+", "N")), 1, n)


def tidy(text: Column) -> Column:
    """Blanks of office and PDF texts: runs of blanks as one, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^(?U)\s+|\s+\z", "")
