"""Personal information in free text: e-mail addresses, phone, identity numbers, street addresses and names.

An automaton finds anchors in one pass: at-signs, dialling prefixes, identifier and name cues, endings of street
names. A parser of the anchor's type then expands around it and checks the whole: calendar dates in identity numbers,
number plans of phones, complete addresses, surnames. Placeholders replace what was found, the rest stays as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Regions, surnames and titles.
REGIONS = "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 경기도 강원특별자치도 강원도 충청북도 충청남도 전라북도 전북특별자치도 전라남도 경상북도 경상남도 제주특별자치도 제주도 서울시 부산시 대구시 인천시 광주시 대전시 울산시 세종시 서울 부산 대구 인천 광주 대전 울산 세종 경기 강원 충북 충남 전북 전남 경북 경남 제주".split()
SURNAMES = "김이박최정강조윤장임한오서신권황안송류유홍전고문양손배백허남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용예봉경사부가"
LONG_SURNAMES = "남궁 제갈 선우 독고 황보 사공 서문 동방".split()
TITLES = "부장 과장 차장 대리 책임 선임 팀장 실장 국장 센터장 본부장 원장 이사 대표 사장 매니저 사무관 서기관 연구원 주무관 주임 사원 담당관 간사 교수 박사 위원 위원장 변호사 회계사 컨설턴트 멘토 강사 님 씨".split()
#: Words that a person's name stands after.
ID_CUES = ("주민등록번호", "주민번호", "외국인등록번호", "등록번호")
CUES = "담당자 대표자 신청자 수혜자 작성자 책임자 성명 이름 대표 심사위원 문의처 연락처 강사 멘토".split()

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {c: 0x20 for c in (0xA0, 0x2007, 0x2009, 0x202F, 0x3000, 0x2002, 0x2003, 0x2005, 0x2006, 0x2008, 0x200A, 0x205F)} | {c: 0x2D for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)}
_INVISIBLE = re.compile("[​-‏⁠-⁤﻿­‪-‮]")

EMAIL = regex.compile(r"[A-Za-z0-9][\w.%+-]*\s?(?:@|\[at\]|\(at\))\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", regex.ASCII)
PHONE = regex.compile(
    r"\+\d{1,3}[-. ]?(?:\(0\)[-. ]?)?\d{1,2}[-. ]?\d{3,4}[-. ]?\d{4}(?![\d*])(?!-\d)"
    r"|\(0\d{1,2}\)[-. ]?\d{3,4}[-. ]?\d{4}(?![\d*])(?!-\d)"
    r"|0\d{1,2}\)[-. ]?\d{3,4}[-. ]?\d{4}(?![\d*])(?!-\d)"
    r"|01[016789]([-. ]?)\d{3,4}\1\d{4}(?![\d*])(?!-\d)"
    r"|0(?:2|[3-6]\d|70|80|50\d?)([-. ])\d{3,4}\2\d{4}(?![\d*])(?!-\d)"
    r"|0(?:2\d{7,8}|[3-6]\d\d{7,8}|70\d{8})(?![\d*])(?!-\d)"
    r"|1[5-9]\d\d-\d{4}(?![\d*])(?!-\d)",
    regex.ASCII,
)
RESIDENT = regex.compile(r"(\d\d)(\d\d)(\d\d)(?:\s?-\s?)?([1-8])\d{6}(?![\d*])(?!-\d)", regex.ASCII)
PASSPORT = regex.compile(r"[MSRODGP]\d{8}(?![\dA-Za-z])|M\d{3}[A-Z]\d{4}(?![\dA-Za-z])", regex.ASCII)
LICENCE = regex.compile(r"(?:1[1-9]|2[0-8])-\d{2}-\d{6}-\d{2}(?![\d-])", regex.ASCII)
_REGION = "|".join(REGIONS)
ADDRESS = regex.compile(rf"(?:(?:{_REGION})\s)?(?:[가-힣]{{1,6}}(?:시|군|구)\s){{0,2}}(?:[가-힣]{{1,6}}(?:읍|면)\s)?(?:[가-힣0-9]+(?:대로|로|길)\s?\d+(?:-\d+)?(?![\d%]|개|건|명|년|월)|[가-힣0-9]+(?:동|리|가)\s(?:산\s?)?\d+(?:-\d+)?번지)(?:,\s[가-힣]+\s?\d+층(?:\s?\d+호)?)?")
WESTERN = regex.compile(r"\d+(?:-\d+)?,?\s[A-Z][a-z]+(?:-[a-z]+)*-(?:daero|ro|gil|dong)(?:\s\d+[a-z-]*)?,\s[A-Z][a-z]+-(?:si|gun|gu|do)")
_NAME = rf"(?:(?:{'|'.join(LONG_SURNAMES)})[가-힣]{{1,2}}|[{SURNAMES}][가-힣]{{2}})"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
#: A name after a cue, with what may stand between; before a title; in a table beside contact data.
AFTER_CUE = regex.compile(rf"(?:{'|'.join(CUES)})(?:인)?(?:\s*[:：]\s*|\s+)(?:\S+(?:팀|실|부|과|센터|본부)\s+)?(?P<name>{_NAME})(?=\s*(?:[/(),|]|{_TITLE}|$|\n)|\s+(?:{_TITLE})|\s*\()")
#: A further name after one that a cue gave, behind a comma.
FURTHER = regex.compile(rf"\s*(?:(?:{_TITLE})\s*)?[,、·]\s*(?P<name>{_NAME})(?=\s*(?:[/(),、·|]|{_TITLE}|$|\n))")
#: The head of a list of persons, its entries, and an entry that is a name, with what may stand around it.
LIST = regex.compile(r"명단[^\S\n]*(?:\([^()\n]*\)[^\S\n]*)?[:：]")
ENTRY = regex.compile(r"(?:\([^()\n]*\)|[^,、·;/()])+")
LISTED = regex.compile(rf"\s*(?:\d+[.)]\s*)?(?P<name>{_NAME})(?:\s*(?:{_TITLE}))?(?:\s*\([^()]*\))?(?:\s*(?:외|등)(?:\s*\d+\s*[명인])?)?[\s.]*")
AFTER_TITLE = regex.compile(rf"(?:{_TITLE})\s(?P<name>{_NAME})(?=에게|께|님|이|가|은|는|,|\s|\()")
TABLE = regex.compile(rf"\s*\d+\s\|\s[^|\n]+\s\|\s(?P<name>{_NAME})\s\|\s")
#: A name in Latin letters after a cue.
LATIN_AFTER_CUE = regex.compile(rf"(?:{'|'.join(CUES)})(?:인)?\s*[:：]?\s*(?P<name>\p{{Lu}}\p{{Ll}}[\p{{L}}'-]*(?:\s\p{{Lu}}[\p{{L}}'.-]*){{1,2}})(?=\s*(?:[,(/|]|$|\n))")
WESTERN_NAME = regex.compile(r"Contact(?: person)?:\s(?P<name>\p{Lu}[\p{L}'-]+(?:\s\p{Lu}[\p{L}'.-]*){1,2})(?=,|\s\(|$|\n)")


@lru_cache(maxsize=1)
def anchors():
    """The automaton of anchors, each with the type of its parser."""
    import ahocorasick

    a = ahocorasick.Automaton()
    cues: dict[str, list[str]] = {
        "email": ["@", "[at]", "(at)"],
        "phone": ["+", "(0", "010", "011", "016", "017", "018", "019", "02", "070", "080", "050", *(f"0{i}" for i in range(31, 70)), *(f"1{i}" for i in range(5, 10))],
        "name": [*CUES, "명단", "Contact", *(f" {t}" for t in TITLES), " | "],
        "address": ["로 ", "길 ", "번지", *(f"로{i}" for i in range(10)), *(f"길{i}" for i in range(10))],
        "western": [f"-{x}{after}" for x in ("ro", "daero", "gil", "dong") for after in (",", " ")],
        # a calendar day or a blank, a hyphen and a century; letters of passports; regions of licences; cues before numbers without hyphen
        "id_number": [*(f"{d}{h}{c}" for d in "0123456789" for h in ("-", " -", "- ", " - ") for c in "12345678"), *(f"{x}{d}" for x in "MSRODGP" for d in "0123456789"), *(f"{n}-" for n in range(11, 29)), *ID_CUES],
    }
    for kind, words in cues.items():
        for w in words:
            a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


_FREE = "0123456789-."


def _resident(m) -> bool:
    year, month, day = int(m[1]), int(m[2]), int(m[3])
    return 1 <= month <= 12 and 1 <= day <= (31 if month in (1, 3, 5, 7, 8, 10, 12) else 30 if month != 2 else 29 if year % 4 == 0 else 28)


#: Words before a number that tell what it is, if it is nobody's.
_OTHER = regex.compile(r"(?:관리번호|계좌(?:번호)?|사업자(?:등록)?번호|등록번호|공고번호|접수번호|문서번호|과제번호|법인(?:등록)?번호|고유번호|제)\s*[:：]?\s*(?:[가-힣]{2,6}\s)?$")
_RESIDENT_CUE = regex.compile(r"(?:주민|외국인)\s*등록번호\s*[:：]?\s*$")


def _other(text: str, at: int) -> bool:
    head = text[max(0, at - 16) : at]
    return bool(_OTHER.search(head)) and not _RESIDENT_CUE.search(head)


_WIDE_SIGN = re.compile("[" + "".join(map(re.escape, map(chr, _WIDE))) + "]")
_AREA = regex.compile(rf"{_REGION}|[가-힣]{{1,6}}(?:시|군|구|읍|면)")
_LOT = regex.compile(r"(?:산\s?)?[0-9]+(?:-[0-9]+)?$")
_NAME_BACK = regex.compile(rf"(?<![가-힣])(?P<name>{_NAME})$")
_TITLE_AT = regex.compile(rf"\s(?:{_TITLE})(?:(?![가-힣])|(?=[은는이가을를의에도과와께]|에게|입니다))")


def _line(text: str, at: int) -> tuple[int, int]:
    end = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, len(text) if end < 0 else end


def _listed(text: str, at: int) -> Iterator:
    """The names of a list of persons; it goes on in the next line after a comma at the end of one."""
    head = LIST.match(text, at)
    if not head:
        return
    end = _line(text, at)[1]
    while end < len(text) and text[head.end() : end].rstrip()[-1:] in (",", "、"):
        end = _line(text, end + 1)[1]
    for entry in ENTRY.finditer(text, head.end(), end):
        yield LISTED.fullmatch(text, *entry.span())


def _cued(text: str, at: int) -> Iterator:
    """The name after a cue, and those that follow it behind commas."""
    m = AFTER_CUE.match(text, at)
    while m:
        yield m
        m = FURTHER.match(text, m.end("name"))


def _names(text: str, anchored: list[int]) -> Iterator[tuple[int, int, str]]:
    tables = set()
    for at in anchored:
        if text[at] == "C":
            found = [WESTERN_NAME.match(text, at)]
        elif text.startswith("명단", at):
            found = [*_listed(text, at)]
        elif text[at] != " ":
            found = [*_cued(text, at), LATIN_AFTER_CUE.match(text, at)]
        elif text[at + 1] == "|":
            start, end = _line(text, at)
            if start in tables:
                continue
            tables.add(start)
            found = [TABLE.match(text, start, end)]
        else:
            found = [AFTER_TITLE.match(text, at + 1)]
            if at and "가" <= text[at - 1] <= "힣" and _TITLE_AT.match(text, at):
                found.append(_NAME_BACK.search(text, max(0, at - 5), at))
        for m in found:
            if m and not _NOT_NAMES.fullmatch(m["name"]):
                yield (*m.span("name"), "name")


def _word_start(text: str, at: int) -> int:
    while at and (text[at - 1].isdigit() or "가" <= text[at - 1] <= "힣"):
        at -= 1
    return at


def _address(text: str, at: int) -> tuple[int, int, str] | None:
    """From the end of a street's or lot's name to the left over town, city and region, then checked as a whole to the right."""
    if text.startswith("번지", at):
        lot = _LOT.search(text, max(0, at - 24), at)
        if not lot or not lot.start() or text[lot.start() - 1] != " ":
            return None
        start = _word_start(text, lot.start() - 1)
    else:
        start = _word_start(text, at)
    street = start
    while start and text[start - 1] == " ":
        left = _word_start(text, start - 1)
        if not _AREA.fullmatch(text, left, start - 1):
            break
        start = left
    while start <= street:
        m = ADDRESS.match(text, start)
        if m and m.end() > at and _complete(m[0]):
            return start, m.end(), "address"
        start = text.find(" ", start, street) + 1 or street + 1
    return None


def _western(text: str, at: int) -> tuple[int, int, str] | None:
    """From the street's ending to the left over its name and number."""
    start = at
    while start and (text[start - 1].isascii() and text[start - 1].isalpha() or text[start - 1] == "-"):
        start -= 1
    m = _NUMBER_BACK.search(text, max(0, start - 12), start)
    found = m and WESTERN.match(text, m.start())
    return (m.start(), found.end(), "address") if found else None


_NUMBER_BACK = regex.compile(r"(?<![0-9-])[0-9]+(?:-[0-9]+)?,?\s$")


def _digits_back(text: str, at: int, signs: str = "0123456789- ") -> int:
    """The first sign of the run of digits, hyphens and blanks that ends before at, without what isn't a digit."""
    start = at
    while start and at - start < 8 and text[start - 1] in signs:
        start -= 1
    while start < at and not text[start].isdigit():
        start += 1
    return start


def _id_number(text: str, at: int) -> tuple[int, int, str] | None:
    """An identity number around its anchor: hyphen and century, letter of a passport, region of a licence, or cue."""
    if text[at].isdigit():
        hyphen = text.index("-", at)
        for start in (_digits_back(text, hyphen, "0123456789 "), at):
            head = text[start - 1] if start else " "
            if head.isascii() and (head.isalnum() or head == "-"):
                continue
            if (r := RESIDENT.match(text, start)) and _resident(r) or (r := LICENCE.match(text, start)):
                return None if _other(text, start) else (start, r.end(), "id_number")
        return None
    if text[at].isascii():
        head = text[at - 1] if at else " "
        m = None if head.isascii() and (head.isalnum() or head == "-") else PASSPORT.match(text, at)
        return (at, m.end(), "id_number") if m and not _other(text, at) else None
    m = _AFTER_ID.match(text, at)
    r = m and RESIDENT.match(text, m.end())
    return (m.end(), r.end(), "id_number") if r and _resident(r) and not _other(text, m.end()) else None


#: Thirteen digits in a row, which have no sign that an anchor could be.
_BARE = re.compile(r"(?<![\dA-Za-z-])\d{13}(?![\d*-])", re.ASCII)
_AFTER_ID = regex.compile(rf"(?:{'|'.join(ID_CUES)})\s*[:：]?\s*")


def _email(text: str, at: int) -> tuple[int, int, str] | None:
    start = at - (at > 0 and text[at - 1] == " ")
    while start > 0 and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
        start -= 1
    m = EMAIL.match(text, start)
    return (start, m.end(), "email") if m and m.end() > at else None


def _phone(text: str, at: int) -> tuple[int, int, str] | None:
    if at and (text[at - 1] in _FREE or text[at - 1].isascii() and text[at - 1].isalpha() or text[at - 1] in "+(" and text[at] not in "+("):
        return None
    if at > 1 and text[at - 1] == " " and text[at - 2] == ")" and text[at] not in "+(":  # inside +82 (0)2
        return None
    m = PHONE.match(text, at)
    return (at, m.end(), "phone") if m and not _other(text, at) else None


def mentions(original: str) -> list[tuple[int, int, str]]:
    """(position, length, type) of each mention, in order and without overlaps; positions count code points."""
    text = _WIDE_SIGN.sub(lambda m: chr(_WIDE[ord(m[0])]), original)
    # place of the k-th invisible sign without the k before it
    gone = [m.start() - k for k, m in enumerate(_INVISIBLE.finditer(text))]
    if gone:
        text = _INVISIBLE.sub("", text)
    kinds: dict[str, list[int]] = {}
    for end, (n, kind) in anchors().iter(text):
        kinds.setdefault(kind, []).append(end - n + 1)
    spans = [s for at in kinds.get("email", ()) if (s := _email(text, at))]
    parsers = (("id_number", _id_number), ("address", _address), ("western", _western))
    spans += [s for kind, parse in parsers for at in kinds.get(kind, ()) if (s := parse(text, at))]
    for m in _BARE.finditer(text):
        if (r := RESIDENT.match(text, m.start())) and _resident(r) and not _other(text, m.start()):
            spans.append((*r.span(), "id_number"))
    phones = [s for at in kinds.get("phone", ()) if (s := _phone(text, at))]
    spans += [p for p in phones if not any(s < p[1] and p[0] < e for s, e, _ in spans)]
    spans += _names(text, kinds.get("name", []))
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind))
    if not gone:
        return [(s, e - s, k) for s, e, k in out]
    at = lambda p: p + bisect_right(gone, p)
    return [(at(s), at(e - 1) + 1 - at(s), k) for s, e, k in out]


#: Words of three syllables that begin like a surname.
_NOT_NAMES = regex.compile(r"(?:지원금|주민등|이력서|나이는|전원이|기업의|대표자|담당자|연락처|주무관|사무관|연구원|매니저|전문가|책임자|심사위|위원장|부재시|확인후|신청자|공동대|이하여|전담인|지정양|경우에|성장팀|사업팀|지원팀|협력팀|정책팀|기업성|창업지|청년정|사업운|기술사|글로벌|이메일|전화번|주소지|문의처|고객센|사무국|사무실|안내문|신청서|지원서|주민센)")


def _complete(address: str) -> bool:
    """An address needs a region or city before its street."""
    return bool(regex.match(rf"(?:{_REGION})\s|[가-힣]{{1,6}}(?:시|군|구)\s", address))


_FOUND = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("pii_type", T.StringType())]))


def _find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[{"pos": p, "length": n, "pii_type": k} for p, n, k in mentions(t)] if isinstance(t, str) and t else [] for t in texts], dtype="object")


#: What a text with a mention has: a digit, an at-sign or a cue; the first check, in the JVM.
ANCHORED = "[0-9０-９@＠]|\\[at\\]|\\(at\\)|Contact|명단|" + "|".join(dict.fromkeys([*CUES, *TITLES]))


def with_mentions(df: DataFrame, text: str = "text", out: str = "mentions") -> DataFrame:
    """Adds an array of (pos, length, pii_type); null and empty texts have none."""
    return df.withColumn(out, F.pandas_udf(_find, _FOUND)(text))


def masked(text: str, found: str = "mentions"):
    """Expression: the text with a placeholder in place of each mention."""
    table = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc, m):
        return F.struct(F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, m["pos"] - acc["at"]), F.element_at(table, m["pii_type"])).alias("done"), (m["pos"] + m["length"]).alias("at"))

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))


_MENTION = pa.schema([("place", pa.string()), ("row_id", pa.int64()), ("pos", pa.int32()), ("pii_type", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each mention; an entry of an array (at is its index) gives each type once."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            out: list[list] = [[], [], [], []]
            for place, row, at, text in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns), strict=True):
                found = mentions(text)
                spots = [(p, k) for p, _, k in found] if at is None else [(at, k) for k in dict.fromkeys(k for _, _, k in found)]
                for pos, kind in spots:
                    for column, x in zip(out, (place, row, pos, kind), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _MENTION, strict=True)], schema=_MENTION)


def pii_mentions(source_documents: DataFrame, contacts: DataFrame) -> DataFrame:
    """place, row_id, pos and pii_type of every mention, each once.

    In contacts an entry counts as what it is by content, whichever array it is in, and as each of several types that it
    holds; entries that hold no whole mention, null entries and null arrays give nothing. Texts of both tables pass
    Python together and once, and only those with a sign that some anchor has.
    """
    asked = source_documents.select(F.lit("source_documents").alias("place"), F.col("src_doc_id").alias("row_id"), F.lit(None).cast("int").alias("at"), "text")
    for column in ("phones", "emails"):
        entries = contacts.select(F.lit(f"contacts.{column}").alias("place"), F.col("contact_id").alias("row_id"), F.posexplode(column).alias("at", "text"))
        asked = asked.unionByName(entries.distinct())
    return asked.where(F.col("text").rlike(ANCHORED)).mapInArrow(_rows, "place string, row_id bigint, pos int, pii_type string").distinct()


def masked_documents(source_documents: DataFrame) -> DataFrame:
    """src_doc_id, masked and n_mentions for each document with a text; of differing rows of one key the smallest text."""
    docs = with_mentions(source_documents.where("text IS NOT NULL").groupBy("src_doc_id").agg(F.min("text").alias("text")))
    return docs.select("src_doc_id", masked("text").alias("masked"), F.size("mentions").alias("n_mentions"))
