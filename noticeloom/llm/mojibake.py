"""Text decoded with the wrong character set: finding it and putting the original back.

Garbled sequences are computed beforehand for every character and pair of (true, assumed) encodings, a multi-pattern
automaton finds them, and only the spans that it matches are replaced. A sequence of a pair whose signs also occur in
correct text (one Chinese sign, two Latin-1 signs) counts only beside more of its kind that read as common Korean;
so foreign names and symbols stay. Repair is repeated, as some texts were garbled twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Signs of notices besides Hangul and Latin letters.
SIGNS = "·※○●◎□■◇◆△▲▽▼▶▷◀◁☆★→←↑↓↔☎☏〒♠♥♣㎡㎢㎥㎜㎝㎞㎏ℓ℃‰ⓒ®©™①②③④⑤⑥⑦⑧⑨⑩½¼¾×÷±°§¶‘’“”–—…•‥′″「」『』〈〉《》【】〔〕、。〜～∼∙・￦₩€£¥ªº«»¿¡ộ"
#: The most common syllables of Korean official prose.
COMMON = "이다는의에을를가지고하기로은서한사업원신청자인대해정도시제나일어아보수공스여리있라부조상전주안요비용내구관그과만들전성연장중소경유무개발간분야동세계국민체선발표문교육생활상담회센터재단진흥청년창출접결통운영평심협약마감직무료등록번호출력매월당최총억천백십외확금임"
#: Marks of a text that is worth a look: Latin letters with marks, Chinese signs, control codes, the replacement sign.
SUSPECT = "[\u0080-\u009f¡¢À-ÿ一-鿿\uf900-\ufaff�쨌]|[¡-¿]{2}|[клмн][Ђ-џ\u00a0-\u00bb‚-•–-›€™]|[｡-ﾟ]{2}"
#: Repairs of texts that were garbled so many times; one that isn't sound then is marked.
DEPTH = 3

UTF8_LATIN, EUC_LATIN, EUC_GBK, UTF8_EUC, LOST = "utf-8 as cp1252", "cp949 as cp1252", "cp949 as gbk", "utf-8 as cp949", "lost"
UTF8_CYRILLIC, EUC_KANA, DEEPER = "utf-8 as cp1251", "cp949 as shift_jis", "deeper"


def _latin(raw: bytes, windows: bool) -> str:
    """Bytes read as Latin-1, or as cp1252 whose five free codes stand for themselves."""
    if not windows:
        return raw.decode("latin-1")
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)


def garbled_sequences() -> dict[str, dict[str, str]]:
    """Garbled sequence: original sign by pair of encodings."""
    out: dict[str, dict[str, str]] = {}
    hangul = [chr(c) for c in range(0xAC00, 0xD7A4)]
    hanja = [bytes([a, b]).decode("euc_kr") for a in range(0xCA, 0xFE) for b in range(0xA1, 0xFF)]
    kana = [chr(c) for c in range(0x3041, 0x3100)]
    # Latin letters with marks, and the signs of cp1252 and control codes that texts garbled twice are made of
    latin = [chr(c) for c in [*range(0x80, 0x180), *range(0x1E00, 0x1F00)]] + [bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)]
    for c in dict.fromkeys([*hangul, *SIGNS, *latin, *kana, *hanja]):
        for windows in (True, False):
            if c:
                out.setdefault(_latin(c.encode(), windows), {}).setdefault(UTF8_LATIN, c)
    for c in hangul:
        seen = c.encode().decode("cp1251", "ignore")
        if len(seen) == 3:
            out.setdefault(seen, {}).setdefault(UTF8_CYRILLIC, c)
    for c in dict.fromkeys([*hangul, *SIGNS, *kana, *hanja]):
        try:
            raw = c.encode("euc_kr")
        except UnicodeEncodeError:
            continue
        if len(raw) != 2:
            continue
        out.setdefault(_latin(raw, True), {}).setdefault(EUC_LATIN, c)
        if "가" <= c <= "힣" and max(raw) < 0xE0:  # two half-width kana, where no byte begins a pair
            out.setdefault(raw.decode("shift_jis"), {}).setdefault(EUC_KANA, c)
        seen = raw.decode("gbk", "replace")
        if len(seen) == 1 and "一" <= seen <= "鿿" and not "一" <= c <= "鿿":
            out.setdefault(seen, {}).setdefault(EUC_GBK, c)
    return out


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for seq, by_pair in garbled_sequences().items():
        a.add_word(seq, (len(seq), by_pair))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _cp949() -> dict[str, bytes]:
    """Two bytes of each sign that cp949 reads UTF-8 as, and of the common form of those that have a compatibility form."""
    out: dict[str, bytes] = {}
    for lead in range(0x81, 0xFF):
        for trail in range(0x41, 0xFF):
            try:
                c = bytes([lead, trail]).decode("cp949")
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out[c] = bytes([lead, trail])
    for c, raw in list(out.items()):  # no Hangul in UTF-8 gives the common form's own bytes
        if "\uf900" <= c <= "\ufaff" and 0xEA <= raw[0] <= 0xED and not 0xEA <= out.get(own := unicodedata.normalize("NFC", c), b"\0")[0] <= 0xED:
            out[own] = raw
    return out


@lru_cache(maxsize=1)
def _utf8_start():
    """Pattern of the signs that a Hangul syllable in UTF-8 begins with when read as cp949."""
    return re.compile("[" + "".join(sorted(c for c, raw in _cp949().items() if 0xEA <= raw[0] <= 0xED and 0x80 <= raw[1] < 0xC0)) + "]")


def _back(line: str, at: int) -> tuple[int, str]:
    """The end of the signs from there that are whole Hangul and signs in UTF-8 read as cp949, and what they were."""
    table = _cp949()
    raw, text, end, back = b"", [], at, 0
    for i in range(at, len(line)):
        raw += table.get(line[i], b"\0")
        while raw and len(raw) >= (n := 3 if raw[0] >= 0xE0 else 2):
            c = raw[:n].decode("utf-8", "replace")
            if not ("가" <= c <= "힣" or len(c) == 1 and c in SIGNS):
                return end, "".join(text[:back])
            text.append(c)
            raw = raw[n:]
        if not raw:
            end, back = i + 1, len(text)
        elif raw[0] < 0xC2:
            break
    return end, "".join(text[:back])


def _utf8_as_euc(line: str) -> str:
    """The line with the spans put back that are UTF-8 read as cp949: two signs at least, a third of them common.

    As bytes straddle, such spans are pairs of syllables, too many for the automaton; so they are decoded in place.
    """
    parts, at, m = [], 0, _utf8_start().search(line)
    while m:
        end, text = _back(line, m.start())
        if len(text) >= 2 and 3 * sum(c in _COMMON for c in text) >= len(text):
            parts += [line[at : m.start()], text]
            at = end
        m = _utf8_start().search(line, max(at, m.start() + 1))
    return "".join(parts) + line[at:]


_COMMON = frozenset(COMMON)
_HAN = regex.compile(r"\p{Han}")
#: The middle dot of a line of UTF-8 read as cp949 that stands alone.
_DOT = regex.compile(r"(?<=\p{Hangul})쨌(?=\p{Hangul})")


def _matches(line: str) -> dict[str, list[tuple[int, int, str]]]:
    """By pair of encodings, the leftmost longest matches without overlaps: start, end, original."""
    at: dict[str, dict[int, tuple[int, str]]] = {}
    for last, (n, by_pair) in automaton().iter(line):
        for pair, c in by_pair.items():
            own = at.setdefault(pair, {})
            if own.get(last - n + 1, (0,))[0] <= last:
                own[last - n + 1] = (last + 1, c)
    out: dict[str, list[tuple[int, int, str]]] = {}
    for pair, own in at.items():
        free, hits = 0, []
        for start in sorted(own):
            if start >= free:
                free, c = own[start]
                hits.append((start, free, c))
        out[pair] = hits
    return out


def _sure(line: str, trusted: frozenset[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """The matches of one pair that can't be correct text. trusted: pairs that other lines of the text show."""
    by_pair = _matches(line)
    utf = by_pair.get(UTF8_LATIN, [])
    covered = sum(e - s for s, e, _ in utf)
    if any(e - s > 2 for s, e, _ in utf) and covered >= sum(e - s for s, e, _ in by_pair.get(EUC_LATIN, [])):
        return UTF8_LATIN, utf
    if by_pair.get(UTF8_CYRILLIC):  # no Cyrillic word has such three letters
        return UTF8_CYRILLIC, by_pair[UTF8_CYRILLIC]
    for pair in (EUC_LATIN, EUC_GBK, EUC_KANA):
        hits = by_pair.get(pair, [])
        if not hits:
            continue
        near = any(a[1] == b[0] for a, b in zip(hits, hits[1:], strict=False))
        common = sum(c in _COMMON for _, _, c in hits)
        # Chinese words have signs that aren't of this pair
        strange = len(_HAN.findall(line)) - len(hits) if pair == EUC_GBK else 0
        if strange <= len(hits) // 3 and (pair in trusted or near and 3 * common >= len(hits)):
            return pair, hits
        if pair == EUC_LATIN and (signs := [h for h in hits if line[h[0]] in "¡¢" and h[2] in SIGNS]):
            return pair, signs
    return UTF8_LATIN, utf


def repair_line(line: str, trusted: frozenset[str] = frozenset()) -> tuple[str, set[str]]:
    """The line with the original put back, and the pairs of encodings that it was garbled by; LOST where signs are gone, DEEPER where it was garbled more than DEPTH times."""
    pairs: set[str] = set()
    for _ in range(DEPTH):
        pair, hits = _sure(line, trusted)
        if not hits:
            break
        pairs.add(pair)
        parts, at = [], 0
        for start, end, c in hits:
            parts += [line[at:start], c]
            at = end
        line = "".join(parts) + line[at:]
    else:
        if _sure(line, trusted)[1]:
            pairs.add(DEEPER)
    if "�" in line:
        pairs.add(LOST)
    elif len(_utf8_start().findall(line)) >= 2:
        try:
            line, pairs = line.encode("cp949").decode("utf-8"), pairs | {UTF8_EUC}
        except UnicodeError:
            pass
    if (back := _utf8_as_euc(line)) != line:
        line, pairs = back, pairs | {UTF8_EUC}
    if "쨌" in line and _DOT.search(line):
        line, pairs = _DOT.sub("·", line), pairs | {UTF8_EUC}
    return line, pairs


_SUSPECT = regex.compile(SUSPECT)


def repair_text(text: str | None) -> tuple[str | None, list[str], int, int]:
    """(repaired text, pairs of encodings, garbled lines, lines that stay garbled); correct and null texts stay as they are."""
    if not text or not _SUSPECT.search(text):
        return text, [], 0, 0
    lines, pairs, bad, lost = text.split("\n"), set(), 0, 0
    seen = {i: (line, *repair_line(line)) for i, line in enumerate(lines) if _SUSPECT.search(line)}
    shown = frozenset(x for _, _, p in seen.values() for x in p if x in (EUC_LATIN, EUC_GBK, EUC_KANA))
    for i, (line, fixed, p) in seen.items():
        lines[i], p = repair_line(line, shown) if shown else (fixed, p)
        pairs |= p
        bad += bool(p)
        lost += LOST in p
    return "\n".join(lines), sorted(pairs), bad, lost


SCHEMA = "fixed string, pairs array<string>, garbled_lines int, lost_lines int"


def _repair(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = [repair_text(t if isinstance(t, str) else None) for t in texts]
        yield pd.DataFrame(rows, columns=["fixed", "pairs", "garbled_lines", "lost_lines"]).astype({"garbled_lines": "int32", "lost_lines": "int32"})


def with_repair(df: DataFrame, text: str = "text", out: str = "repair") -> DataFrame:
    """Adds a struct (fixed, pairs, garbled_lines, lost_lines) to each row.

    Only texts with a suspect sign reach Python. garbled_lines 0 and an empty list mean that the text is correct; fixed
    is the text itself then. Lines with replacement signs have lost bytes; only their sound spans are put back, and they count in lost_lines.
    """
    typed = F.pandas_udf(_repair, SCHEMA)
    plain = F.struct(F.col(text).alias("fixed"), F.array().cast("array<string>").alias("pairs"), F.lit(0).alias("garbled_lines"), F.lit(0).alias("lost_lines"))
    suspect = F.col(text).rlike(SUSPECT)
    asked = df.withColumn("_asked", typed(F.when(suspect, F.col(text))))
    return asked.withColumn(out, F.when(suspect, F.col("_asked")).otherwise(plain)).drop("_asked")


def repaired_records(source_documents: DataFrame, preset_documents: DataFrame, garbled: bool = False) -> DataFrame:
    """Both tables' texts repaired: tbl, row_id, text, fixed, pairs, garbled_lines, lost_lines, each key once.

    Where a key has rows with different texts, the smallest text counts. garbled: only the records with garbled text, so
    that no other text is shuffled. Null texts are left out.
    """
    src = source_documents.select(F.lit("source_documents").alias("tbl"), F.col("src_doc_id").alias("row_id"), "text")
    pre = preset_documents.select(F.lit("preset_documents").alias("tbl"), F.col("preset_id").alias("row_id"), "text")
    rows = with_repair(src.unionByName(pre).where("text IS NOT NULL")).select("tbl", "row_id", "text", "repair.*")
    if garbled:
        rows = rows.where("garbled_lines > 0")
    own = ["text", "fixed", "pairs", "garbled_lines", "lost_lines"]
    return rows.groupBy("tbl", "row_id").agg(F.min(F.struct(*own)).alias("r")).select("tbl", "row_id", *[f"r.{c}" for c in own])


def garbled_records(source_documents: DataFrame, preset_documents: DataFrame) -> DataFrame:
    """tbl and row_id of the records with garbled text."""
    src = source_documents.select(F.lit("source_documents").alias("tbl"), F.col("src_doc_id").alias("row_id"), "text")
    pre = preset_documents.select(F.lit("preset_documents").alias("tbl"), F.col("preset_id").alias("row_id"), "text")
    rows = src.unionByName(pre).where(F.col("text").rlike(SUSPECT))
    return with_repair(rows).where("repair.garbled_lines > 0").select("tbl", "row_id").distinct()
