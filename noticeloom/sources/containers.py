"""Stored attachments: sniffing, character sets, and text of DOCX, HWPX and HWP containers.

A row of the binaryFile source becomes a document or a skipped row with its reason; hostile sizes are refused.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_FILE, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 15 << 20, 512, 20 << 20, 40 << 20
#: First bytes of formats.
MAGIC = {"pdf": "^25504446", "image": "^89504E47|^FFD8FF", "hwp": "^D0CF11E0A1B11AE1", "zip": "^504B"}


def sniffed(content: Column, name: Column) -> Column:
    """Kind by first bytes, a ZIP by its name; text where nothing else fits."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(head.rlike(MAGIC["pdf"]), "pdf").when(head.rlike(MAGIC["image"]), "image").when(head.rlike(MAGIC["hwp"]), "hwp")
    zipped = F.when(name.rlike(r"(?i)\.docx$"), "docx").when(name.rlike(r"(?i)\.(zip|xlsx|pptx)$"), "archive").otherwise("hwpx")
    return kind.when(head.rlike(MAGIC["zip"]), zipped).otherwise("text")


def _lossy(raw: bytes, charset: str) -> str | None:
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        return None


def decoded(raw: bytes, declared: str | None = None) -> str:
    """Text of bytes: by a declared character set or that of a meta tag, if it isn't UTF-8; else UTF-8, or EUC-KR where UTF-8 loses more than two signs in a hundred and it loses less."""
    text = raw.decode("utf-8", "replace")
    meta = regex.search(r"<meta[^>]+charset=[\"']?([\w-]+)", text[:2000], flags=regex.I)
    for charset in (declared, meta and meta[1]):
        if charset and charset.lower() not in ("utf-8", "utf8") and (other := _lossy(raw, charset)):
            return other
    if text.count("�") > 0.02 * max(1, len(text)):
        other = raw.decode("cp949", "replace")
        if other.count("�") < text.count("�"):
            return other
    return text


def _name(header: str | None) -> str | None:
    """The file name of a Content-Disposition header: the encoded one first; a plain one in Latin-1 that is EUC-KR is put right."""
    if not header:
        return None
    if m := regex.search(r"filename\*=UTF-8''([^;]+)", header, flags=regex.I):
        try:
            return unquote(m[1].strip().strip('"'), errors="strict")
        except UnicodeDecodeError:
            pass
    m = regex.search(r'filename="?([^";]+)"?', header, flags=regex.I)
    plain = m[1].strip() if m else ""
    if regex.search("[\x80-\xff]", plain):
        try:
            return plain.encode("latin-1").decode("euc-kr")
        except UnicodeError:
            return plain
    return plain or None


def with_file_name(rows: DataFrame, header: str, out: str) -> DataFrame:
    """Adds the file name that a header gives; null where it gives none. Only rows with a header reach Python."""
    names = F.pandas_udf(_names, T.StringType())
    return rows.withColumn(out, names(F.when(F.contains(F.lower(header), F.lit("filename")), F.col(header))))


def _names(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for headers in batches:
        yield pd.Series([_name(h if isinstance(h, str) else None) for h in headers], dtype="object")


def parsed_reply(reply: dict) -> str:
    """Text of a document service's reply: whole text, else Markdown, else HTML without tags, else its elements' in turn."""

    def of(content: dict | None) -> str:
        c = content or {}
        for key in ("text", "markdown"):
            if (c.get(key) or "").strip():
                return c[key].strip()
        page = regex.sub(r"(?i)<br\s*/?>|</(?:p|tr|div|h\d)>", "\n", c.get("html") or "")
        return regex.sub(r"\n{3,}", "\n\n", regex.sub(r"[ \t]+", " ", regex.sub(r"<[^>]+>", " ", page))).strip()

    return of(reply.get("content")) or "\n".join(x for x in (of(e.get("content")) for e in reply.get("elements") or []) if x).strip()


def _entries(raw: bytes, wanted: str) -> dict[str, bytes]:
    """Entries of a ZIP whose names match, within the limits, declared and real."""
    out, total = {}, 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if len(z.infolist()) > MAX_ENTRIES:
            raise ValueError("too many entries")
        for info in z.infolist():
            if regex.search(wanted, info.filename):
                if info.file_size > MAX_ENTRY:
                    raise ValueError("entry too large")
                with z.open(info) as f:
                    data = f.read(MAX_ENTRY + 1)
                total += len(data)
                if len(data) > MAX_ENTRY or total > MAX_TOTAL:
                    raise ValueError("archive too large")
                out[info.filename] = data
    return out


def _xml_text(xml: str, paragraph: str, run: str, glue: str) -> str:
    import html

    parts = regex.split(rf"</{paragraph}>", xml)
    lines = (glue.join(html.unescape(regex.sub(r"<[^>]+>", "", t)) for t in regex.findall(rf"<{run}(?:\s[^>]*)?>(.*?)</{run}>", p, flags=regex.S)) for p in parts)
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def docx_text(raw: bytes) -> str:
    found = _entries(raw, r"^word/document\.xml$")
    if not found:
        raise ValueError("no document in the container")
    return _xml_text(next(iter(found.values())).decode("utf-8", "replace"), "w:p", "w:t", "")


def hwpx_text(raw: bytes) -> str:
    found = _entries(raw, r"^Contents/section\d+\.xml$")
    if not found:
        raise ValueError("no section in the container")
    order = sorted(found, key=lambda n: int(regex.search(r"\d+", n)[0]))
    return "\n".join(_xml_text(found[n].decode("utf-8", "replace"), "hp:p", "hp:t", " ") for n in order)


def hwp_section_text(data: bytes) -> str:
    """Text of one section: records of a tag, a level and a size; paragraph texts are UTF-16 with inline controls."""
    out, at = [], 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        at += 4
        tag, size = head & 0x3FF, head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                break
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if at + size > len(data):
            break
        if tag == 67:
            codes = struct.unpack_from(f"<{size // 2}H", data, at)
            units, i = [], 0
            while i < len(codes):
                c = codes[i]
                if c >= 32:
                    units.append(c)
                elif c in (10, 13):
                    units.append(10)
                elif c and c < 24:  # a control fills eight units
                    i += 7
                i += 1
            out.append(struct.pack(f"<{len(units)}H", *units).decode("utf-16-le", "replace"))
        at += size
    return "\n".join(out)


def cfb_streams(raw: bytes) -> dict[str, bytes]:
    """Streams of a compound file by path: sector chains of the allocation tables, small streams from the mini stream."""
    size = 1 << struct.unpack_from("<H", raw, 30)[0]
    small = 1 << struct.unpack_from("<H", raw, 32)[0]
    first_dir, cutoff, first_mini = struct.unpack_from("<I", raw, 48)[0], struct.unpack_from("<I", raw, 56)[0], struct.unpack_from("<I", raw, 60)[0]
    sector = lambda n: raw[(n + 1) * size : (n + 2) * size]
    tables = [n for n in struct.unpack_from("<109I", raw, 76) if n < 0xFFFFFFFA]
    at, left = struct.unpack_from("<II", raw, 68)
    while at < 0xFFFFFFFA and left:
        more = struct.unpack(f"<{size // 4}I", sector(at))
        tables += [n for n in more[:-1] if n < 0xFFFFFFFA]
        at, left = more[-1], left - 1
    fat = [n for t in tables for n in struct.unpack(f"<{size // 4}I", sector(t).ljust(size, b"\xff"))]

    def chain(start: int, links: list[int], get) -> bytes:
        out, seen = [], set()
        while start < 0xFFFFFFFA and start not in seen and start < len(links):
            seen.add(start)
            out.append(get(start))
            start = links[start]
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    mini_raw = chain(first_mini, fat, sector)
    minifat = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw))
    entries = []
    for i in range(0, len(directory) - 127, 128):
        e = directory[i : i + 128]
        n = struct.unpack_from("<H", e, 64)[0]
        entries.append((e[: max(0, n - 2)].decode("utf-16-le", "replace"), e[66], *struct.unpack_from("<III", e, 68), struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0]))
    mini = chain(entries[0][5], fat, sector) if entries else b""
    out: dict[str, bytes] = {}
    todo, seen = [(entries[0][4], "")] if entries else [], set()
    while todo:
        i, path = todo.pop()
        if i >= len(entries) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = entries[i]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            data = chain(start, fat, sector) if length >= cutoff else chain(start, minifat, lambda k: mini[k * small : (k + 1) * small])
            out[path + name] = data[:length]
    return out


def hwp_text(raw: bytes) -> str:
    """Sections in order; an encrypted or protected file is an error, and one with a section over the limit."""
    streams = cfb_streams(raw)
    head = streams.get("FileHeader", b"")
    if not head.startswith(b"HWP Document File"):
        raise ValueError("no such container")
    flags = struct.unpack_from("<I", head, 36)[0]
    if flags & 0b10010:
        raise ValueError("encrypted or protected")
    names = sorted((n for n in streams if regex.fullmatch(r"BodyText/Section\d+", n)), key=lambda n: int(regex.search(r"\d+$", n)[0]))

    def inflate(data: bytes) -> bytes:
        out = zlib.decompressobj(-15).decompress(data, MAX_ENTRY + 1)
        if len(out) > MAX_ENTRY:
            raise ValueError("section too large")
        return out

    return "\n".join(hwp_section_text(inflate(streams[n]) if flags & 1 else streams[n]) for n in names)


def zip_text(raw: bytes) -> str:
    """Of a container whose name doesn't tell, the sections of the one format, else the document of the other."""
    try:
        return hwpx_text(raw)
    except ValueError as first:
        try:
            return docx_text(raw)
        except ValueError:
            raise first from None


READERS = {"docx": docx_text, "hwpx": zip_text, "hwp": hwp_text, "text": decoded}


def read_files(files: DataFrame, extra: dict | None = None) -> DataFrame:
    """path, kind, text and skipped of stored files (path, length, content of binaryFile).

    extra: readers of further kinds, such as pdf or image, as functions of bytes; without one such a file is skipped.
    Files over the size limit, and those whose reader fails, are skipped with the reason.
    """
    readers = READERS | (extra or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, content in zip(pdf.path, pdf.kind, pdf.content, strict=True):
                try:
                    reader = readers[kind]
                    rows.append((path, kind, reader(bytes(content)), None))
                except KeyError:
                    rows.append((path, kind, None, f"no reader for {kind}"))
                except Exception as e:  # noqa: BLE001 hostile files fail in many ways
                    rows.append((path, kind, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "skipped"])

    fits = F.col("length") <= MAX_FILE
    small = files.where(fits).select("path", sniffed(F.col("content"), F.col("path")).alias("kind"), "content")
    large = files.where(~fits).select("path", F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("too large").alias("skipped"))
    return small.mapInPandas(read, "path string, kind string, text string, skipped string").unionByName(large)


def url_list(lines: DataFrame) -> DataFrame:
    """url of each line of a list (spark.read.text), without blanks and comments."""
    return lines.select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def sitemap_urls(pages: DataFrame, xml: str, path: str, but: str | None = None) -> DataFrame:
    """url of each <loc> under a path of sitemaps, without those that a pattern (of listings, say) matches."""
    found = pages.select(F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).where(F.contains("url", F.lit(path)))
    return found if but is None else found.where(~F.col("url").rlike(but))
