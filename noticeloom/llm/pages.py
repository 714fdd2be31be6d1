"""The main body of web pages, by consensus paths of each host.

Stored pages have no tags left, so containers are what a page's layout still shows: what stands before the notice's
title, the parts between its headings, and the part behind the last one, in which the body ends and the page goes on.
The path of a line is its class, the generalised form of what it says: numbers, addresses, institutions and regions
masked, and, wider, the first two words of that.

One pass in Python cuts each page into paths, as hashes. The pages of a host then vote in Spark: how many of them have
a path behind the last heading, and over how many containers a path is spread. A host's votes are weighed with those of
all hosts that use the path, so hosts of few pages lean on the others. Winning paths are

* closing paths, which most pages of the host have behind the last heading: there the body ends,
* strewn paths, which come in any container between headings (banners, heads of lists): such lines go wherever they stand,
* heading paths of other notices, which begin like titles: such lines go too,
* opening paths, which most pages have before the title, for pages whose title isn't found.

Each page is then cut again by the winning paths of its host. Lines that lost signs to a wrong character set are matched
by the same loss on the lines that voted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.llm.canonical import canonical
from noticeloom.llm.mojibake import _utf8_as_euc, repair_text
from noticeloom.session import materialise

#: The line of the notice number, which follows the title; the second form is one that lost its letters.
NUMBER = regex.compile(r"공고\s*제?\s*20\d\d\s*-\s*\d+\s*호|^[^\d-]*�[^\d-]*20\d\d-\d{3,5}[^\d-]{0,4}$")
#: A heading, which begins a container.
HEADING = regex.compile(r"\s*(?:[0-9０-９]{1,2}|[Ⅰ-Ⅹ]|[IVX]{1,4})[.)．]\s")
#: Share of a host's pages that a closing or opening path needs, pages that the votes of all hosts count as, and pages
#: without the path that these are joined by, so that a path seen once or twice wins nowhere.
SHARE, PRIOR, WITHOUT = 0.6, 100, 10
#: Concentration (the chance that two lines of a path are in one container) under which it is strewn, and lines that
#: count as being in its commonest container beforehand.
STREWN, BEFOREHAND = 0.36, 4
#: A beginning belongs to titles if so many times its titles are as many as its lines in other places.
TITLED = 5
#: Parts that each host's pages are split into where they meet its winning paths, as one host may hold most pages.
SALTS = 16

#: Endings of institutions' names and first syllables of regions.
_ORG = regex.compile(r"\p{Hangul}+(?:진흥원|재단|센터|산업원|지원단|혁신원|협력단|진흥회|협회|공단|연구원)")
_REGION = regex.compile(r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충청[남북]?|전라[남북]?|경상[남북]?|제주|충[남북]|전[남북]|경[남북])(?:특별자치도|특별자치시|특별시|광역시|도|시)?")
_MAIL = regex.compile(r"[\w.+-]+\s?(?:@|\[at\]|\(at\))\s?[\w-]+(?:\.[\w-]+)+")
_PHONE = regex.compile(r"\(?\+?#\)?(?:[-. )]*\(?#\)?)+")
_NUM = regex.compile(r"\d[\d,]*")
_DIGITS = regex.compile("[0-9]+")
_BULLET = regex.compile(r"^[^\p{L}\p{N}#§¤@�]+")


def line_class(line: str) -> tuple[str, str]:
    """The paths of a line, the closer and the wider."""
    s = _MAIL.sub("@", canonical(line.strip()))
    s = _PHONE.sub("#", _NUM.sub("#", s))
    s = " ".join(_REGION.sub("§", _ORG.sub("¤", s)).split())
    return s, " ".join(_BULLET.sub("", s).split(" ")[:2])


def _lossy(line: str) -> list[str]:
    """What is left of the line after the two lossy mistakes, cp949 read as UTF-8 and UTF-8 read as cp949; of the latter, repair puts spans back."""
    return [line.encode("cp949", "ignore").decode("utf-8", "replace"), _utf8_as_euc(line.encode().decode("cp949", "replace"))]


def _lost_paths(masked: str) -> tuple[int, int]:
    """Hashes of the paths of a masked line that lost signs: itself and its first two words."""
    return _hash(masked), _hash(" ".join(_BULLET.sub("", masked).split()[:2]))


def _hash(text: str) -> int:
    n = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


@lru_cache(maxsize=200_000)
def _paths(masked: str) -> tuple[int, ...]:
    """Hashes of a line's two paths and of what they would be after each loss, 0 where the line would lose nothing."""
    if "�" in masked:
        return *_lost_paths(masked), 0, 0, 0, 0
    out = [_hash(x) for x in line_class(masked)]
    for left in _lossy(masked):
        out += _lost_paths(_DIGITS.sub("0", left.strip())) if "�" in left else (0, 0)
    return tuple(out)


_NAMES = ("no", "exact", "two", "loss1", "two1", "loss2", "two2", "part", "bits")
_TYPES = (pa.int32(), *[pa.int64()] * 7, pa.int8())
_ARROW = pa.schema([("src_doc_id", pa.int64()), ("host", pa.string()), ("text", pa.string()), *[(n, pa.list_(t)) for n, t in zip(_NAMES, _TYPES, strict=True)]])
_SCHEMA = "src_doc_id bigint, host string, text string, no array<int>, " + ", ".join(f"{n} array<bigint>" for n in _NAMES[1:-1]) + ", bits array<tinyint>"
#: Where a line stands, as bits, whether it is the first of its paths there on its page, and whether it lost signs.
BEFORE, TITLE, ENCLOSED, CLOSING, FIRST, FIRST_TWO, LOST = 1, 2, 4, 8, 16, 32, 64


def _squeezed(text: str) -> str:
    return "".join(canonical(text).split())


def cut_page(text: str, title: str | None) -> tuple[list[int], ...]:
    """For each non-blank line its number, paths, what they are after each loss, container and bits; text is repaired.

    The title is the line before the notice number, else the line that the stored title equals. Lines of the number
    line itself have no bits.
    """
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    number = next((i for i in full if NUMBER.search(lines[i])), -1)
    at = next((i for i in reversed(full) if i < number), -1)
    if number < 0 and title and title.strip():
        want = _squeezed(title)
        number = at = next((i for i in full if _squeezed(lines[i]) == want), -1)
    heads = {i for i in full if i > number and HEADING.match(lines[i])}
    last = max(heads, default=number)
    out: tuple[list[int], ...] = tuple([] for _ in _NAMES)
    seen: set[tuple[int, int]] = set()
    container = 0
    for i in full:
        exact, two, *losses = _paths(_DIGITS.sub("0", lines[i].strip()))
        if i == at:
            bits = TITLE
        elif i == number:
            bits = 0
        elif at >= 0 and i < at or at < 0 and i < last:
            bits = BEFORE if at >= 0 else ENCLOSED
        else:
            bits = CLOSING if i > last else ENCLOSED
        if bits in (BEFORE, CLOSING):
            bits |= FIRST * ((bits, exact) not in seen) | FIRST_TWO * ((bits, two) not in seen)
            seen |= {(bits & 15, exact), (bits & 15, two)}
        bits |= LOST * ("�" in lines[i])
        if i in heads:
            container = exact
        for column, x in zip(out, (i, exact, two, *losses, -1 if bits & BEFORE else container, bits), strict=True):
            column.append(x)
    return out


def page_paths(source_documents: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each html document with a text that isn't blank: its host and its lines' paths, see cut_page.

    with_text keeps the repaired text, which only bodies need. A page without host or URL votes with its like.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500).to_pylist()
                texts = [repair_text(r["text"])[0] for r in rows]
                cuts = [cut_page(t, r["title"]) for t, r in zip(texts, rows, strict=True)]
                lists = [pa.array([c[k] for c in cuts], f.type) for k, f in enumerate(list(_ARROW)[3:])]
                yield pa.RecordBatch.from_arrays([pa.array([r["src_doc_id"] for r in rows], pa.int64()), pa.array([r["host"] for r in rows], pa.string()), pa.array(texts if with_text else [None] * len(rows), pa.string()), *lists], schema=_ARROW)

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))
    pages = source_documents.where((F.col("kind") == "html") & F.col("text").rlike(r"(?U)\S"))
    return pages.select("src_doc_id", host.alias("host"), "title", "text").mapInArrow(cut, _SCHEMA)


def _has(bits: int) -> Column:
    return F.col("bits").bitwiseAND(F.lit(bits)) == bits


_KINDS = ("closing", "opening", "strewn", "closing_two", "titled", "lost_closing", "lost_out")


def winning_paths(paths: DataFrame) -> DataFrame:
    """One row a host: arrays of its closing, opening and strewn paths, of its titles' beginnings and of what these lost.

    Votes are counted by host, path and container first, so a host or line of any size is partly summed where it is
    read. What a host wins is bounded by the lines of its pages: a path of the share SHARE is on most of them.
    """
    lines = paths.select("host", F.posexplode_outer(F.arrays_zip(*_NAMES[1:])).alias("i", "x")).where("x IS NOT NULL").select("host", "x.*")
    counted = materialise(lines.groupBy("host", "exact", "two", "part").agg(
        F.count("*").alias("n"), F.count_if(_has(CLOSING | FIRST)).alias("closing"), F.count_if(_has(BEFORE | FIRST)).alias("opening"),
        F.count_if(_has(CLOSING | FIRST_TWO)).alias("closing_two"), F.count_if(_has(TITLE)).alias("titles"), F.count_if(_has(ENCLOSED)).alias("enclosed"),
        *[F.max(c).alias(c) for c in ("loss1", "two1", "loss2", "two2")],
    ), "page-votes")
    sizes = paths.groupBy("host").agg(F.count("*").alias("pages"))
    # containers are the same on all hosts, so the lines of all hosts count together; behind the last heading all paths are alike
    spread = counted.where((F.col("titles") == 0) & (F.col("enclosed") > 0)).groupBy("exact", "part").agg(F.sum("enclosed").alias("n")).groupBy("exact").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.max("n").alias("top"))
    strewn = spread.where((F.col("nn") + 2 * BEFOREHAND * F.col("top") + BEFOREHAND**2) / F.pow(F.col("n") + BEFOREHAND, F.lit(2)) < STREWN).select("exact")
    own = counted.groupBy("host", "exact").agg(F.sum("closing").alias("closing"), F.sum("opening").alias("opening"), F.max("loss1").alias("loss1"), F.max("loss2").alias("loss2"))
    headings = counted.where("part = exact").select("exact").distinct()
    own = own.join(headings, "exact", "left_anti")
    own_losses, wider_losses = ["loss1", "loss2"], ["two1", "two2"]
    wins = [
        ("closing", "lost_closing", _shared(own, sizes, "exact", "closing", own_losses)),
        ("opening", "lost_out", _shared(own, sizes, "exact", "opening", own_losses)),
        ("strewn", "lost_out", own.join(strewn, "exact").withColumnRenamed("exact", "path")),
    ]
    wider = counted.where("part <> exact").groupBy("host", "two", *wider_losses).agg(*[F.sum(c).alias(c) for c in ("closing_two", "titles", "enclosed")])
    titled = wider.groupBy("two").agg(F.sum("titles").alias("titles"), F.sum("enclosed").alias("enclosed")).where((F.col("titles") > 0) & (F.col("titles") * TITLED >= F.col("enclosed")))
    wins.append(("titled", "lost_out", wider.join(titled.select("two"), "two").withColumnRenamed("two", "path")))
    plain = wider.groupBy("host", "two").agg(F.sum("closing_two").alias("closing_two"), *[F.max(c).alias(c) for c in wider_losses]).join(titled.select("two"), "two", "left_anti")
    wins.append(("closing_two", "lost_closing", _shared(plain, sizes, "two", "closing_two", wider_losses)))
    won = None
    for kind, lost, w in wins:
        a, b = wider_losses if "two1" in w.columns else own_losses
        pair = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).alias("path"))
        rows = w.select("host", F.explode(F.array(pair(kind, "path"), pair(lost, a), pair(lost, b))).alias("x")).select("host", "x.*")
        won = rows if won is None else won.unionByName(rows)
    return won.where("path <> 0").groupBy("host").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in _KINDS])


def _shared(votes: DataFrame, sizes: DataFrame, path: str, count: str, more: list[str]) -> DataFrame:
    """host and path where the path's pages make up SHARE of the host's, with PRIOR pages of the share that it has on all hosts that use it.

    Where it has that share on all these hosts together, half of it will do on one.
    """
    v = votes.where(F.col(count) > 0).join(sizes, "host")
    pooled = v.groupBy(path).agg((F.sum(count) / (F.sum("pages") + WITHOUT)).alias("pooled"))
    share = (F.col(count) + PRIOR * F.col("pooled")) / (F.col("pages") + PRIOR)
    return v.join(pooled, path).where((share >= SHARE) | (F.col("pooled") >= SHARE) & (F.col(count) / F.col("pages") >= SHARE / 2)).select("host", F.col(path).alias("path"), *more)


def _settled(rows: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """The columns kept and made, through a generator of one row: the optimiser would else write what is made out again
    inside each lambda that reads it, once for each line."""
    return rows.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made")).select(*kept, "_made.*")


def extracted(paths: DataFrame, winners: DataFrame) -> DataFrame:
    """src_doc_id, text and out, the numbers of the lines that aren't part of the body.

    A host's pages meet its winning paths in SALTS parts. Of rows with one src_doc_id the one with the smallest out counts.
    """
    some = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = paths.withColumn("salt", F.pmod(F.xxhash64("src_doc_id"), F.lit(SALTS)).cast("int")).join(some, ["host", "salt"], "left")
    bit = lambda x, b: x["bits"].bitwiseAND(F.lit(b).cast("tinyint")) != 0
    rows = _settled(rows, "src_doc_id", "text", lines=F.arrays_zip("no", "exact", "two", "bits"), **{c: F.coalesce(c, F.array().cast("array<bigint>")) for c in _KINDS})
    either = lambda c, x: F.array_contains(c, x["exact"]) | F.array_contains(c, x["two"])
    closes = lambda x: bit(x, CLOSING) & F.when(bit(x, LOST), either("lost_closing", x)).otherwise(F.array_contains("closing", x["exact"]) | F.array_contains("closing_two", x["two"]))
    end = F.coalesce(F.get(F.filter("lines", closes), F.lit(0))["no"], F.lit(2_147_483_647))
    rows = _settled(rows, "src_doc_id", "text", "lines", "strewn", "titled", "opening", "lost_out", titles=F.exists("lines", lambda x: bit(x, TITLE)), end=end)
    strewn = lambda x: F.array_contains("strewn", x["exact"]) | F.array_contains("titled", x["two"]) | ~F.col("titles") & F.array_contains("opening", x["exact"])
    goes = lambda x: bit(x, BEFORE) | (x["no"] >= F.col("end")) | bit(x, ENCLOSED | CLOSING) & F.when(bit(x, LOST), either("lost_out", x)).otherwise(strewn(x))
    out = F.transform(F.filter("lines", goes), lambda x: x["no"])
    return rows.select("src_doc_id", "text", out.alias("out")).groupBy("src_doc_id").agg(F.min(F.struct("out", "text")).alias("r")).select("src_doc_id", "r.text", "r.out")


def split_pages(source_documents: DataFrame, with_text: bool = False) -> DataFrame:
    """src_doc_id, text (null without with_text) and out of every html document, see extracted.

    Null, empty and blank texts are left out; empty tables give an empty result; columns other than src_doc_id, url,
    kind, title and text aren't read. The paths are read twice, so they are written once.
    """
    paths = materialise(page_paths(source_documents, with_text), "page-paths")
    return extracted(paths, winning_paths(paths))


def surroundings(pages: DataFrame) -> DataFrame:
    """src_doc_id and line_no of lines that aren't part of the body."""
    return pages.select("src_doc_id", F.explode("out").alias("line_no"))


def bodies(pages: DataFrame) -> DataFrame:
    """src_doc_id and text: the body of each page, lines in order, blank ones left out; pages have their text."""
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: line.rlike(r"(?U)\S") & ~F.array_contains("out", i))
    return pages.where(F.size(kept) > 0).select("src_doc_id", F.array_join(kept, "\n").alias("text"))
