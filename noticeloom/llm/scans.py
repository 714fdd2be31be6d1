"""Noise of scanned pages: running headers, page numbers, words broken at line ends, misrecognised signs.

Headers are found by fuzzy repetition of a document's first line, page numbers by their forms, and words by the
vocabulary of the texts that weren't scanned: of two neighbouring lines the last and first word are joined where the
corpus knows the whole better than the pair, and a word is misread where the corpus doesn't know it but knows one
that looks alike. Looking alike is a fold: digits and the letters they are taken for, and Hangul by classes of vowels
and finals; as ㅡ is taken for ㅗ and for ㅜ but these not for each other, words of one fold are also held against each
other in these vowels. All of it is Spark expressions; vocabulary, pairs and verdicts are joined, so none must fit one machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from noticeloom.llm.mojibake import with_repair
from noticeloom.session import materialise

#: Vowels and finals of Hangul, by their place in Unicode, that recognition confuses.
VOWELS = ("ㅏㅑ", "ㅓㅕㅣ", "ㅗㅛㅡㅜㅠ", "ㅐㅔㅒㅖ", "ㅘㅙ", "ㅝㅟㅞ", "ㅢㅚ")
FINALS = ("ㅈㅊ", "ㄱㅋ", "ㅁㅇ")
VOWEL_ORDER = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINAL_ORDER = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
#: Vowels of one class that recognition doesn't confuse, each with its mark; ㅡ is between them.
APART = {"ㅗㅛ": "o", "ㅜㅠ": "u", "ㅡ": "-"}
#: Letters that digits are taken for, and letters taken for each other.
DIGIT_LIKE = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8", "Z": "2"}
LETTER_LIKE = {"K": "R"}
#: A page number alone on its line, with letters for digits.
PAGE_NO = r"^\s*(?:[Pp]age\s*{d}|[Pp]\.\s*{d}|[-–‐]\s*{d}\s*[-–‐]|제\s*{d}\s*쪽|{d}\s*/\s*{d}|[\[〔(<]\s*{d}\s*[\]〕)>]|{d}\s*쪽|{d})\s*$".replace("{d}", "[0-9OoIlSBZ]{1,3}")
#: The line of the notice number, in folded letters, see fold().
NUMBER_WORDS = "공고 제"
#: Share of a header's signs that may differ, and signs of a line end that aren't a broken word.
HEADER_NEAR = 0.34
#: The same for lines that only their places at pages' edges show, as ends of sentences stand there too.
RUNNING_NEAR = 0.2
HYPHEN = regex.compile(r"(?<=[^\s|])[-‐‑]\s*$")


def _hangul_fold() -> tuple[str, str]:
    """Every Hangul syllable that isn't the first of its class, and the first."""
    vowel = {VOWEL_ORDER.index(c): VOWEL_ORDER.index(k[0]) for k in VOWELS for c in k}
    final = {FINAL_ORDER.index(c): FINAL_ORDER.index(k[0]) for k in FINALS for c in k}
    a, b = [], []
    for code in range(11172):
        lead, rest = divmod(code, 588)
        v, t = divmod(rest, 28)
        to = lead * 588 + vowel.get(v, v) * 28 + final.get(t, t)
        if to != code:
            a.append(chr(0xAC00 + code))
            b.append(chr(0xAC00 + to))
    return "".join(a), "".join(b)


@lru_cache(maxsize=1)
def _tables() -> tuple[dict, dict]:
    return str.maketrans(DIGIT_LIKE | LETTER_LIKE), str.maketrans(*_hangul_fold())


_DIGITS = regex.compile("[0-9]+")


def mask(text: str) -> str:
    """The text with runs of digits as one."""
    return _DIGITS.sub("0", text)


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """The class of texts that look like it; of a masked text too."""
    digits, hangul = _tables()
    return mask(text.translate(digits)).translate(hangul)


@lru_cache(maxsize=1)
def _marks() -> dict[str, str]:
    by_vowel = {VOWEL_ORDER.index(v): mark for vowels, mark in APART.items() for v in vowels}
    return {chr(0xAC00 + code): by_vowel[v] for code in range(11172) if (v := code % 588 // 28) in by_vowel}


def marks(text: str) -> str:
    """The vowels in which texts of one fold may still differ, see APART; equally many for all of them."""
    by_sign = _marks()
    return "".join([by_sign[c] for c in text if c in by_sign])


def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for words in batches:
        rows = [(fold(w), marks(w)) if isinstance(w, str) else (None, None) for w in words]
        yield pd.DataFrame(rows, columns=["f", "u"], dtype="object")


#: Declared as not deterministic, as the optimiser would else move a join's check for nulls down to every single word.
folded = F.pandas_udf(_fold, T.StructType([T.StructField("f", T.StringType()), T.StructField("u", T.StringType())])).asNondeterministic()


def with_fold(df: DataFrame) -> DataFrame:
    """Adds the fold f and the marks u of the word m."""
    return df.withColumn("_fold", folded("m")).select("*", "_fold.f", "_fold.u").drop("_fold")


def alike(u: str, v: str) -> Column:
    """Whether words of one fold with these marks look alike: nowhere ㅗ against ㅜ."""
    return F.expr(f"{u} = {v} OR NOT exists(sequence(1, length({u})), i -> substring({u}, i, 1) <> substring({v}, i, 1) AND substring({u}, i, 1) <> '-' AND substring({v}, i, 1) <> '-')")


def masked(word: Column) -> Column:
    return F.regexp_replace(word, "[0-9]+", "0")


def is_scanned() -> Column:
    """All of kind image, and those of kind pdf that are laid out in page lines, which have no blank lines."""
    text = F.col("text")
    return F.coalesce((F.col("kind") == "image") | (F.col("kind") == "pdf") & text.contains("\n") & ~text.rlike(r"\n[ \t]*\n"), F.lit(False))


def scanned_documents(source_documents: DataFrame) -> DataFrame:
    """src_doc_id and text of scanned documents, wrong character sets repaired.

    Null and empty texts are left out; a repeated src_doc_id counts once, of differing rows the smallest text.
    """
    docs = source_documents.where((F.col("text") != "") & is_scanned()).groupBy("src_doc_id").agg(F.min("text").alias("text"))
    return with_repair(docs).select("src_doc_id", F.col("repair.fixed").alias("text"))


_PAGE_NO = regex.compile(PAGE_NO)
#: A page number at the end of a header line.
_PAGE_END = regex.compile(r"\s{2,}(?:[-–(\[〔]\s*)?[0-9OoIlSBZ]{1,3}(?:\s*/\s*[0-9OoIlSBZ]{1,3})?(?:\s*[-–)\]〕])?\s*$")
_NUMBER = fold(NUMBER_WORDS)
_NUMBER_OF_PAGE = regex.compile("[0-9OoIlSBZ]{1,3}(?![A-Za-z])")
_SAYS_PAGE = regex.compile(r"[Pp]age|[Pp]\.|쪽|^[-–‐]")
#: Page numbers that may be missing between two, and lines that a page has at least.
MISSED, PAGE_LINES = 3, 10


def _in_common(a: str, b: str) -> int:
    """Signs that both have, each as often as in both."""
    counts: dict[str, int] = {}
    for c in a:
        counts[c] = counts.get(c, 0) + 1
    n = 0
    for c in b:
        if k := counts.get(c):
            counts[c] = k - 1
            n += 1
    return n


def _near(a: str, b: str, limit: int) -> bool:
    """Whether at most limit signs must change."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > limit:
        return False
    if len(a) == len(b) and sum(map(str.__ne__, a, b)) <= limit:
        return True
    if max(len(a), len(b)) - _in_common(a, b) > limit:  # no order of the signs can be near enough
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > limit:
            return False
    return row[-1] <= limit


def _page_numbers(lines: list[str], full: list[int]) -> set[int]:
    """Lines that hold a page number alone: of its form, and numbers of one form go on from page to page, or the line is at
    the text's edge or before the line that the text begins with, or says that it is a page, or is the only such line of
    the text, a page's length from its start and between lines that are no cells."""
    shaped = [(i, _NUMBER_OF_PAGE.sub("#", lines[i].strip()), int(_NUMBER_OF_PAGE.search(lines[i])[0].translate(_tables()[0]))) for i in full if _PAGE_NO.match(lines[i])]
    if not shaped:
        return set()
    first = fold(lines[full[0]].strip())
    after = dict(zip(full, full[1:], strict=False))
    out = set()
    for k, (i, form, value) in enumerate(shaped):
        follows = any(f == form and 0 < abs(value - v) <= MISSED and (value > v) == (k > n) for n, (_, f, v) in enumerate(shaped) if n != k)
        edge = i in (full[0], full[-1]) or _near(fold(lines[after[i]].strip()), first, int(len(first) * HEADER_NEAR))
        alone = len(shaped) == 1 and full.index(i) >= PAGE_LINES and min(len(lines[j].strip()) for j in (full[full.index(i) - 1], after.get(i, i))) > 6
        if follows or edge or alone or _SAYS_PAGE.search(form):
            out.add(i)
    return out


def _running(lines: list[str], edges: list[int], body: list[int]) -> set[int]:
    """Lines at the same edge of several pages that are near each other, and lines elsewhere that are near these."""
    texts = {i: fold(lines[i].strip()) for i in body}
    near = lambda i, j: _near(texts[i], texts[j], int(min(len(texts[i]), len(texts[j])) * RUNNING_NEAR))
    model = next((i for i in edges if sum(near(i, j) for j in edges) * 2 > len(edges)), None)
    return set() if model is None or len(edges) < 3 else {i for i in body if near(model, i)}


def line_roles(lines: list[str]) -> list[str]:
    """header, page_no, blank or body for each line of a scanned document; "header page_no" where it is both.

    The running header is the first line, if it comes again after the notice number or the title below begins like it;
    or a line that more than half of the pages begin or end with, where page numbers show three pages or more.
    """
    full = [i for i, x in enumerate(lines) if x.strip()]
    numbers = _page_numbers(lines, full)
    roles = ["blank" if not x.strip() else "page_no" if i in numbers else "body" for i, x in enumerate(lines)]
    body = [i for i in full if roles[i] == "body"]
    ends = {i for i in body if _PAGE_END.search(lines[i])}
    lines = [_PAGE_END.sub("", x) if i in ends else x for i, x in enumerate(lines)]
    heads: set[int] = set()
    first = fold(lines[0].strip()) if lines else ""
    if first and roles[0] == "body":
        limit = int(len(first) * HEADER_NEAR)
        number = next((i for i in body if _NUMBER in fold(lines[i])), 0)
        again = [i for i in body if i > number and abs(len(lines[i].strip()) - len(lines[0].strip())) <= limit + 2 and _near(fold(lines[i].strip()), first, limit)]
        title = fold(" ".join(" ".join(lines[1:number]).split()))
        if again or number > 1 and limit and _near(title[: len(first)], first, limit):
            heads = {0, *again}
    if not heads and len(numbers) > 1:
        tops = [i for i, before in zip(full[1:], full, strict=False) if before in numbers and roles[i] == "body"]
        bottoms = [i for i, after in zip(full, full[1:], strict=False) if after in numbers and roles[i] == "body"]
        heads = _running(lines, tops, body) | _running(lines, bottoms, body)
    for i in heads:
        roles[i] = "header page_no" if i in ends else "header"
    return roles


def _pieces(doc: int, text: str, out: list[list]) -> None:
    """Appends the rows of one scanned document, by column: its edges, the inner words of its lines, the pairs at line ends."""
    ids, nos, roles, nexts, inner, m1, m2, joined, hyphens = out
    lines = text.split("\n")
    body = []
    for i, (line, role) in enumerate(zip(lines, line_roles(lines), strict=True)):
        if role == "body":
            body.append((i, line, mask(line).split()))
        elif role != "blank":
            for kind in role.split():
                for column, x in zip(out, (doc, i, kind, None, None, None, None, None, False), strict=True):
                    column.append(x)
    for k, (i, line, ws) in enumerate(body):
        last = k == len(body) - 1
        ids.append(doc)
        nos.append(i)
        roles.append("line")
        inner.append(ws[k > 0 : len(ws) - (not last)])
        hyphen = False
        if last:
            nexts.append(None)
            m1.append(None)
            m2.append(None)
            joined.append(None)
        else:
            w1, w2, hyphen = ws[-1], body[k + 1][2][0], line.rstrip()[-1] in "-‐‑" and bool(HYPHEN.search(line))
            w1 = w1[:-1] if hyphen else w1
            nexts.append(body[k + 1][0])
            m1.append(w1)
            m2.append(w2)
            joined.append(mask(w1 + w2))
        hyphens.append(hyphen)


_PIECES = "src_doc_id bigint, line_no int, role string, next_no int, ms array<string>, m string, m2 string, j string, hyphen boolean"
_ARROW = pa.schema([("src_doc_id", pa.int64()), ("line_no", pa.int32()), ("role", pa.string()), ("next_no", pa.int32()), ("ms", pa.list_(pa.string())), ("m", pa.string()), ("m2", pa.string()), ("j", pa.string()), ("hyphen", pa.bool_())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):  # so that no batch of rows grows large
            part = batch.slice(at, 500)
            out: list[list] = [[] for _ in _ARROW]
            for d, t in zip(part.column("src_doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                _pieces(d, t, out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)


def vocabulary(clean: DataFrame) -> DataFrame:
    """Neighbouring words of texts that weren't scanned: m, m2 (null at a line's end) and n, digits masked."""
    # outer, as the optimiser would cut once more to see whether a generator gives rows
    lines = clean.select(F.explode_outer(F.split("text", "\n")).alias("line")).groupBy(masked(F.col("line")).alias("line")).count()
    # lines repeat much in a corpus, so they are counted before they are cut
    ws = lines.select("count", F.filter(F.split("line", r"(?U)\s+"), lambda w: w != "").alias("ws"))
    pairs = ws.select("count", F.posexplode_outer(F.arrays_zip(F.col("ws").alias("w"), F.slice("ws", 2, F.size("ws")).alias("v"))).alias("i", "p"))
    return pairs.groupBy(F.col("p.w").alias("m"), F.col("p.v").alias("m2")).agg(F.sum("count").alias("n")).where("m IS NOT NULL")


def page_noise(source_documents: DataFrame) -> DataFrame:
    """src_doc_id, line_no and noise_kind: one row per noisy line and kind, see the module.

    A document of one line has no line ends; an empty corpus knows no words, so only lines with a hyphen are broken then.
    """
    edges, split, wrong = _found(source_documents)
    misread = wrong.select("src_doc_id", "line_no", F.lit("misread").alias("noise_kind")).distinct()
    return edges.unionByName(split).unionByName(misread)


def _found(source_documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers and page numbers, broken words, and misread words m with the corpus's word best, each with its line.

    The pieces of scanned documents and the corpus's word pairs are each written to the shared folder once, as several
    joins read them.
    """
    pieces = materialise(scanned_documents(source_documents).mapInArrow(_cut, _PIECES), "scan-pieces")
    counted = materialise(vocabulary(source_documents.where((F.col("text") != "") & ~is_scanned()).select("text")), "scan-words")
    words = materialise(with_fold(counted.groupBy("m").agg(F.sum("n").alias("n"))), "scan-vocabulary")
    classes = words.groupBy("f", "u").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("m", F.struct("n", "m")).alias("best"))
    edges = pieces.where("role <> 'line'").select("src_doc_id", "line_no", F.col("role").alias("noise_kind"))
    inside = pieces.where("role = 'line'").select("src_doc_id", "line_no", F.explode("ms").alias("m"))
    unknown = inside.select("m").distinct().join(words.select("m"), "m", "left_anti")
    suspects = _looked_up(with_fold(unknown), classes).where("m <> best").select("m", "best")
    wrong = inside.join(suspects, "m").select("src_doc_id", "line_no", "m", "best")
    ends = pieces.where("role = 'line' AND next_no IS NOT NULL").select("src_doc_id", "line_no", "next_no", "m", "m2", "j", "hyphen")
    verdicts = materialise(_pair_verdicts(ends.select("m", "m2", "j", "hyphen").distinct(), counted, words, classes), "scan-verdicts")
    ends = ends.join(verdicts, ["m", "m2", "j", "hyphen"])
    split = ends.where("split").select("src_doc_id", "line_no", F.lit("split_word").alias("noise_kind"))
    wrong = wrong.unionByName(ends.where("best1 IS NOT NULL").select("src_doc_id", "line_no", "m", F.col("best1").alias("best")))
    return edges, split, wrong.unionByName(ends.where("best2 IS NOT NULL").select("src_doc_id", F.col("next_no").alias("line_no"), F.col("m2").alias("m"), F.col("best2").alias("best")))


def _looked_up(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """The words asked for that look like known ones, with how often the corpus has these and which of them most often."""
    near = asked.join(classes.withColumnRenamed("u", "v"), "f").where(alike("u", "v"))
    return near.groupBy(*asked.columns).agg(F.sum("n").alias("n"), F.max_by("best", F.struct("top", "best")).alias("best"))


def _pair_verdicts(pairs: DataFrame, counted: DataFrame, words: DataFrame, classes: DataFrame) -> DataFrame:
    """For each pair at a line end: split, and, where the word of the first or second line is misread, what it should be.

    A pair without hyphen is one word where the corpus has the whole more often than the pair side by side, or knows
    neither the whole, nor the pair, nor any half of it, where both halves are Hangul.
    """
    asked = pairs.select(F.explode(F.array("m", "m2", "j")).alias("m")).distinct().join(words.select("m", F.lit(True).alias("known")), "m", "left")
    looked = materialise(_looked_up(with_fold(asked), classes), "scan-looked-up")
    p = pairs
    for side, own in (("1", "m"), ("2", "m2"), ("j", "j")):
        p = p.join(looked.select(F.col("m").alias(own), *[F.col(c).alias(f"{c}{side}") for c in ("f", "u", "n", "best", "known")]), own, "left")
    folds = words.select("m", F.col("f").alias("f1"), F.col("u").alias("v1"))
    # only neighbours whose folds some pair asks for, so that common words meet few others
    firsts, seconds = folds.join(p.select("f1").distinct(), "f1", "left_semi"), folds.toDF("m2", "f2", "v2").join(p.select("f2").distinct(), "f2", "left_semi")
    wanted = counted.where("m2 IS NOT NULL").join(firsts, "m").join(seconds, "m2").groupBy("f1", "v1", "f2", "v2").agg(F.sum("n").alias("n"))
    keys = ["f1", "u1", "f2", "u2"]
    bigrams = p.select(*keys).distinct().join(wanted, ["f1", "f2"]).where(alike("u1", "v1") & alike("u2", "v2")).groupBy(*keys).agg(F.sum("n").alias("n_pair"))
    p = p.join(bigrams, keys, "left")
    p = p.fillna(0, ["n1", "n2", "nj", "n_pair"]).fillna(False, ["known1", "known2", "knownj"])
    whole = (F.col("nj") > F.col("n_pair")) | F.expr("nj = 0 AND n_pair = 0 AND n1 = 0 AND n2 = 0 AND m RLIKE '[가-힣]$' AND m2 RLIKE '^[가-힣]'")
    p = p.withColumn("split", F.col("hyphen") | whole)
    wrong = F.expr("split AND NOT knownj AND bestj <> j")
    head, rear = F.expr("substring(bestj, 1, length(m)) = m"), F.expr("right(bestj, length(m2)) = m2")
    alone1, alone2 = F.expr("NOT split AND NOT known1 AND best1 <> m"), F.expr("NOT split AND NOT known2 AND best2 <> m2")
    fix1 = F.when(alone1, F.col("best1")).when(wrong & ~head, F.expr("substring(bestj, 1, length(m))"))
    fix2 = F.when(alone2, F.col("best2")).when(wrong & ~rear, F.expr("right(bestj, length(m2))"))
    return p.select("m", "m2", "j", "hyphen", "split", fix1.alias("best1"), fix2.alias("best2"))


def repaired_text(source_documents: DataFrame) -> DataFrame:
    """src_doc_id and text of each scanned document, as paragraphs: without headers and page numbers, words joined,
    misread words replaced by the corpus's word, lines joined where a sentence goes on.

    The noise found is grouped by document, which is as large as one document's text.
    """
    edges, split, wrong = _found(source_documents)
    none = F.lit(None).cast("string")
    marks = edges.unionByName(split).withColumns({"m": none, "best": none}).unionByName(wrong.select("src_doc_id", "line_no", F.lit("misread").alias("noise_kind"), "m", "best"))
    noise = marks.groupBy("src_doc_id").agg(F.collect_set(F.struct("line_no", "noise_kind", "m", "best")).alias("noise"))
    docs = scanned_documents(source_documents).join(noise, "src_doc_id", "left")
    column = lambda c: F.transform(F.coalesce("noise", F.array().cast("array<struct<line_no:int,noise_kind:string,m:string,best:string>>")), lambda x: x[c])
    join = F.pandas_udf(_join_lines, T.StringType())
    return docs.select("src_doc_id", join("text", *map(column, ("line_no", "noise_kind", "m", "best"))).alias("text"))


#: A line that begins something of its own, or ends a sentence.
_OWN = regex.compile(r"^\s*(?:\d+\.\s|[-○●■□※▪•]\s|[가-힣 ]{2,8}[:：]\s|\S+ \| )|공고 제")
_ENDED = regex.compile(r"(?:[.!?]|[함됨음]|부|자|업|\)|-)\s*$")
_HEADING = regex.compile(r"^\s*\d{1,2}\.\s\D{1,24}$")
#: The end of a line that breaks off inside a date or a period.
_OPEN = regex.compile(r"(?:\d\.|~)\s*$")
#: The commonest misreadings of numbers, put right beside digits.
_AS_DIGIT = regex.compile(r"(?<=\d)[OoIlSB]|[OoIlSB](?=[\d,]*\d|[가-힣])", regex.ASCII)


_RUN = regex.compile("(0)")


def put_right(word: str, best: str) -> str:
    """The word as the corpus has it; best has 0 for each run of digits, which are the word's own, letters taken for digits turned."""
    digits, _ = _tables()
    pattern = "".join("([0-9OoIlSBZ]+)" if x == "0" else "." * len(x) for x in _RUN.split(best))
    own = regex.fullmatch(pattern, word)
    if not own:
        return word
    runs = iter(own.groups())
    return "".join(next(runs).translate(digits) if x == "0" else x for x in _RUN.split(best))


_WORD = regex.compile(r"\S+")


def _line_put_right(line: str, fixes: dict[str, str]) -> str:
    def one(m) -> str:
        word, tail = m[0], ""
        if mask(word) not in fixes and word[-1] in "-‐‑":
            word, tail = word[:-1], word[-1]
        best = fixes.get(mask(word))
        return (put_right(word, best) if best else word) + tail

    return _WORD.sub(one, line)


def _join_lines(texts: pd.Series, lines: pd.Series, kinds: pd.Series, words: pd.Series, bests: pd.Series) -> pd.Series:
    out = []
    for text, *noise in zip(texts, lines, kinds, words, bests, strict=True):
        marks: dict[int, set[str]] = {}
        fixes: dict[int, dict[str, str]] = {}
        for no, kind, m, best in zip(*noise, strict=True):
            marks.setdefault(no, set()).add(kind)
            if m is not None:
                fixes.setdefault(no, {})[m] = best
        whole, glue, headed = "", "\n", False
        for i, line in enumerate(text.split("\n")):
            mine = marks.get(i, ())
            if "header" in mine or "page_no" in mine:
                continue
            if i in fixes:
                line = _line_put_right(line, fixes[i])
            if "misread" in mine:
                line = _AS_DIGIT.sub(lambda m: DIGIT_LIKE[m[0]], line)
            if glue != "" and not _OPEN.search(whole) and (_OWN.search(line) or _ENDED.search(whole) or headed):
                glue = "\n"
            headed = bool(_HEADING.match(line))
            if "split_word" in mine:
                whole, glue = whole + glue * bool(whole) + HYPHEN.sub("", line.rstrip()), ""
            else:
                whole, glue = whole + glue * bool(whole) + line.strip(), " "
        out.append(whole)
    return pd.Series(out)
