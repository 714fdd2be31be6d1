"""Texts cut off by a field limit or a broken transfer.

The first signal is the limit: per source and unit (characters and bytes), histograms of lengths are searched for
spikes, and a text of a spike's length that ends without terminal punctuation was cut there. Only a part of a source's
texts may pass through a limited field, so spikes are looked for at all lengths, not at the longest text alone.

Transfers break at any length, so a second signal looks at the end itself: a mark of the break, or a last segment that
is only the beginning of segments (lines, cut at sentence ends) that something follows elsewhere in the corpus, or one
that the corpus doesn't know and that doesn't look like a proper end. Each text says which signal found it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticeloom.session import materialise

#: A length is a spike if so many times more texts have it than the lengths around it have on average, and if that is
#: so unlikely by chance (natural logarithm, of a Poisson count).
SPIKE_RATIO, SPIKE_ODDS, AROUND = 6.0, 8.0, 15
#: Share of the texts at limits from which on their common end is a closing, not a cut.
COMMON_END = 0.02
#: Ends that are whole whatever came before: sentence ends, brackets, numbers, links, closings, table rows.
TERMINAL = r"(?:[.?!。]|[.?!。][)\]”’\"']|[다요죠오까음함됨임]\))$"
CLOSING = r"(?:감사합니다|드림|올림|배상|귀하|이상|끝|\(끝\)|[)\]」』]|[0-9]|[0-9]\s?(?:부|개|명|회|원|일|년|월|건|점)|https?://\S+/\S+|\S+ \| .* \| ?\S+|[-=*_]{3,})$"
CUT_MARK = r"(?:\.{3}|…|�)\s*$"


def _masked(text: Column) -> Column:
    """Numbers, institutions and regions as signs, so that the corpus knows more segments."""
    t = F.regexp_replace(text, "[0-9]+", "0")
    t = F.regexp_replace(t, "[가-힣]+(?:진흥원|재단|센터|산업원|지원단|혁신원|협력단)(?=은|는|이|가|을|를|의|에| |$)", "¤")
    t = F.regexp_replace(t, "(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충청[남북]?|전라[남북]?|경상[남북]?|제주)(?:특별자치도|특별자치시|특별시|광역시|도)?", "§")
    return F.regexp_replace(t, r"https?://\S+/", "https://¤/")


#: Blanks that texts may end in.
_BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SENTENCE, _SEED = r"(?<=[.?!])\s+", 17


def segments(text: Column) -> Column:
    """Lines, cut at sentence ends, without blank ones."""
    return F.filter(F.split(text, r"\n|(?<=[.?!])\s+"), lambda s: F.trim(s) != "")


def spikes(documents: DataFrame) -> DataFrame:
    """source, unit (chars or bytes), length and n of each length that far more texts have than the lengths around it.

    Every text counts. The histogram has a row a source and length, so windows go over lengths, not over texts; a
    source that is null is its own. Runs of neighbouring lengths, as byte limits make them, count together.
    """
    sizes = documents.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("length")))).alias("s"))
    hist = sizes.groupBy("source", "s.unit", "s.length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("length")
    near = F.sum("n").over(w.rangeBetween(-AROUND, AROUND)) - F.sum("n").over(w.rangeBetween(-2, 2))
    run = F.sum("n").over(w.rangeBetween(-2, 2))
    hist = hist.withColumn("rest", near / (2 * AROUND - 4)).withColumn("run", run)
    # a byte limit cuts before a sign, so its spike is up to three bytes wide
    wide = F.when(F.col("unit") == "bytes", F.col("run") / 3).otherwise(F.col("n"))
    odds = lambda n: n * F.log(n / (F.col("rest") + 0.05)) - (n - F.col("rest"))
    spike = (wide >= SPIKE_RATIO * F.greatest("rest", F.lit(0.3))) & (F.col("n") >= SPIKE_RATIO * F.greatest("rest", F.lit(0.3))) & (odds(wide) >= SPIKE_ODDS)
    return hist.where(spike).select("source", "unit", "length", "n")


def ends(documents: DataFrame) -> DataFrame:
    """doc_id, source, the text's end, its masked key and whether it is whole: end_kind terminal, mark, whole, beginning or unknown.

    Null, empty and blank texts are left out; a repeated doc_id counts once, of differing rows the smallest text.
    """
    docs = documents.where(F.col("text").rlike(r"(?U)\S")).groupBy("doc_id").agg(F.min(F.struct("source", "text")).alias("d")).select("doc_id", F.col("d.source").alias("source"), F.col("d.text").alias("text"))
    line = F.substring_index(F.rtrim("text", F.lit(_BLANKS)), "\n", -1)
    end = F.element_at(F.filter(F.split(line, _SENTENCE), lambda x: x.rlike(r"\S")), -1)
    last = docs.select("doc_id", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), end.alias("end"))
    last = last.withColumn("key", F.regexp_replace(_masked(F.col("end")), r"^\s+", ""))
    last = last.withColumn("open", ~F.col("end").rlike(TERMINAL) & ~F.col("end").rlike(CUT_MARK))
    last = materialise(last, "text-ends")  # read by the lookup and by its result
    words = F.split("key", " ")
    asked = last.where("open").select("key", F.slice(words, 1, F.size(words) - 1).alias("before"), F.element_at(words, -1).alias("part")).distinct()
    asked = asked.select("key", F.aggregate("before", F.lit(_SEED).cast("bigint"), lambda h, w: F.xxhash64(h, w)).alias("h"), "part")
    met = asked.join(_continuations(docs, asked.select("h").distinct()), ["h", "part"], "left").groupBy("key").agg(F.max("is_whole").alias("is_whole"), F.max("is_start").alias("is_start"))
    last = last.join(met, "key", "left")
    kind = (
        F.when(F.col("end").rlike(CUT_MARK), "mark").when(F.col("end").rlike(TERMINAL), "terminal").when(F.col("is_whole"), "whole")
        .when(F.col("is_start"), "beginning").otherwise("unknown")
    )
    return last.select("doc_id", "source", "n_chars", "n_bytes", "end", "key", kind.alias("end_kind"))


def _continuations(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, part, is_whole and is_start: beginnings of the corpus's whole segments.

    h stands for the words before, hashed one by one along the segment, so that a segment of n words gives n short
    rows; part is each beginning of the next word. Only words behind wanted hashes are spelled out, so both sides of
    the join to the ends have a row a key: no end meets more than one row. is_whole: a segment ends there; is_start:
    something goes on there.
    """
    # the last one first; outer, as the optimiser would cut the texts once more to see whether a generator gives rows
    segs = docs.select(F.posexplode_outer(F.reverse(segments(F.rtrim("text", F.lit(_BLANKS))))).alias("back", "s")).where("s IS NOT NULL")
    # segments repeat much, so they are made distinct before they are looked at, masked and cut; written, as the optimiser
    # takes the first of two distincts away
    whole = materialise(segs.select((F.col("back") == 0).alias("last"), F.regexp_replace("s", "[0-9]+", "0").alias("s")).distinct(), "whole-segments")
    whole = whole.where(~F.col("last") | F.col("s").rlike(TERMINAL) & ~F.col("s").rlike(CUT_MARK)).select("s").distinct()
    whole = whole.select(F.split(F.regexp_replace(_masked(F.col("s")), r"^\s+|\s+$", ""), " ").alias("ws")).distinct()
    step = lambda acc, w: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), w)))
    hashes = F.aggregate("ws", F.array(F.lit(_SEED).cast("bigint")), step)
    rows = whole.select(F.posexplode(F.arrays_zip(F.slice(hashes, F.lit(1), F.size("ws")).alias("h"), F.col("ws").alias("w"))).alias("i", "x"), F.size("ws").alias("n"))
    rows = rows.groupBy(F.col("x.h").alias("h"), F.col("x.w").alias("w")).agg(F.max(F.col("i") == F.col("n") - 1).alias("at_end"), F.min(F.col("i") == F.col("n") - 1).alias("only_end"))
    spelled = rows.join(wanted, "h", "left_semi").select("h", "w", "at_end", "only_end", F.explode(F.sequence(F.lit(0), F.length("w"))).alias("k"))
    all_of_it = F.col("k") == F.length("w")
    spelled = spelled.select("h", F.expr("substring(w, 1, k)").alias("part"), (all_of_it & F.col("at_end")).alias("is_whole"), (~all_of_it | ~F.col("only_end")).alias("is_start"))
    return spelled.groupBy("h", "part").agg(F.max("is_whole").alias("is_whole"), F.max("is_start").alias("is_start"))


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id, source, end, end_kind, at_limit, cut and signal for each document with a text.

    signal: limit (length at a spike, no terminal punctuation and no end that the corpus knows as whole), mark,
    beginning or unknown (see ends), null where not cut. An end that looks proper but that the corpus doesn't know
    counts as cut at a limit, unless texts at limits have it in common or more texts away from limits end like it.
    """
    e = ends(documents)
    limits = spikes(documents.where(F.col("text").rlike(r"(?U)\S")))
    at = limits.select(F.coalesce("source", F.lit("")).alias("s"), "unit", F.col("length"))
    chars = at.where("unit = 'chars'").select("s", F.col("length").alias("n_chars"), F.lit(True).alias("at_chars"))
    size = at.where("unit = 'bytes'").select("s", F.col("length").alias("n_bytes"), F.lit(True).alias("at_bytes"))
    e = e.withColumn("s", F.coalesce("source", F.lit(""))).join(chars, ["s", "n_chars"], "left").join(size, ["s", "n_bytes"], "left")
    e = materialise(e.select("doc_id", "source", "end", "key", "end_kind", F.coalesce("at_chars", "at_bytes", F.lit(False)).alias("at_limit")), "ends-at-limits")
    unknown = e.where("end_kind = 'unknown'")
    least = max(2.0, COMMON_END * unknown.where("at_limit").count())
    common = unknown.groupBy("key").agg(F.count_if("at_limit").alias("n"), F.count_if(~F.col("at_limit")).alias("away")).where((F.col("n") >= least) | (F.col("away") > F.col("n")))
    e = e.join(common.select("key", F.lit(True).alias("common")), "key", "left")
    proper = F.col("end").rlike(CLOSING)
    sure = F.col("end").rlike(r"https?://\S+/\S+$|끝\)?$") | F.coalesce("common", F.lit(False))
    open_end = F.col("end_kind").isin("mark", "beginning", "unknown") & ~((F.col("end_kind") == "unknown") & proper & sure)
    signal = F.when(F.col("at_limit") & open_end, "limit").when(F.col("end_kind").isin("mark", "beginning"), F.col("end_kind")).when((F.col("end_kind") == "unknown") & ~proper, "unknown")
    return e.select("doc_id", "source", "end", "end_kind", "at_limit", signal.isNotNull().alias("cut"), signal.alias("signal"))


def truncation_report(documents: DataFrame) -> DataFrame:
    """Of each source, documents with a text, those cut, their share, and how many each signal found."""
    t = truncated(documents)
    n, cut = F.count("*"), F.count_if("cut")
    by = [F.count_if(F.coalesce(F.col("signal") == x, F.lit(False))).alias(f"n_{x}") for x in ("limit", "mark", "beginning", "unknown")]
    return t.groupBy("source").agg(n.alias("n_docs"), cut.alias("n_cut"), F.round(cut / n, 6).alias("cut_share"), *by)
