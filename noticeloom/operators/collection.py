"""Assembly of a notice's documents: presets, attachments, budgets, caches, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_PAGE, MIN_TEXT, MAX_ATTACHMENTS = 80, 40, 3
KINDS = ("html", "pdf", "hwp", "hwpx", "docx", "image", "text")


def merged_presets(source_documents: DataFrame, preset_documents: DataFrame) -> DataFrame:
    """Documents of notices with the presets that add something: notice_id, url, kind, n_chars, is_preset.

    Own documents win; of presets with one address the smallest preset_id stays, after texts under forty signs are
    dropped; unknown kinds become text. Null addresses are never equal to anything.
    """
    own = source_documents.where("text IS NOT NULL AND url IS NOT NULL").groupBy("notice_id", "url").agg(F.min_by(F.struct("kind", F.length("text").alias("n_chars")), "src_doc_id").alias("d"))
    own = own.select("notice_id", "url", "d.kind", "d.n_chars", F.lit(False).alias("is_preset"))
    long = preset_documents.where((F.length(F.trim("text")) >= MIN_TEXT) & F.col("url").isNotNull())
    first = long.groupBy("notice_id", "url").agg(F.min_by(F.struct("kind", F.length("text").alias("n_chars")), "preset_id").alias("d"))
    kind = F.when(F.col("d.kind").isin(*KINDS), F.col("d.kind")).otherwise("text")
    first = first.select("notice_id", "url", kind.alias("kind"), "d.n_chars", F.lit(True).alias("is_preset"))
    return own.unionByName(first.join(own.select("notice_id", "url"), ["notice_id", "url"], "left_anti"))


def body_texts(notices: DataFrame, source_documents: DataFrame, preset_documents: DataFrame) -> DataFrame:
    """notice_id, from_preset and n_chars of each notice's page: a preset at its address replaces a page, if long enough."""
    n = notices.groupBy("notice_id").agg(F.min("url").alias("url"), F.min("final_url").alias("final_url"))
    page = source_documents.where("doc_ord = 0 AND text IS NOT NULL").groupBy("notice_id").agg(F.min_by("text", "src_doc_id").alias("page"))
    preset = preset_documents.where(F.length(F.trim("text")) >= MIN_PAGE).groupBy("notice_id", "url").agg(F.min_by("text", "preset_id").alias("preset"))
    at = lambda c, out: n.select("notice_id", F.col(c).alias("url")).join(preset, ["notice_id", "url"]).select("notice_id", F.col("preset").alias(out))
    rows = n.join(page, "notice_id", "left").join(at("final_url", "p1"), "notice_id", "left").join(at("url", "p2"), "notice_id", "left")
    found = F.coalesce("p1", "p2")
    return rows.select("notice_id", found.isNotNull().alias("from_preset"), F.length(F.coalesce(found, F.col("page"))).alias("n_chars")).where("n_chars IS NOT NULL")


def first_attachments(source_documents: DataFrame, limit: int = MAX_ATTACHMENTS) -> DataFrame:
    """notice_id, src_doc_id, outcome: attachments in order until enough succeeded; thin ones are skipped."""
    a = source_documents.where("doc_ord > 0").dropDuplicates(["src_doc_id"]).select("notice_id", "doc_ord", "src_doc_id", F.coalesce(F.length(F.trim("text")) >= MIN_TEXT, F.lit(False)).alias("ok"))
    w = Window.partitionBy("notice_id").orderBy("doc_ord", "src_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(w), F.lit(0))
    return a.select("notice_id", "src_doc_id", F.when(before >= limit, "not_tried").when(F.col("ok"), "taken").otherwise("skipped").alias("outcome"))


def prompt_budget(source_documents: DataFrame, each: int = 14_000, total: int = 26_000, rest: int = 500) -> DataFrame:
    """notice_id, src_doc_id and n_chars that a prompt takes of each document, in order, while more than rest is left."""
    d = source_documents.where("text IS NOT NULL").dropDuplicates(["src_doc_id"]).select("notice_id", "doc_ord", "src_doc_id", F.least(F.length("text"), F.lit(each)).alias("want"))
    w = Window.partitionBy("notice_id").orderBy("doc_ord", "src_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(total) - F.coalesce(F.sum("want").over(w), F.lit(0))
    return d.select("notice_id", "src_doc_id", F.when(left > rest, F.least(F.col("want").cast("bigint"), left)).otherwise(0).cast("bigint").alias("n_chars"))


def longest_by_url(source_documents: DataFrame) -> DataFrame:
    """notice_id, url, src_doc_id: of documents collected twice under one address, the longer, the earlier on a tie."""
    d = source_documents.where("url IS NOT NULL").select("notice_id", "url", "src_doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return d.groupBy("notice_id", "url").agg(F.max_by("src_doc_id", F.struct("n", -F.col("src_doc_id"))).alias("src_doc_id"), F.max("n").alias("n_chars"))


def cache_key(model: str, url: Column) -> Column:
    return F.sha1(F.concat_ws("\n", F.lit(model), url))


def cache_misses(notices: DataFrame, cached: DataFrame, model: str) -> DataFrame:
    """notice_id and key of notices whose key isn't in the cache (one column key)."""
    n = notices.where("url IS NOT NULL").groupBy("notice_id").agg(F.min("url").alias("url"))
    return n.select("notice_id", cache_key(model, F.col("url")).alias("key")).join(cached.select("key"), "key", "left_anti").select("notice_id", "key")


def single_flight(requests: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The first request of each key; later ones wait for its result."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(at, tie)).alias("f"), F.count("*").alias("n_requests"))
    return first.select(*keys, F.col(f"f.{tie}").alias(tie), "n_requests")


def throttled(requests: DataFrame, key: str, at: str, tie: str, seconds: int = 3) -> DataFrame:
    """Requests that follow another of the same key by less than some seconds: key, tie and gap_us.

    Time is cut into slices of an hour, or longer if seconds is; each slice of a key is looked through alone, and its
    first request against the last of the slice before, so that no task holds all requests of a key. Null times or keys
    follow nothing.
    """
    width = max(seconds, 3600) * 1_000_000
    rows = requests.select(F.col(key), F.col(tie), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where(F.col(key).isNotNull() & F.col("us").isNotNull()).withColumn("slice", F.floor(F.col("us") / width))
    last = rows.groupBy(key, (F.col("slice") + 1).alias("slice")).agg(F.max("us").alias("before"))
    w = Window.partitionBy(key, "slice").orderBy("us", tie)
    rows = rows.join(last, [key, "slice"], "left").withColumn("gap_us", F.col("us") - F.coalesce(F.lag("us").over(w), F.col("before")))
    return rows.where(F.col("gap_us") < seconds * 1_000_000).select(key, tie, "gap_us")


def best_link(links: DataFrame, key: str) -> DataFrame:
    """The address of each key with a query before one without, the longer, then the smaller; null addresses are left out."""
    rank = F.struct((~F.contains("url", F.lit("?"))).alias("plain"), (-F.length("url")).alias("short"), "url")
    return links.where("url IS NOT NULL").groupBy(key).agg(F.min(rank)["url"].alias("url"))


def collected(notices: DataFrame, source_documents: DataFrame, preset_documents: DataFrame) -> DataFrame:
    """notice_id, url, origin, kind and n_chars of what a notice's analysis reads, and of what it had to skip.

    origin: page; body_preset, where a preset at the page's address takes its place; attachment (the first
    MAX_ATTACHMENTS with enough text); preset (an address not read yet); skipped_page, where there is no page and presets
    stand in; skipped_attachment (too little text). Pages need MIN_PAGE signs, others MIN_TEXT. Of repeated rows the
    smallest key counts; a notice without any text has no row.
    """
    n = notices.groupBy("notice_id").agg(F.min("url").alias("url"), F.min("final_url").alias("final_url")).where("notice_id IS NOT NULL")
    docs = source_documents.where("notice_id IS NOT NULL").groupBy("src_doc_id").agg(F.min(F.struct("notice_id", "doc_ord", "url", "kind", F.coalesce(F.length(F.trim("text")), F.lit(0)).alias("n"))).alias("d")).select("src_doc_id", "d.*")
    page = docs.where("doc_ord = 0").groupBy("notice_id").agg(F.min(F.struct("src_doc_id", "url", "kind", "n")).alias("p")).select("notice_id", "p.*")
    presets = preset_documents.where("notice_id IS NOT NULL AND url IS NOT NULL").select("notice_id", "url", "preset_id", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("text").alias("kind"), F.length(F.trim("text")).alias("n"))
    presets = presets.where(F.col("n") >= MIN_TEXT).groupBy("notice_id", "url").agg(F.min(F.struct("preset_id", "kind", "n")).alias("p")).select("notice_id", "url", "p.kind", "p.n")
    long = presets.where(F.col("n") >= MIN_PAGE).select("notice_id", F.col("url").alias("u"), F.col("n").alias("m"))
    at = lambda c, name: n.select("notice_id", F.col(c).alias("u")).join(long, ["notice_id", "u"]).select("notice_id", F.struct(F.col("u").alias("url"), F.col("m").alias("n")).alias(name))
    body = n.join(page.select("notice_id", F.struct("url", "kind", "n").alias("page")), "notice_id", "left").join(at("final_url", "f"), "notice_id", "left").join(at("url", "g"), "notice_id", "left").withColumn("b", F.coalesce("f", "g"))
    whole = F.when(F.col("b").isNotNull(), F.struct(F.lit("body_preset").alias("origin"), F.col("b.url").alias("url"), F.lit("html").alias("kind"), F.col("b.n").alias("n"))).when(
        F.col("page.n") >= MIN_PAGE, F.struct(F.lit("page").alias("origin"), F.col("page.url").alias("url"), F.col("page.kind").alias("kind"), F.col("page.n").alias("n"))
    ).when(F.col("page").isNull(), F.struct(F.lit("skipped_page").alias("origin"), F.coalesce("final_url", "url").alias("url"), F.lit("html").alias("kind"), F.lit(0).alias("n")))
    first = body.select("notice_id", whole.alias("x")).where("x IS NOT NULL").select("notice_id", "x.*")
    outcome = first_attachments(source_documents).where("outcome <> 'not_tried'").select("src_doc_id", "outcome")
    files = docs.where("doc_ord > 0").join(outcome, "src_doc_id").select("notice_id", F.when(F.col("outcome") == "taken", "attachment").otherwise("skipped_attachment").alias("origin"), "url", "kind", "n")
    own = first.unionByName(files)
    more = presets.join(own.where("origin NOT LIKE 'skipped%'").select("notice_id", "url").distinct(), ["notice_id", "url"], "left_anti").select("notice_id", F.lit("preset").alias("origin"), "url", "kind", "n")
    rows = own.unionByName(more)
    read = rows.where("origin NOT LIKE 'skipped%'").select("notice_id").distinct()
    return rows.join(read, "notice_id", "left_semi").select("notice_id", "url", "origin", "kind", F.col("n").alias("n_chars"))


def first_texts(source_documents: DataFrame, documents: int, signs: int) -> DataFrame:
    """notice_id, n_docs, text: the first signs of each of the first documents of a notice, with line ends between.

    The shorter input of a model that only classifies, or that failed on the whole. Texts are cut before they meet.
    """
    d = source_documents.where("text IS NOT NULL AND notice_id IS NOT NULL").groupBy("src_doc_id").agg(F.min(F.struct("notice_id", "doc_ord", F.substring("text", 1, signs).alias("text"))).alias("d"))
    all_ = d.groupBy("d.notice_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d.doc_ord", "src_doc_id", "d.text"))), F.lit(1), F.lit(documents)).alias("x"))
    return all_.select("notice_id", F.size("x").alias("n_docs"), F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"))


def changed_since(rows: DataFrame, key: str, at: str, since: str, *columns: str) -> DataFrame:
    """key, columns and at of the newest row of each key that came in after a moment; of equally new ones the smallest."""
    newest = rows.where(F.col(at) > F.lit(since).cast("timestamp")).groupBy(key).agg(F.max(F.col(at)).alias("_newest"))
    same = rows.join(newest, key).where(F.col(at) == F.col("_newest"))
    return same.groupBy(key).agg(F.min(F.struct(*columns, at)).alias("_r")).select(key, "_r.*")


def poster_candidates(documents: DataFrame, images: DataFrame, under: int = 400, most: int = 2) -> DataFrame:
    """notice_id, url and place of the first images (notice_id, ord, url) of notices whose documents (notice_id, n_chars) are thin.

    A notice with images but no document at all is thin too. Repeated images count once, null addresses are left out.
    """
    sums = documents.groupBy("notice_id").agg(F.sum("n_chars").alias("all"))
    thin = images.where("url IS NOT NULL AND notice_id IS NOT NULL").groupBy("notice_id", "url").agg(F.min("ord").alias("ord")).join(sums, "notice_id", "left").where(F.coalesce("all", F.lit(0)) < under)
    lists = thin.groupBy("notice_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "url"))), 1, most).alias("x"))
    return lists.select("notice_id", F.posexplode("x").alias("place", "i")).select("notice_id", "i.url", "place")
