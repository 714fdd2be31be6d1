"""Agreement of two runs: the first is the reference, the second only confirms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.functions import text as tx

#: The fields that are compared, as the table names them.
OVERVIEW = ("organizer", "apply_start", "apply_end", "apply_end_time", "amount_max_krw", "amount_note", "support_scale", "self_funding_note")
ELIGIBILITY = ("allows_pre_startup", "excludes_pre_startup", "requires_business_registration", "min_startup_years", "max_startup_years", "min_age", "max_age", "max_revenue_krw", "max_employees")
ARRAYS = ("target_regions", "required_certifications", "excluded_targets")
SECTIONS = ("requirements", "exclusions", "documents", "schedule", "risk_points")
#: Signs that a quote needs to stand for an item.
MIN_QUOTE = 4
_TEXTS = frozenset(("organizer", "apply_start", "apply_end", "apply_end_time", "amount_note", "support_scale", "self_funding_note"))
_READ = ("overview", "eligibility", *SECTIONS, "overview_evidence", "eligibility_evidence", "confidence")


def two_runs(extractions: DataFrame) -> DataFrame:
    """notice_id, a and b: the first run's row and the second's, null where there is none; of several the smallest extraction_id."""
    e = extractions.groupBy("notice_id", "run").agg(F.min_by(F.struct(*_READ), "extraction_id").alias("r"))
    a = e.where("run = 1").select("notice_id", F.col("r").alias("a"))
    b = e.where("run = 2").select("notice_id", F.col("r").alias("b"))
    return a.join(b, "notice_id", "left")


def _formed(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns in the form that quotes are compared in."""
    for c in columns:
        rows = tx.with_nfkc(rows, c, "_nfkc").withColumn(c, tx.match_form(F.col("_nfkc"))).drop("_nfkc")
    return rows


def scalar_agreement(extractions: DataFrame) -> DataFrame:
    """notice_id, field and agreed for each non-null value of the first run, where there is a second run.

    Texts agree in match form, numbers and truth values only as they are; a null of the second run agrees with nothing.
    """
    runs = two_runs(extractions).where("b IS NOT NULL")
    fields = [("overview", f) for f in OVERVIEW] + [("eligibility", f) for f in ELIGIBILITY]
    text = lambda s, f, r: F.col(f"{r}.{s}.{f}") if f in _TEXTS else F.lit(None).cast("string")
    same = lambda s, f: F.lit(None).cast("boolean") if f in _TEXTS else F.coalesce(F.col(f"a.{s}.{f}") == F.col(f"b.{s}.{f}"), F.lit(False))
    cell = lambda s, f: F.struct(F.lit(f"{s}.{f}").alias("field"), F.col(f"a.{s}.{f}").isNotNull().alias("given"), text(s, f, "a").alias("mine"), text(s, f, "b").alias("theirs"), same(s, f).alias("same"))
    rows = runs.select("notice_id", F.explode(F.array(*[cell(*x) for x in fields])).alias("c")).where("c.given").select("notice_id", "c.*")
    rows = _formed(rows, "mine", "theirs")
    return rows.select("notice_id", "field", F.coalesce("same", F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False))).alias("agreed"))


def array_agreement(extractions: DataFrame) -> DataFrame:
    """notice_id, field, n, n_kept and agreed: the entries of the first run that the second has too, in match form, copies kept."""
    runs = two_runs(extractions).where("b IS NOT NULL")
    cell = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"a.eligibility.{f}").alias("mine"), F.coalesce(F.col(f"b.eligibility.{f}"), F.array().cast("array<string>")).alias("theirs"))
    cells = runs.select("notice_id", F.explode(F.array(*map(cell, ARRAYS))).alias("c")).where("size(c.mine) > 0").select("notice_id", "c.*")
    mine = _formed(cells.select("notice_id", "field", F.explode("mine").alias("x")), "x")
    theirs = _formed(cells.select("notice_id", "field", F.explode("theirs").alias("x")), "x").distinct().withColumn("there", F.lit(True))
    rows = mine.join(theirs, ["notice_id", "field", "x"], "left").groupBy("notice_id", "field").agg(F.count("*").cast("int").alias("n"), F.count("there").cast("int").alias("n_kept"))
    return rows.select("notice_id", "field", "n", "n_kept", (F.col("n") == F.col("n_kept")).alias("agreed"))


def _items(run: str) -> Column:
    """Items of all sections: section, ord, quote and the text that shows them."""
    show = {"documents": lambda x: x["name"], "schedule": lambda x: F.trim(F.concat_ws(" ", F.coalesce(x["label"], F.lit("")), F.coalesce(x["date_text"], F.lit(""))))}
    none = F.array().cast("array<struct<section:string,ord:int,quote:string,shown:string>>")
    one = lambda s: F.coalesce(F.transform(F.col(f"{run}.{s}"), lambda x, i: F.struct(F.lit(s).alias("section"), i.alias("ord"), x["evidence"]["quote"].alias("quote"), show.get(s, lambda x: x["text"])(x).alias("shown"))), none)
    return F.concat(*map(one, SECTIONS))


def item_stability(extractions: DataFrame) -> DataFrame:
    """notice_id, section, ord and stable of each item of the first run: whether the second has the same.

    Of two items with quotes, one quote must hold the other, both of MIN_QUOTE signs at least; if either has none or an
    empty one, their texts must be equal. In match form. Items of a notice meet only its own of the same section.
    """
    runs = two_runs(extractions).where("b IS NOT NULL")
    split = lambda run, names: _formed(runs.select("notice_id", F.explode(_items(run)).alias("x")).select("notice_id", "x.section", *[F.col(f"x.{c}").alias(n) for c, n in names]).withColumn("given", F.col(names[-2][1]) != ""), names[-2][1], names[-1][1])
    mine = split("a", [("ord", "ord"), ("quote", "q"), ("shown", "t")])
    theirs = split("b", [("quote", "q2"), ("shown", "t2")]).withColumnRenamed("given", "given2").distinct()
    long = (F.length("q") >= MIN_QUOTE) & (F.length("q2") >= MIN_QUOTE)
    quoted = F.coalesce(F.col("given"), F.lit(False)) & F.coalesce(F.col("given2"), F.lit(False))
    same = F.when(quoted, long & (F.contains("q", "q2") | F.contains("q2", "q"))).otherwise(F.col("t").eqNullSafe(F.col("t2")) & F.col("section2").isNotNull())
    pairs = mine.join(theirs.withColumn("section2", F.col("section")), ["notice_id", "section"], "left")
    return pairs.groupBy("notice_id", "section", "ord").agg(F.max(F.coalesce(same, F.lit(False))).alias("stable"))


def confirmed(extractions: DataFrame) -> DataFrame:
    """The first run as the second leaves it: notice_id, dropped fields, kept evidence of both kinds and the smaller confidence.

    A field is dropped where the runs disagree, an array where nothing of it is left; evidence stays for the title and
    for fields with a value that isn't dropped. Without a second run all stays and dropped is null.
    """
    lost = scalar_agreement(extractions).where("NOT agreed").select("notice_id", "field")
    gone = array_agreement(extractions).where("n_kept = 0").select("notice_id", F.concat(F.lit("eligibility."), F.col("field")).alias("field"))
    lost = lost.unionByName(gone).groupBy("notice_id").agg(F.array_sort(F.collect_list("field")).alias("dropped"))
    runs = two_runs(extractions).join(lost, "notice_id", "left")
    dropped = F.coalesce("dropped", F.array().cast("array<string>"))
    given = lambda s, fields: F.filter(F.array(*[F.when(F.coalesce(F.size(f"a.{s}.{f}") > 0, F.lit(False)) if f in ARRAYS else F.col(f"a.{s}.{f}").isNotNull(), F.lit(f)) for f in fields]), lambda f: f.isNotNull() & ~F.array_contains(dropped, F.concat(F.lit(f"{s}."), f)))
    kept = lambda s, fields, more: F.filter(f"a.{s}_evidence", lambda e: F.array_contains(F.concat(given(s, fields), F.array(*map(F.lit, more))), e["field"]))
    both = F.col("b").isNotNull()
    n = lambda s, fields, more=("",): F.coalesce(F.when(both, F.size(kept(s, fields, more))).otherwise(F.size(f"a.{s}_evidence")), F.lit(0))
    return runs.select(
        "notice_id", F.when(both, dropped).alias("dropped"), F.greatest(n("overview", OVERVIEW, ("title",)), F.lit(0)).alias("n_overview"), F.greatest(n("eligibility", ELIGIBILITY + ARRAYS), F.lit(0)).alias("n_eligibility"),
        F.when(~both, F.col("a.confidence")).otherwise(F.least("a.confidence", "b.confidence")).alias("confidence"),
    )


def agreement_counts(extractions: DataFrame) -> DataFrame:
    """One row: fields and items checked, and those that agree, over all notices with two runs."""
    fields = scalar_agreement(extractions).select("agreed").unionByName(array_agreement(extractions).select("agreed"))
    cells = fields.select(F.lit("fields").alias("kind"), "agreed").unionByName(item_stability(extractions).select(F.lit("items").alias("kind"), F.col("stable").alias("agreed")))
    of = lambda k, c: F.count_if((F.col("kind") == k) & c)
    return cells.agg(*[of(k, c).alias(f"{k}_{n}") for k in ("fields", "items") for n, c in (("checked", F.lit(True)), ("agreed", F.col("agreed")))])
