"""Metrics over batches: outcomes, rates, durations, reasons, fill rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BUCKETS = ("100", "80-99", "50-79", "<50")


def outcome_counts(outcomes: DataFrame, kind: str, classes: tuple[str, ...]) -> DataFrame:
    """One row: how many outcomes are of each class and of none."""
    other = ~F.coalesce(F.col(kind).isin(*classes), F.lit(False))
    return outcomes.agg(*[F.count_if(F.coalesce(F.col(kind) == c, F.lit(False))).alias(f"n_{c}") for c in classes], F.count_if(other).alias("n_other"), F.count("*").alias("n_all"))


#: Stretches that each group's range of values is cut into.
STRETCHES = 1000


def durations(outcomes: DataFrame, by: str, ms: str, share: float = 0.9) -> DataFrame:
    """Mean, count and nearest-rank percentile of each group; null values are left out, a group of nulls has nulls and 0.

    The range of each group is cut into stretches and counted; only values of the stretch that holds the rank are then
    ranked, by how often each occurs, so that no task sees a group's values but those.
    """
    v = outcomes.where(F.col(ms).isNotNull()).groupBy(F.col(by).alias("g"), F.col(ms).alias("v")).agg(F.count("*").alias("k"))
    ends = v.groupBy(F.col("g").alias("eg")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("k").alias("all"))
    stretch = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * STRETCHES)).otherwise(0).cast("int")
    placed = v.join(ends, F.col("g").eqNullSafe(F.col("eg"))).select("g", "v", "k", "all", stretch.alias("s"))
    rank = F.greatest(F.ceil(F.col("all") * share), F.lit(1))
    hist = placed.groupBy(F.col("g").alias("hg"), F.col("s").alias("hs")).agg(F.sum("k").alias("here"), F.max("all").alias("all"))
    hist = hist.withColumn("upto", F.sum("here").over(Window.partitionBy("hg").orderBy("hs").rowsBetween(Window.unboundedPreceding, 0)))
    at = hist.where((F.col("upto") >= rank) & (F.col("upto") - F.col("here") < rank)).select("hg", "hs", (F.col("upto") - F.col("here")).alias("before"), rank.alias("rank"))
    inside = placed.join(at, F.col("g").eqNullSafe(F.col("hg")) & (F.col("s") == F.col("hs")))
    inside = inside.withColumn("reached", F.col("before") + F.sum("k").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    p = inside.where("reached >= rank").groupBy(F.col("g").alias("pg")).agg(F.min("v").alias("p90"))
    mean = outcomes.groupBy(F.col(by).alias("mg")).agg(F.round(F.avg(ms), 4).alias("mean"), F.count(ms).alias("n"))
    return mean.join(p, F.col("mg").eqNullSafe(F.col("pg")), "left").select(F.col("mg").alias(by), "mean", "p90", "n")


def tier_counts(outcomes: DataFrame, tier: str = "tier") -> DataFrame:
    """One row: outcomes of each tier; a missing tier isn't counted."""
    return outcomes.agg(*[F.count_if(F.coalesce(F.col(tier) == t, F.lit(False))).alias(t) for t in ("tier1", "tier2", "tier3")])


def skipped_counts(skipped: DataFrame) -> DataFrame:
    """One row: skipped attachments, and those of them that are HWP by reason (kind) or file name (file_name)."""
    hwp = F.coalesce(F.col("kind").rlike("(?i)hwp"), F.lit(False)) | F.coalesce(F.col("file_name").rlike(r"(?i)\.hwpx?$"), F.lit(False))
    return skipped.agg(F.count("*").alias("n_skipped"), F.count_if(hwp).alias("n_hwp"))


def token_usage(calls: DataFrame) -> DataFrame:
    """One row: calls, tokens of prompts and replies, and the share of replies that was reasoning; nulls count as nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = F.when(total("completion_tokens") > 0, F.round(total("reasoning_tokens") / total("completion_tokens"), 6)).otherwise(0.0)
    return calls.agg(F.count("*").alias("calls"), *[total(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens")], share.alias("reasoning_share"))


def verified_rates(verdicts: DataFrame) -> DataFrame:
    """field, n, n_verified and rate of verdicts (field, verdict)."""
    return verdicts.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "verified").alias("n_verified"), F.round(F.avg((F.col("verdict") == "verified").cast("double")), 6).alias("rate"))


def bucket(rate: Column) -> Column:
    return F.when(rate >= 1, BUCKETS[0]).when(rate >= 0.8, BUCKETS[1]).when(rate >= 0.5, BUCKETS[2]).otherwise(BUCKETS[3])


def rate_buckets(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Notices by the rate of their quotes that exist; empty buckets are kept. found has notice_id and found."""
    rates = found.groupBy("notice_id").agg(F.avg(F.col("found").cast("double")).alias("rate"))
    counts = rates.groupBy(bucket(F.col("rate")).alias("bucket")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(b,) for b in BUCKETS], "bucket string").join(counts, "bucket", "left").fillna(0, ["n"])


def mean_rate(found: DataFrame) -> DataFrame:
    """Macro average over notices, with the numbers of quotes."""
    per = found.groupBy("notice_id").agg(F.count("*").alias("n"), F.count_if("found").alias("ok"))
    return per.agg(F.round(F.avg(F.col("ok") / F.col("n")), 6).alias("mean_rate"), F.sum("n").alias("quotes_total"), F.sum("ok").alias("quotes_passed"))


def top_reasons(reasons: DataFrame, reason: Column, n: int = 5) -> DataFrame:
    """The commonest reasons, ties in order of their text."""
    return reasons.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def fill_rates(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """field, n_filled and fill_rate; empty arrays count as empty. One pass over the rows."""
    cells = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("filled")) for k, v in columns.items()])
    rows = df.select(F.explode(cells).alias("c")).select("c.*")
    return rows.groupBy("field").agg(F.count_if("filled").alias("n_filled"), F.round(F.avg(F.col("filled").cast("double")), 6).alias("fill_rate"))


def label_counts(df: DataFrame, labels: str, n: int = 15) -> DataFrame:
    """The commonest entries of an array column."""
    return df.select(F.explode(labels).alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def distinct_labels(df: DataFrame, labels: str) -> DataFrame:
    """One row: how many different labels an array column has."""
    return df.select(F.explode(labels).alias("label")).where("label IS NOT NULL").distinct().agg(F.count("*").alias("n_labels"))


def ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in the order of a hash of seed and key, so the same seed gives the same rows."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column], most: int = 5) -> DataFrame:
    """keys and the names of the first constraints that each row breaks; a rule that is null isn't broken."""
    broken = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.slice(broken, 1, most).alias("violations"))
