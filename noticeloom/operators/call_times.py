"""Deadlines and schedule entries as unambiguous moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeloom.functions.moments import clock_minutes, with_moment


def _entries(extractions: DataFrame, notices: DataFrame, sites: DataFrame) -> DataFrame:
    """The columns of call_moments, repeated rows as often as they come."""
    where = notices.groupBy("notice_id").agg(F.min(F.struct("site_id", "posted_at")).alias("n"))
    where = where.select("notice_id", F.col("n.site_id").alias("site_id"), F.col("n.posted_at").alias("posted"))
    zones = sites.groupBy("site_id").agg(F.min("time_zone").alias("zone"))
    base = extractions.select(
        "extraction_id", "notice_id", F.col("overview.apply_end").alias("apply_end"), clock_minutes(F.col("overview.apply_end_time")).alias("end_minutes"),
        F.transform("schedule", lambda x: F.struct(x["label"].alias("label"), x["date_text"].alias("date_text"))).alias("schedule"),
    )
    base = base.join(where, "notice_id", "left").join(zones, "site_id", "left")
    base = with_moment(base, "apply_end", "posted", "zone", "apply_end_utc", "end_minutes")
    rows = base.select("extraction_id", "apply_end", "apply_end_utc", "posted", "zone", F.posexplode("schedule").alias("ord", "entry"))
    rows = with_moment(rows.select("*", "entry.label", "entry.date_text"), "date_text", "posted", "zone", "entry_utc")
    return rows.select("extraction_id", "ord", "label", "date_text", "entry_utc", "apply_end", "apply_end_utc")


def call_moments(extractions: DataFrame, notices: DataFrame, sites: DataFrame) -> DataFrame:
    """Each schedule entry with its moment and that of the deadline of the same extraction.

    Columns: extraction_id, ord, label, date_text, entry_utc, apply_end, apply_end_utc (UTC, whole minutes). Repeated
    extractions give each entry once, of differing ones the smallest; a notice whose site is unknown has no zone, so only
    texts that state one have a moment. Notices are brought to one row a key first, so the join can't multiply rows;
    posted_at is equal in all copies and the smallest is taken. Empty tables give an empty result, extra columns are not
    read.
    """
    rows = _entries(extractions, notices, sites)
    own = rows.columns[2:]
    return rows.groupBy("extraction_id", "ord").agg(F.min(F.struct(*own)).alias("r")).select("extraction_id", "ord", *[f"r.{c}" for c in own])


def same_minute(extractions: DataFrame, notices: DataFrame, sites: DataFrame) -> DataFrame:
    """extraction_id and ord of schedule entries that name the same minute as the deadline; only these meet in a shuffle.

    The comparison goes through a generator, as the optimiser would write a filter's moments out again in full below
    the steps that make them.
    """
    rows = _entries(extractions, notices, sites)
    same = F.when(F.col("entry_utc") == F.col("apply_end_utc"), F.array("ord"))
    return rows.select("extraction_id", F.explode_outer(same).alias("ord")).where("ord IS NOT NULL").distinct()
