"""The notice tables, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings sites fx_rates mix_targets "
    "notices source_documents preset_documents extractions evidence contacts"
).split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def tables(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    return [table(spark, root, n) for n in names]
