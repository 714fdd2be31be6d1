"""A queue of jobs as a stream: each batch of job files is analysed, the first final state of a job wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

JOB = "job_id bigint, url string, requested_at timestamp"
STATE = "job_id bigint, state string"
FINAL = ("published", "rejected", "failed")


def job_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON files of jobs in a folder, at most a hundred files a batch."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", 100).json(folder)


def first_of_key(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One job a URL within the watermark: requests for what is under way wait for its result."""
    return stream.withWatermark("requested_at", late).dropDuplicatesWithinWatermark(["url"])


def settle(results: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of results (job_id, state) that add to the stored states: none of a job that has a final one already.

    Of several results of one job in a batch a final one wins, then the smallest state.
    """
    w = Window.partitionBy("job_id").orderBy(F.col("state").isin(*FINAL).desc(), "state")
    new = results.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return new.join(states.where(F.col("state").isin(*FINAL)).select("job_id"), "job_id", "left_anti")


def run_jobs(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], states: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Analyse each batch and append to the states table (Parquet folder); a batch that runs again adds nothing twice.

    The folder is made before the first batch, so that a read that fails is a failure and not an empty table. late: keep
    one job a URL within so much time (see first_of_key). Of the stored states only those of the batch's jobs are joined.
    """
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(states)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], STATE).write.mode("append").parquet(states)

    def batch(jobs: DataFrame, batch_id: int) -> None:
        known = jobs.sparkSession.read.schema(STATE).parquet(states)
        own = known.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
        settle(analyse(jobs).select("job_id", "state"), own).write.mode("append").parquet(states)

    jobs = first_of_key(stream, late) if late else stream
    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
