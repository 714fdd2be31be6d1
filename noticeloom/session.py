"""Session defaults and the places a job may write to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "noticeloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="noticeloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_RUNS: dict[str, str] = {}


def _run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, deleted at exit."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark).rstrip('/')}/run-{app}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _RUNS[app])
    return _RUNS[app]


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 at exit the gateway may be gone already; the folder's name says whose it is
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several later stages read to the shared folder and read it back.

    Unlike a cache it survives the loss of an executor and isn't recomputed. The folder is deleted when the session's
    Python ends; what a crash leaves behind lies under one folder a session, run-*.
    """
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
