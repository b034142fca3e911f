"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; safe to apply to a session somebody else built.
RUNTIME_CONF = {
    # A repeated key after strip / lower keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key on the large side of a join is split over tasks, even at the price of a shuffle later.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "itemnorm", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the one the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder; on a cluster an unset
    folder is an error, because a machine-local path would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="itemnorm-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_RUN: ContextVar[str] = ContextVar("run", default="")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written intermediate table, inside the folder of the run if there is one."""
    return os.path.join(shared_dir(spark), "itemnorm", _RUN.get(), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def scratch_run(spark: SparkSession):
    """Intermediate tables written inside go when the block ends; what it makes has to be written elsewhere by then."""
    name = f"run-{uuid.uuid4().hex}"
    folder = os.path.join(shared_dir(spark), "itemnorm", name)
    token = _RUN.set(name)
    try:
        yield
    finally:
        _RUN.reset(token)
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Ends the plan's history, survives the loss of executors, and gives the planner the
    table's true size: a checkpointed frame keeps the size *estimate* of its old plan,
    which multiplies from round to round of an iterative join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written = path
    return written


def drop_written(*frames: DataFrame | None) -> None:
    """Deletes tables that `cut_lineage` wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written", None)
        if path:
            _delete(df.sparkSession, path)
