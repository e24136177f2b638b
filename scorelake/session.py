"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # files of checkpoints go when the frames do
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

_local: dict[str, str] = {}


def build_session(app_name: str = "scorelake", **conf: str) -> SparkSession:
    """A session with the library's defaults; `conf` wins over them.

    Master, memory and shuffle partitions stay with spark-submit. Only the checkpoint folder must
    be named by the cluster (`spark.checkpoint.dir`), see `materialise`.
    """
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: `spark.checkpoint.dir`, read from the session.

    Where it is unset a local master gets a fresh temporary folder; a cluster gets an error,
    because a machine-local folder would be lost together with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return folder


#: Spark's switch for removing the shuffle files of a query when it ends
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the frames made and run inside go when their query ends."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def materialise(df: DataFrame, label: str = "", free: bool = False) -> DataFrame:
    """Compute `df` once and keep it in the shared folder, its partitioning included.

    Needed where later steps must all see the same physical partitioning (range partitioning
    samples its bounds, so a recomputed stage could disagree with an earlier one), and to cut
    lineage. It is a reliable checkpoint: Spark removes the files when nothing refers to the result
    any more (see DEFAULTS), so jobs and micro-batches leave nothing behind. `label` names the step
    in the Spark UI. With `free` the shuffle files of the step go when it is done, not when the driver next
    collects garbage, so that of a row of steps only one's lie on disk.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if label:
        context.setJobDescription(f"materialise {label}")
    try:
        if not free:
            return df.checkpoint()
        with freed(df.sparkSession):
            return df.select("*").checkpoint()  # a frame takes the switch as it is when the frame is made
    finally:
        if label:
            context.setJobDescription(None)
