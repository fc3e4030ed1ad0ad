"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

ADAPTIVE = "spark.sql.adaptive.enabled"

# Settings the operators rely on.  Executor sizing belongs to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    ADAPTIVE: "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast by the size measured at run time only: an estimate from compressed
    # files may be far below what the rows take in memory.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
}

# Streaming state larger than executor heap belongs in RocksDB; a commit writes what
# changed, not the files of the whole store.
STREAMING_SETTINGS = {
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


# How many shuffle partitions adaptive execution starts from before merging the
# small ones.  It can merge but, skewed joins aside, not split, so Spark's default
# of 200 would fix the partition size of the largest jobs.
PARTITIONS = "spark.sql.shuffle.partitions"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
DEFAULT_PARTITIONS = 200
PARTITIONS_PER_CORE = 4


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB.

    Every micro-batch opens and commits each partition of the state, however little is
    in it: Spark's default number gives way to four a core.  Adaptive plans go on
    starting from what they started from.
    """
    for key, value in STREAMING_SETTINGS.items():
        spark.conf.set(key, value)
    planned = int(spark.conf.get(PARTITIONS))
    if planned == DEFAULT_PARTITIONS:
        wanted = PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism
        if not spark.conf.get(INITIAL_PARTITIONS, None):
            spark.conf.set(INITIAL_PARTITIONS, max(planned, wanted))
        spark.conf.set(PARTITIONS, wanted)


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Plan with adaptive execution what a micro-batch does to stored tables.

    Spark switches it off in the session of a stream with state, for the state's sake;
    the batch itself is planned by the time it is handed over.
    """
    before = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, "true")
    try:
        yield
    finally:
        spark.conf.set(ADAPTIVE, before)


def configure(
    spark: SparkSession, streaming: bool = False, state_partitions: int | None = None
) -> SparkSession:
    """Apply the library's runtime settings to an existing session.

    A number of shuffle partitions chosen by the user is left alone.  Adaptive
    execution doesn't act on streams with state: ``state_partitions`` sets how many
    partitions these have, fixed for the life of a checkpoint.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    planned = int(spark.conf.get(PARTITIONS))
    wanted = PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism
    if planned == DEFAULT_PARTITIONS < wanted:
        spark.conf.set(INITIAL_PARTITIONS, wanted)
    if streaming or state_partitions:
        use_rocksdb(spark)
    if state_partitions:
        spark.conf.set(PARTITIONS, state_partitions)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the driver and all executors share, if the session names one."""
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if not chosen:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        chosen = context.get() if context.isDefined() else None
    return chosen


def ensure_shared_folder(spark: SparkSession) -> SparkSession:
    """Give a local session without a shared folder one of its own.

    For programs that start the work (tests, the registered queries).  On a cluster
    the folder has to be named in ``spark.checkpoint.dir``.
    """
    if not shared_folder(spark):
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Functions that run in Python on the executors refer to it by its name.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="millrace-")) / package.name
        archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path under the shared folder; fails if there is none."""
    shared = shared_folder(spark)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
