"""KPIs of buckets while they fill, and of rows however late.

No watermark closes a bucket here.  Every micro-batch stores what it adds to each
(bucket, session) as a load of its own, and the buckets it touches are computed again
from the stored rows.  A bucket shows from its first event on; a late event repairs
its bucket and no other; a repeated micro-batch replaces its load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace import schemas as S
from millrace.functions import bucket_start, day_of
from millrace.operators.enrich import of_services
from millrace.operators.history import stamp, write_history
from millrace.operators.kpis import count_sessions, order_amount, to_metric_rows, touched_bits
from millrace.session import adaptive
from millrace.sources.files import Folder
from millrace.sources.tables import finish_merge, merge_loads, read_whole_loads, write_load
from millrace.streaming.ingest import load_name, triggered

BUCKET_SESSION_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("touched", T.IntegerType()),
        T.StructField("session_gmv", T.DecimalType(28, 2)),
    ]
)
_VALUE = BUCKET_SESSION_SCHEMA["session_gmv"].dataType


def add_bucket_sessions(enriched: DataFrame, path: str, load: str, bucket: str) -> None:
    """Store what some events add to each bucket and session, as a load."""
    found = (
        of_services(enriched)
        .groupBy(bucket_start("timestamp", bucket).alias("bucket"), "session_id")
        .agg(
            F.bit_or(touched_bits()).alias("touched"),
            F.sum(order_amount()).cast(_VALUE).alias("session_gmv"),
        )
    )
    rows = found.withColumn(S.DAY, day_of("bucket")).hint("rebalance", S.DAY)
    write_load(rows, path, load, S.DAY)


def read_bucket_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_whole_loads(spark, path, BUCKET_SESSION_SCHEMA, S.DAY)


def touched_metrics(spark: SparkSession, path: str, load: str) -> DataFrame:
    """Metric rows of the buckets that a load touches, from the rows of all loads.

    Only the days of these buckets are read.
    """
    rows = read_bucket_sessions(spark, path)
    mine = rows.where(F.col(S.LOAD) == load).select(S.DAY, "bucket").distinct()
    days = mine.agg(F.collect_set(S.DAY)).first()[0]  # of one micro-batch
    of_days = rows.where(F.col(S.DAY).isin(*days)) if days else rows.limit(0)
    merged = (
        of_days.join(mine.select("bucket"), "bucket", "left_semi")
        .groupBy("bucket", "session_id")
        .agg(F.bit_or("touched").alias("touched"), F.sum("session_gmv").alias("session_gmv"))
    )
    return to_metric_rows(merged.groupBy("bucket").agg(*count_sessions()))


def compact_bucket_sessions(
    spark: SparkSession, path: str, day: str, keep: tuple[str, ...] = ()
) -> int:
    """Merge the loads of a day; returns how many there were.

    ``keep`` names loads to leave alone: a running stream's latest, which may still be
    repeated.  One job at a time.  It may be killed at any point: readers see each row
    once at all times, and the next compaction ends what this one began.
    """
    folder = Folder(spark, path)
    finish_merge(folder)
    within = f"{S.DAY}={day}"
    loads = [x.partition("=")[2] for x in folder.folders(within)]
    loads = [x for x in loads if x not in keep]
    if len(loads) < 2:
        return 0
    rows = read_bucket_sessions(spark, path).where(
        (F.col(S.DAY) == day) & F.col(S.LOAD).isin(*loads)
    )
    merged = (
        rows.groupBy(S.DAY, "bucket", "session_id")
        .agg(
            F.bit_or("touched").alias("touched"),
            F.sum("session_gmv").cast(_VALUE).alias("session_gmv"),
        )
        .select(*BUCKET_SESSION_SCHEMA.fieldNames(), S.DAY)
    )
    merge_loads(
        folder, within, loads, loads, lambda name: write_load(merged, path, name, S.DAY)
    )
    return len(loads)


def open_bucket_stream(
    enriched: DataFrame,
    sessions_path: str,
    history_path: str,
    checkpoint: str,
    bucket: str = "1 minute",
    trigger: str | None = "10 seconds",
) -> StreamingQuery:
    """Keep the history up to date with every event, in open buckets and late ones.

    A bucket's points are marked as computed at its start, so that each computation
    replaces the one before, in whatever order events come.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        load = load_name(checkpoint, batch_id)
        with adaptive(batch.sparkSession):
            add_bucket_sessions(batch, sessions_path, load, bucket)
            metrics = touched_metrics(batch.sparkSession, sessions_path, load)
            write_history(stamp(metrics, F.col("timestamp")), history_path)

    writer = enriched.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return triggered(writer, trigger).start()
