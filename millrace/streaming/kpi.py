"""KPI series from a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import seconds_in
from millrace.operators.kpis import (
    count_sessions,
    order_amount,
    to_metric_rows,
    touched_bits,
)
from millrace.session import use_rocksdb


def not_ahead(
    events: DataFrame, arrived: Column | str, tolerance: str = "1 day"
) -> tuple[DataFrame, DataFrame]:
    """Events as (those dated at most ``tolerance`` after their arrival, the others)."""
    limit = F.col(arrived) if isinstance(arrived, str) else arrived
    limit = limit + F.make_dt_interval(secs=F.lit(seconds_in(tolerance)))
    ahead = F.coalesce(F.col("timestamp") > limit, F.lit(False))
    return events.where(~ahead), events.where(ahead)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, in the batches the query remembers.

    A row counts once for each stateful operator that dropped it.
    """
    return sum(
        operator.numRowsDroppedByWatermark
        for batch in query.recentProgress
        for operator in batch.stateOperators
    )


def bucket_sessions_stream(
    enriched: DataFrame, bucket: str = "1 minute", lateness: str = "1 hour"
) -> DataFrame:
    """Streaming form of ``bucket_sessions``: closed buckets only, each once.

    A bucket is emitted when the watermark, ``lateness`` behind the newest event,
    passes its end.  Exact distinct counts are not allowed on a stream, so the
    two aggregations of the batch form are chained; state holds one small row
    per open (bucket, session), in RocksDB.

    One event far in the future would move the watermark past all honest ones.
    Decoding rejects messages dated ahead of their arrival; events from elsewhere
    need such a filter (``not_ahead``) first.  ``dropped_rows`` counts what came
    too late.
    """
    use_rocksdb(enriched.sparkSession)
    per_session = (
        enriched.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", bucket), "session_id")
        .agg(
            F.bit_or(touched_bits()).alias("touched"),
            F.sum(order_amount()).alias("session_gmv"),
        )
    )
    per_bucket = per_session.groupBy("window").agg(*count_sessions())
    return per_bucket.withColumn("bucket", F.col("window.start")).drop("window")


def kpi_stream(
    enriched: DataFrame, bucket: str = "1 minute", lateness: str = "1 hour"
) -> DataFrame:
    """Metric rows of every closed bucket, for an append-mode sink."""
    return to_metric_rows(bucket_sessions_stream(enriched, bucket, lateness))
