"""History upkeep and outlier detection behind a stream of metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import seconds_in, since
from millrace.functions.time import until
from millrace.operators.history import read_history, stamp, write_history
from millrace.operators.outliers import (
    backfill_anomalies,
    detect_anomalies,
    write_anomalies,
)
from millrace.schemas import METRIC_LABELS
from millrace.session import adaptive
from millrace.streaming.ingest import triggered


def detect_stream(
    metrics: DataFrame,
    history_path: str,
    anomalies_path: str,
    checkpoint: str,
    bucket: str = "1 minute",
    lookback: str = "30 minutes",
    min_points: int = 5,
    threshold: float = 2.0,
    metric_names: Sequence[str] = tuple(METRIC_LABELS),
    trigger: str | None = "5 minutes",
    every_bucket: bool = False,
) -> StreamingQuery:
    """Store each batch of metric rows and judge the newest points.

    ``as_of`` is the end of the newest bucket in the batch, not the clock, and
    both tables are written idempotently: a batch replayed after a failure
    leaves them as they were.  With ``every_bucket`` every point of the batch is
    judged against the lookback before it, not the newest of each series alone:
    after an outage a batch closes many buckets.
    """

    def handle(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            with adaptive(batch.sparkSession):
                store_and_judge(batch)
        finally:
            batch.unpersist()

    def store_and_judge(batch: DataFrame) -> None:
        after = F.col("t") + F.make_dt_interval(secs=F.lit(seconds_in(bucket)))
        span = batch.agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("t"))
        oldest, end = span.select(_text("s"), _text(after)).first()
        if end is None:
            return
        write_history(stamp(batch, end), history_path, persisted=True)
        history = read_history(batch.sparkSession, history_path)
        limits = {"lookback": lookback, "min_points": min_points, "threshold": threshold}
        if every_bucket:
            known = history.where(F.col("metric_name").isin(*metric_names))
            points = until(since(known, oldest, lookback), end)
            found = backfill_anomalies(points, **limits)
            found = since(found, oldest, "0 seconds")
        else:
            found = detect_anomalies(history, end, metric_names=metric_names, **limits)
        write_anomalies(found, anomalies_path)

    writer = (
        metrics.writeStream.foreachBatch(handle)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    return triggered(writer, trigger).start()


def _text(time: Column | str) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX")
