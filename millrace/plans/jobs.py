"""The scheduled jobs, as functions an external scheduler calls."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import instant, seconds_in
from millrace.functions.time import until
from millrace.operators.enrich import enrich, of_services
from millrace.operators.export import Sender, publish, write_import_lines
from millrace.operators.history import read_history, stamp, write_history
from millrace.operators.kpis import bucket_sessions, to_metric_rows
from millrace.operators.moments import detect_from_state
from millrace.operators.offsets import fresh_records, read_offsets, write_offsets
from millrace.operators.outliers import (
    ANOMALY,
    detect_anomalies,
    mark_recorded,
    write_anomalies,
)
from millrace.operators.reports import product_metrics
from millrace.schemas import METRIC_LABELS
from millrace.sources.tables import read_anomalies, read_raw_events
from millrace.streaming.ingest import store_records


def kpi_metrics(
    enriched: DataFrame,
    bucket: str = "minute",
    since: str | datetime | Column | None = None,
    as_of: str | datetime | Column | None = None,
    include_open_bucket: bool = True,
) -> DataFrame:
    """Metric rows of an enriched event table.

    Events of no known service add to none of the series; dropping them first
    keeps their sessions out of the shuffle.
    """
    return to_metric_rows(
        bucket_sessions(
            of_services(enriched),
            bucket,
            since=since,
            as_of=as_of,
            include_open_bucket=include_open_bucket,
        )
    )


def load_job(
    records: DataFrame,
    raw_path: str,
    quarantine_path: str | None = None,
    load: str | None = None,
    offsets_path: str | None = None,
) -> None:
    """Conform a batch of messages into the raw table, rejects into quarantine.

    Both targets are filled from one pass over the messages.  A job that names its
    ``load`` can be repeated.  With ``offsets_path`` messages that another load brought
    are left out, by topic, partition and offset, and this load's offsets are stored;
    such a load needs a name, so that a job cut short between the two can be repeated.
    """
    if offsets_path is not None:
        if load is None:
            raise ValueError("name the load: its offsets are stored under that name")
        records = fresh_records(records, read_offsets(records.sparkSession, offsets_path, load))
        records = records.persist()
    try:
        store_records(records, raw_path, quarantine_path, load)
        if offsets_path is not None:
            write_offsets(records, offsets_path, load)
    finally:
        if offsets_path is not None:
            records.unpersist()


def product_job(
    spark: SparkSession, raw_path: str, product_path: str, as_of: str | datetime
) -> None:
    """Store the all-time totals of the events before ``as_of``."""
    events = enrich(until(read_raw_events(spark, raw_path), as_of))
    write_history(product_metrics(events, as_of), product_path)


def kpi_job(
    spark: SparkSession,
    raw_path: str,
    history_path: str,
    as_of: str | datetime,
    lookback: str = "1 hour",
    bucket: str = "minute",
    mode: str = "upsert",
    import_path: str | None = None,
    sender: Sender | None = None,
    status_path: str | None = None,
) -> None:
    """Compute the KPIs of the lookback once; store them and export the same rows.

    Export goes to JSON lines (``import_path``) or through ``sender``, whose
    per-point delivery status is stored at ``status_path``.
    """
    if sender is not None and status_path is None:
        raise ValueError("a sender needs a status_path: no delivery result is dropped")
    since = instant(as_of) - F.make_dt_interval(secs=F.lit(seconds_in(lookback)))
    events = enrich(read_raw_events(spark, raw_path))
    metrics = stamp(kpi_metrics(events, bucket, since=since, as_of=as_of), as_of)
    metrics = metrics.persist()
    try:
        if import_path is not None:
            write_import_lines(metrics, import_path)
        if sender is not None:
            publish(metrics, sender).write.mode("append").parquet(status_path)
        write_history(metrics, history_path, mode, persisted=True)
    finally:
        metrics.unpersist()


def detection_job(
    spark: SparkSession,
    history_path: str,
    anomalies_path: str,
    as_of: str | datetime,
    lookback: str = "30 minutes",
    min_points: int = 5,
    threshold: float = 2.0,
    metric_names: Sequence[str] = tuple(METRIC_LABELS),
    deduplicate: bool = False,
    series_key: Sequence[str] = ("metric_name",),
    status_path: str | None = None,
    moments_path: str | None = None,
) -> int:
    """Detect over the stored history; returns the number of new anomalies.

    With ``status_path`` the status of every series is stored too, one folder per
    ``as_of``; anomalies stored by an earlier run are "already recorded" there.  With
    ``moments_path``, the state of ``resumed_backfill_job``, the blocks that it closed
    are read as their moments instead of their points, which suits a long lookback.
    """
    history = read_history(spark, history_path, deduplicate)
    options = {
        "min_points": min_points,
        "threshold": threshold,
        "series_key": series_key,
        "metric_names": metric_names,
        "with_status": True,
    }
    if moments_path is None:
        report = detect_anomalies(history, as_of, lookback, **options)
    else:
        report = detect_from_state(spark, history, moments_path, as_of, lookback, **options)
    report = report.persist()
    try:
        if status_path is not None:
            marked = mark_recorded(report, read_anomalies(spark, anomalies_path))
            moment = F.date_format(instant(as_of), "yyyyMMdd'T'HHmmss")
            marked.withColumn("as_of", moment).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("as_of").parquet(status_path)
        flagged = report.where(F.col("status") == ANOMALY).withColumn(
            "detected_at", instant(as_of)
        )
        return write_anomalies(flagged, anomalies_path)
    finally:
        report.unpersist()
