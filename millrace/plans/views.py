"""The stored tables as temporary views, for ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.operators.enrich import enrich
from millrace.operators.history import read_history
from millrace.sources.tables import read_anomalies, read_raw_events


def register_views(
    spark: SparkSession,
    raw_path: str | None = None,
    history_path: str | None = None,
    product_path: str | None = None,
    anomalies_path: str | None = None,
) -> None:
    """Name the given tables ``raw_events``, ``historical_metrics``,
    ``product_metrics`` and ``anomalies``, and ``enriched_events`` on top.

    Views are inlined into each query, so filters on ``timestamp`` and
    ``event_month`` reach the files.
    """
    if raw_path is not None:
        raw = read_raw_events(spark, raw_path)
        raw.createOrReplaceTempView("raw_events")
        enrich(raw).createOrReplaceTempView("enriched_events")
    if history_path is not None:
        read_history(spark, history_path).createOrReplaceTempView("historical_metrics")
    if product_path is not None:
        read_history(spark, product_path).createOrReplaceTempView("product_metrics")
    if anomalies_path is not None:
        read_anomalies(spark, anomalies_path).createOrReplaceTempView("anomalies")
