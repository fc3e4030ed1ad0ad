"""Counts, all-time totals, the session funnel and reads of the metric history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.functions import (
    bucket_start,
    instant,
    labels_key,
    month_of,
    safe_ratio,
    seconds_in,
    since,
)
from millrace.functions.time import until
from millrace.operators.enrich import of_services
from millrace.operators.kpis import (
    CARTED,
    ORDERED,
    count_sessions,
    has_bit,
    order_amount,
    touched_bits,
)

# Names of the all-time metrics and their labels.
TOTAL_CONVERSION = "conversion_rate"
TOTAL_ABANDONMENT = "cart_abandonment_rate"
TOTAL_GMV = "gmv"
# The stored constant that the literal definition of abandonment comes to.
TOTAL_LITERAL = "cart_abandonment_literal"
TOTAL_LABELS = {
    TOTAL_CONVERSION: "conversion",
    TOTAL_ABANDONMENT: "abandonment",
    TOTAL_LITERAL: "abandonment",
    TOTAL_GMV: "revenue",
}


def topic_counts(raw: DataFrame) -> DataFrame:
    """Raw rows per topic."""
    return raw.groupBy("_topic").agg(F.count("*").alias("total_count"))


def events_by_month(raw: DataFrame) -> DataFrame:
    """Raw rows per storage partition."""
    month = F.col(S.MONTH) if S.MONTH in raw.columns else month_of("timestamp")
    return raw.groupBy(month.alias(S.MONTH)).agg(F.count("*").alias("event_count"))


def event_source_counts(enriched: DataFrame) -> DataFrame:
    """Rows per event type and service."""
    return enriched.groupBy("event_type", "service_source").agg(
        F.count("*").alias("event_count")
    )


def sessions_of(enriched: DataFrame, *services: str) -> DataFrame:
    """One row per session with the services it touched and its order value."""
    if services:
        enriched = of_services(enriched, *services)
    return enriched.groupBy("session_id").agg(
        F.bit_or(touched_bits()).alias("touched"),
        F.sum(order_amount()).alias("session_gmv"),
    )


def session_funnel(enriched: DataFrame) -> DataFrame:
    """How many sessions viewed, filled a cart and ordered, with the step rates.

    Rates are 0 where their base is empty.
    """
    return funnel(sessions_of(enriched))


def funnel(sessions: DataFrame) -> DataFrame:
    """The funnel of rows of one session each."""
    totals = sessions.agg(F.count("*").alias("total_sessions"), *count_sessions())
    views, carts, orders = (
        F.col(c) for c in ("viewing_sessions", "cart_sessions", "order_sessions")
    )

    def rate(num: Column, den: Column) -> Column:
        return F.coalesce(safe_ratio(num, den), F.lit(0.0))

    return totals.select(
        "total_sessions",
        views.alias("sessions_with_views"),
        carts.alias("sessions_with_cart"),
        orders.alias("sessions_with_orders"),
        rate(carts, views).alias("view_to_cart_rate"),
        rate(orders, carts).alias("cart_to_order_rate"),
        rate(orders, views).alias("conversion_rate"),
    )


def conversion_rate_total(enriched: DataFrame) -> DataFrame:
    """Ordering sessions per viewing session over all time; NULL without views."""
    counts = sessions_of(enriched, S.VIEW_SERVICE, S.ORDER_SERVICE).agg(*count_sessions())
    return counts.select(
        F.lit(TOTAL_CONVERSION).alias("metric_name"),
        safe_ratio(F.col("order_sessions"), F.col("viewing_sessions")).alias(
            "metric_value"
        ),
    )


def cart_abandonment_literal(enriched: DataFrame) -> DataFrame:
    """Cart sessions seen on a row that is not an order, per cart session.

    No row belongs to two services, so this is 1 wherever there are carts.  See
    :func:`cart_abandonment_sessions` for the share that was really abandoned.
    """
    service = F.col("service_source")
    per_session = of_services(enriched, S.CART_SERVICE).groupBy("session_id").agg(
        F.bool_or(service != S.ORDER_SERVICE).alias("unordered_row")
    )
    counts = per_session.agg(
        F.count("*").alias("carts"), F.count_if("unordered_row").alias("unordered")
    )
    return counts.select(
        F.lit(TOTAL_ABANDONMENT).alias("metric_name"),
        safe_ratio(F.col("unordered"), F.col("carts")).alias("metric_value"),
    )


def cart_abandonment_sessions(enriched: DataFrame) -> DataFrame:
    """Cart sessions that have no order, and their share of all cart sessions.

    An anti join of cart sessions with ordering sessions, done as one grouping:
    the events are read and shuffled once instead of twice.
    """
    touched = sessions_of(enriched, S.CART_SERVICE, S.ORDER_SERVICE)
    in_cart = has_bit("touched", CARTED)
    counts = touched.agg(
        F.count_if(in_cart).alias("cart_sessions"),
        F.count_if(in_cart & ~has_bit("touched", ORDERED)).alias("abandoned_sessions"),
    )
    rate = safe_ratio(F.col("abandoned_sessions"), F.col("cart_sessions"))
    return counts.withColumn("abandonment_rate", rate)


def gmv_total(enriched: DataFrame) -> DataFrame:
    """Value of all orders, 0 without any."""
    total = F.coalesce(F.sum("amount"), F.lit(0)).cast("double")
    return of_services(enriched, S.ORDER_SERVICE).agg(
        F.lit(TOTAL_GMV).alias("metric_name"), total.alias("metric_value")
    )


def product_metrics(enriched: DataFrame, as_of: str | datetime | Column) -> DataFrame:
    """The all-time totals as stored metric rows, from one pass.

    The abandonment rate is the share of cart sessions without an order; the literal
    definition's constant is stored under its own name.  A total that is undefined (no
    views, or no carts) has no row.
    """
    return total_metrics(sessions_of(enriched), as_of)


def total_metrics(sessions: DataFrame, as_of: str | datetime | Column) -> DataFrame:
    """The all-time totals of rows of one session each, as stored metric rows."""
    lost = has_bit("touched", CARTED) & ~has_bit("touched", ORDERED)
    counts = sessions.agg(
        *count_sessions(), F.count_if(lost).alias("abandoned_sessions")
    )
    carts = F.col("cart_sessions")
    values = {
        TOTAL_CONVERSION: safe_ratio(
            F.col("order_sessions"), F.col("viewing_sessions")
        ),
        TOTAL_ABANDONMENT: safe_ratio(F.col("abandoned_sessions"), carts),
        TOTAL_LITERAL: safe_ratio(carts, carts),
        TOTAL_GMV: F.col("gmv").cast("double"),
    }
    points = [
        F.struct(
            instant(as_of).alias("timestamp"),
            F.lit(name).alias("metric_name"),
            value.alias("metric_value"),
            F.create_map(F.lit("type"), F.lit(TOTAL_LABELS[name])).alias("labels"),
            instant(as_of).alias("computed_at"),
        )
        for name, value in values.items()
    ]
    return counts.select(F.inline(F.array(*points))).where(
        F.col("metric_value").isNotNull()
    )


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Number of points and mean value per metric."""
    return metrics.groupBy("metric_name").agg(
        F.count("*").alias("data_points"), F.avg("metric_value").alias("avg_value")
    )


def metric_span(metrics: DataFrame) -> DataFrame:
    """Number of points and first and last time per metric."""
    return metrics.groupBy("metric_name").agg(
        F.count("*").alias("data_points"),
        F.min("timestamp").alias("first_point"),
        F.max("timestamp").alias("last_point"),
    )


def recent_points(
    metrics: DataFrame, as_of: str | datetime | Column, interval: str = "5 minutes"
) -> DataFrame:
    """Number of points newer than ``as_of - interval`` and the newest time."""
    return since(metrics, as_of, interval, inclusive=False).agg(
        F.count("*").alias("new_records"), F.max("timestamp").alias("latest_timestamp")
    )


def latest_points(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest points; ties go by metric name, then by labels."""
    return metrics.orderBy(
        F.col("timestamp").desc(), F.col("metric_name"), labels_key("labels")
    ).limit(n)


def series_range(
    metrics: DataFrame,
    metric_name: str,
    start: str | datetime | Column,
    end: str | datetime | Column,
) -> DataFrame:
    """One metric's points from ``start`` to ``end``, both included, by time.

    Labels break ties, so that many points of one time can still be sorted by
    many tasks.
    """
    lower, upper = instant(start), instant(end)
    kept = metrics.where(
        (F.col("metric_name") == metric_name)
        & F.col("timestamp").between(lower, upper)
    )
    if S.MONTH in metrics.columns:
        kept = kept.where(F.col(S.MONTH).between(month_of(lower), month_of(upper)))
    return kept.orderBy("timestamp", labels_key("labels"))


def panel_series(
    metrics: DataFrame,
    as_of: str | datetime | Column,
    interval: str = "1 hour",
    names: tuple[str, ...] = tuple(S.METRIC_LABELS),
) -> DataFrame:
    """The points every dashboard panel shows, all panels in one scan."""
    shown = until(since(metrics, as_of, interval), as_of)
    return shown.where(F.col("metric_name").isin(*names)).orderBy(
        "metric_name", "timestamp", labels_key("labels")
    )


def panel_steps(
    metrics: DataFrame,
    start: str | datetime | Column,
    end: str | datetime | Column,
    step: str = "1 minute",
    staleness: str = "5 minutes",
    names: tuple[str, ...] = tuple(S.METRIC_LABELS),
) -> DataFrame:
    """Every series on a grid of steps, as a time-series server answers a range.

    The grid holds the multiples of ``step`` from ``start``, floored, to ``end``.  A step
    shows the newest point at or before it, unless that is ``staleness`` old or older;
    a step without such a point has no row.

    Each point is laid on the steps it may show at, and of a step's points the newest
    wins: grouping by series and step, so that no task orders a whole series.
    """
    lower, upper = bucket_start(instant(start), step), instant(end)
    step_us, stale_us = (seconds_in(x) * 1_000_000 for x in (step, staleness))
    kept = metrics.where(
        F.col("metric_name").isin(*names)
        & (F.col("timestamp") > lower - F.make_dt_interval(secs=F.lit(seconds_in(staleness))))
        & (F.col("timestamp") <= upper)
    )
    if S.MONTH in metrics.columns:
        oldest = lower - F.make_dt_interval(secs=F.lit(seconds_in(staleness)))
        kept = kept.where(F.col(S.MONTH).between(month_of(oldest), month_of(upper)))
    us, low, high = F.unix_micros("timestamp"), F.unix_micros(lower), F.unix_micros(upper)
    first = F.greatest(us + F.pmod(-us, F.lit(step_us)), low)
    last = F.least(us + stale_us - 1, high)
    steps = F.when(first <= last, F.sequence(first, last, F.lit(step_us).cast("long")))
    laid = kept.select(
        "metric_name", "labels", labels_key("labels").alias("_key"), "metric_value",
        "timestamp", F.explode(steps).alias("_step"),
    )
    newest = laid.groupBy("metric_name", "_key", "_step").agg(
        F.max_by("metric_value", "timestamp").alias("metric_value"),
        F.first("labels").alias("labels"),
    )
    return newest.select(
        "metric_name", "labels", F.timestamp_micros("_step").alias("timestamp"), "metric_value"
    )
