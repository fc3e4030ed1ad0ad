"""Bucketed session counts and the three KPI series made from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.functions import bucket_start, instant, month_of, safe_ratio
from millrace.functions.time import until

# One bit per service a session touched; a session's rows are OR-ed together.
VIEWED, CARTED, ORDERED = 1, 2, 4
_BITS = {S.VIEW_SERVICE: VIEWED, S.CART_SERVICE: CARTED, S.ORDER_SERVICE: ORDERED}


def touched_bits(service: Column | str = "service_source") -> Column:
    """Bit of the service that emitted a row, 0 for unknown ones."""
    c = F.col(service) if isinstance(service, str) else service
    expr = F
    for name, bit in _BITS.items():
        expr = expr.when(c == name, F.lit(bit))
    return expr.otherwise(F.lit(0))


def has_bit(mask: Column | str, bit: int) -> Column:
    c = F.col(mask) if isinstance(mask, str) else mask
    return c.bitwiseAND(F.lit(bit)) != 0


def order_amount() -> Column:
    """Amount of an order row.  Enriched amounts are below the guard, so the cast
    is exact; on other input it fails rather than lose digits."""
    amount = F.col("amount").cast(S.GUARDED_AMOUNT)
    return F.when(F.col("service_source") == S.ORDER_SERVICE, amount)


def count_sessions() -> list[Column]:
    """Second-stage aggregates over rows of one (bucket, session) each."""
    return [
        F.count_if(has_bit("touched", VIEWED)).alias("viewing_sessions"),
        F.count_if(has_bit("touched", CARTED)).alias("cart_sessions"),
        F.count_if(has_bit("touched", ORDERED)).alias("order_sessions"),
        F.coalesce(F.sum("session_gmv"), F.lit(0)).alias("gmv"),
    ]


def bucket_sessions(
    df: DataFrame,
    bucket: str = "minute",
    since: str | datetime | Column | None = None,
    as_of: str | datetime | Column | None = None,
    align: bool = True,
    include_open_bucket: bool = True,
    exact: bool = True,
) -> DataFrame:
    """Distinct sessions per service and order value, per time bucket.

    Distinct counts are two plain aggregations: per (bucket, session) which
    services were touched, then per bucket how many sessions touched each.  Both
    combine on the map side, so neither a hot session nor a hot bucket puts its
    rows into one task, and the input is neither expanded nor read twice.

    ``since`` bounds the lookback and is floored to its bucket unless ``align``
    is off; ``as_of`` is the exclusive upper bound, and with
    ``include_open_bucket=False`` the bucket it falls into is left out.
    ``exact=False`` trades exact distinct counts for one shuffle less.
    """
    if since is not None:
        lower = instant(since)
        lower = bucket_start(lower, bucket) if align else lower
        df = df.where(F.col("timestamp") >= lower)
        if S.MONTH in df.columns:
            df = df.where(F.col(S.MONTH) >= month_of(lower))
    if as_of is not None:
        upper = instant(as_of)
        df = until(df, upper if include_open_bucket else bucket_start(upper, bucket))

    keyed = df.withColumn("bucket", bucket_start("timestamp", bucket))
    if not exact:
        sessions_of = lambda service: F.approx_count_distinct(
            F.when(F.col("service_source") == service, F.col("session_id"))
        )
        return keyed.groupBy("bucket").agg(
            sessions_of(S.VIEW_SERVICE).alias("viewing_sessions"),
            sessions_of(S.CART_SERVICE).alias("cart_sessions"),
            sessions_of(S.ORDER_SERVICE).alias("order_sessions"),
            F.coalesce(F.sum(order_amount()), F.lit(0)).alias("gmv"),
        )
    per_session = keyed.groupBy("bucket", "session_id").agg(
        F.bit_or(touched_bits()).alias("touched"),
        F.sum(order_amount()).alias("session_gmv"),
    )
    return per_session.groupBy("bucket").agg(*count_sessions())


def conversion_rate() -> Column:
    """Ordering sessions per viewing session; may exceed 1."""
    return safe_ratio(F.col("order_sessions"), F.col("viewing_sessions"))


def abandonment_rate() -> Column:
    """Share of cart sessions in excess of ordering ones; may be negative."""
    carts = F.col("cart_sessions")
    return safe_ratio(carts - F.col("order_sessions"), carts)


def positive_gmv() -> Column:
    return F.when(F.col("gmv") > 0, F.col("gmv").cast("double"))


_SERIES = {
    S.CONVERSION: conversion_rate,
    S.ABANDONMENT: abandonment_rate,
    S.GMV: positive_gmv,
}


def metric_series(buckets: DataFrame, metric_name: str) -> DataFrame:
    """One KPI as (metric_name, metric_value, timestamp, labels) rows."""
    return buckets.select(
        F.lit(metric_name).alias("metric_name"),
        _SERIES[metric_name]().alias("metric_value"),
        F.col("bucket").alias("timestamp"),
        _labels(metric_name).alias("labels"),
    ).where(F.col("metric_value").isNotNull())


def to_metric_rows(buckets: DataFrame) -> DataFrame:
    """All KPIs in long form, from one pass over the bucket rows."""
    points = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric_name"),
                value().alias("metric_value"),
                F.col("bucket").alias("timestamp"),
                _labels(name).alias("labels"),
            )
            for name, value in _SERIES.items()
        ]
    )
    return buckets.select(F.inline(points)).where(F.col("metric_value").isNotNull())


def _labels(metric_name: str) -> Column:
    return F.create_map(F.lit("type"), F.lit(S.METRIC_LABELS[metric_name]))
