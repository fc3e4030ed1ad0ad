"""Cleaning and classification of raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.functions import bounded, classify, normalise, scrub


def enrich(raw: DataFrame) -> DataFrame:
    """Clean the event columns, name the emitting service, drop user-less rows.

    A narrow projection over one filter: time predicates placed on the result
    reach the scan, and columns a query does not use are never read.  Partition
    columns of the input are passed through.
    """
    extra = [F.col(S.MONTH)] if S.MONTH in raw.columns else []
    return raw.where(F.col("user_id") > 0).select(
        "event_type",
        "user_id",
        "session_id",
        "timestamp",
        classify("event_type").alias("service_source"),
        normalise("page").alias("page"),
        bounded("product_id", 0, S.PRODUCT_LIMIT, 0).alias("product_id"),
        normalise("action").alias("action"),
        # An out-of-range quantity counts as one item, so views and orders,
        # which carry no quantity, all show 1.
        bounded("quantity", 0, S.QUANTITY_LIMIT, 1).alias("quantity"),
        scrub("order_id").alias("order_id"),
        bounded("amount", 0, S.AMOUNT_LIMIT, 0).cast(S.AMOUNT).alias("amount"),
        normalise("status").alias("status"),
        "_topic",
        *extra,
    )


def of_services(enriched: DataFrame, *services: str) -> DataFrame:
    """Rows of the named services, or of any known one.

    The event type decides the service, and unlike the computed service name it
    is a stored column, so the filter reaches the scan.
    """
    wanted = services or tuple(S.SERVICE_EVENTS)
    kinds = [kind for name in wanted for kind in S.SERVICE_EVENTS[name]]
    return enriched.where(F.col("event_type").isin(*kinds))
