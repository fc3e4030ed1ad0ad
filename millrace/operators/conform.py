"""Projection of each wire format into the wide event row.

Each topic contributes only a few of the wide columns; the rest hold the type's
default, so no later operator meets a NULL in an event column.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas as S
from millrace.functions import instant, month_of

_DEFAULTS = {T.StringType: "", T.LongType: 0, T.DecimalType: 0}


def wide_columns(topic: str, **given: Column) -> list[Column]:
    """The wide row's columns: ``given`` where present, type defaults elsewhere."""
    columns = []
    for field in S.RAW_EVENT_SCHEMA:
        default = F.lit(_DEFAULTS.get(type(field.dataType)))
        if field.name == "_topic":
            value = F.lit(topic)
        elif field.name in given:
            # A value that does not fit gives the default instead of ending the
            # job; decoded messages were checked before (``parse_json``).
            value = F.coalesce(given[field.name].try_cast(field.dataType), default)
        else:
            value = default
        columns.append(value.cast(field.dataType).alias(field.name))
    return columns


def _event_time(epoch: Column) -> Column:
    """The time of an epoch second, NULL if it is none of the plausible ones."""
    plausible = (epoch >= S.MIN_EPOCH) & (epoch < S.MAX_EPOCH)
    return F.when(plausible, F.timestamp_seconds(epoch))


def view_columns(get, offset: Column) -> list[Column]:
    return wide_columns(
        S.VIEW_TOPIC,
        event_type=get("event_type"),
        user_id=get("user_id"),
        session_id=get("session_id"),
        timestamp=_event_time(F.coalesce(get("timestamp"), F.lit(0))),
        page=get("page"),
        product_id=get("product_id"),
        _offset=offset,
    )


def cart_columns(
    get, offset: Column, ingest_time: Column, session_from_user: bool = True
) -> list[Column]:
    # Cart messages hold neither a session nor a time: the session is made from
    # the user and the time is that of arrival.
    given = {}
    if session_from_user:
        user = F.coalesce(get("user_id"), F.lit(0)).cast("string")
        given["session_id"] = F.concat(F.lit("session-"), user)
    return wide_columns(
        S.CART_TOPIC,
        event_type=get("type"),
        user_id=get("user_id"),
        timestamp=ingest_time,
        product_id=get("product_id"),
        action=get("type"),
        quantity=get("quantity"),
        _offset=offset,
        **given,
    )


def order_columns(get, offset: Column) -> list[Column]:
    return wide_columns(
        S.ORDER_TOPIC,
        event_type=get("event_type"),
        user_id=get("user_id"),
        session_id=get("session_id"),
        timestamp=_event_time(F.coalesce(get("timestamp"), F.lit(0))),
        order_id=get("order_id"),
        # Rounds half up, as a decimal cast does; binary 8.28 stays 8.28.
        amount=get("amount"),
        status=get("status"),
        _offset=offset,
    )


def _offset_of(df: DataFrame) -> Column:
    return F.col("_offset") if "_offset" in df.columns else F.lit(0)


def conform_views(df: DataFrame) -> DataFrame:
    """Parsed view messages as wide rows."""
    return df.select(*view_columns(F.col, _offset_of(df)))


def conform_carts(
    df: DataFrame,
    ingest_ts: str | datetime | Column | None = None,
    session_from_user: bool = True,
) -> DataFrame:
    """Parsed cart messages as wide rows.

    The event time is ``ingest_ts``, or the message's own arrival time
    (``_ingested_at``, set by the parser), which makes replays repeatable.
    """
    arrived = F.col("_ingested_at") if ingest_ts is None else instant(ingest_ts)
    return df.select(*cart_columns(F.col, _offset_of(df), arrived, session_from_user))


def conform_orders(df: DataFrame) -> DataFrame:
    """Parsed order messages as wide rows; amounts become ``decimal(10,2)``."""
    return df.select(*order_columns(F.col, _offset_of(df)))


def with_event_month(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add the month partition key."""
    return df.withColumn(S.MONTH, month_of(ts))
