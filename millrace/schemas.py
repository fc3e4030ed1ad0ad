"""Declared schemas and the fixed values the event contract depends on.

Nothing is inferred at read time.  Unsigned 32-bit ids become LONG, because a
signed 32-bit column cannot hold their upper half.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: topic names, event types, metric names, labels, guards ----
VIEW_TOPIC = "page-views"
CART_TOPIC = "cart-events"
ORDER_TOPIC = "order-events"

VIEW_EVENTS = ("page_view", "product_click")
CART_EVENTS = ("add_to_cart", "remove_from_cart", "update_quantity")
ORDER_EVENTS = ("order_event",)

VIEW_SERVICE = "view_service"
CART_SERVICE = "cart_service"
ORDER_SERVICE = "order_service"
UNKNOWN_SERVICE = "unknown"

CONVERSION = "ecommerce_conversion_rate"
ABANDONMENT = "ecommerce_cart_abandonment_rate"
GMV = "ecommerce_gmv"
METRIC_LABELS = {CONVERSION: "conversion", ABANDONMENT: "abandonment", GMV: "revenue"}

PRODUCT_LIMIT = 1_000_000
QUANTITY_LIMIT = 100
AMOUNT_LIMIT = 100_000
ORDER_ID_JUNK = "[^a-zA-Z0-9_-]"
# -----------------------------------------------------------------------------

SERVICE_EVENTS = {
    VIEW_SERVICE: VIEW_EVENTS,
    CART_SERVICE: CART_EVENTS,
    ORDER_SERVICE: ORDER_EVENTS,
}
TOPICS = {"views": VIEW_TOPIC, "carts": CART_TOPIC, "orders": ORDER_TOPIC}

AMOUNT = T.DecimalType(10, 2)
# Holds every amount below AMOUNT_LIMIT; sums of it stay within 64 bits, which
# halves the aggregation state of a session.
GUARDED_AMOUNT = T.DecimalType(8, 2)
LABELS = T.MapType(T.StringType(), T.StringType(), False)

# Envelope of one message, as Spark's Kafka source delivers it.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

VIEW_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("page", T.StringType()),
        T.StructField("product_id", T.LongType()),
    ]
)

CART_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("quantity", T.LongType()),
    ]
)

ORDER_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)

WIRE_SCHEMAS = {
    VIEW_TOPIC: VIEW_SCHEMA,
    CART_TOPIC: CART_SCHEMA,
    ORDER_TOPIC: ORDER_SCHEMA,
}

RAW_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("page", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("cart_id", T.StringType()),
        T.StructField("amount", AMOUNT),
        T.StructField("status", T.StringType()),
        T.StructField("_topic", T.StringType()),
        T.StructField("_offset", T.LongType()),
    ]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("labels", LABELS),
    ]
)

# Stored metrics also carry the time they were computed, which orders upserts.
HISTORY_SCHEMA = T.StructType(
    METRIC_SCHEMA.fields + [T.StructField("computed_at", T.TimestampType())]
)

ANOMALY_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("z_score", T.DoubleType()),
        T.StructField("mean_value", T.DoubleType()),
        T.StructField("stdev_value", T.DoubleType()),
        T.StructField("detected_at", T.TimestampType()),
        # JSON text of the labels that tell the point's series from others.
        T.StructField("series", T.StringType()),
    ]
)

# Every stored table is partitioned by this column, derived from its event time.
MONTH = "event_month"

# The metric history also by day, so that a run rewrites the days it touches.
DAY = "event_day"

# What a message may say, stated as limits of this library.  Event times are epoch
# seconds in UTC from 1970 to before 2100, so that milliseconds are recognised as a
# mistake; an event may lie this far ahead of its arrival; amounts fit ``AMOUNT``.
MIN_EPOCH = 0
MAX_EPOCH = 4_102_444_800
AHEAD_SECONDS = 86_400
MAX_AMOUNT = 99_999_999.99

# Rejected messages say why, and stored rows which load brought them.
REASON = "reason"
LOAD = "event_load"
