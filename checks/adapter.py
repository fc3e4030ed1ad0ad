"""The test tables seen as funnel events.

The relabelling gives every branch of the operators data; it has no business
meaning.  ``checks/oracle.py`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.operators.export import to_kafka_records
from millrace.session import configure

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_raw(events: DataFrame, *carry: str) -> DataFrame:
    """``events`` rows (batch or stream) as wide raw events, ``carry`` beside them."""
    return events.selectExpr(
        """CASE event_type WHEN 'view' THEN 'page_view' WHEN 'signup' THEN 'product_click'
        WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'order_event'
        ELSE 'error' END AS event_type""",
        "user_id",
        """concat_ws('-', 'session', user_id, date_format(ts, 'yyyy-MM-dd'))
        AS session_id""",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        """CASE event_type WHEN 'view' THEN ' Home ' WHEN 'signup' THEN 'Product'
        ELSE '' END AS page""",
        """IF(event_type IN ('view', 'signup', 'click'),
        CAST(get_json_object(props, '$.k') AS BIGINT), 0) AS product_id""",
        "IF(event_type = 'click', 'add_to_cart', '') AS action",
        """IF(event_type = 'click', CAST(get_json_object(props, '$.k') AS BIGINT), 0)
        AS quantity""",
        "IF(event_type = 'purchase', concat(' o#', event_id, ' '), '') AS order_id",
        "'' AS cart_id",
        """IF(event_type = 'purchase', CAST(value AS DECIMAL(10, 2)),
        CAST(0 AS DECIMAL(10, 2))) AS amount""",
        "IF(event_type = 'purchase', 'Completed ', '') AS status",
        """CASE event_type WHEN 'click' THEN 'cart-events'
        WHEN 'purchase' THEN 'order-events' ELSE 'page-views' END AS _topic""",
        "event_id AS _offset",
        *carry,
    )


def as_messages(events: DataFrame, *carry: str) -> DataFrame:
    """``events`` rows as message envelopes; ``error`` rows are cut short.

    The cut leaves JSON without its closing brace, which must be quarantined.
    """
    raw = as_raw(events, *carry)
    keyed = raw.withColumn("_arrived", F.col("timestamp"))
    messages = to_kafka_records(
        keyed, carry=("_offset", "_arrived", "event_type", *carry)
    )
    broken = F.substring("value", F.lit(1), F.length("value") - 1)
    envelope = F.struct(
        "key",
        F.when(F.col("event_type") == "error", broken)
        .otherwise(F.col("value"))
        .alias("value"),
        "topic",
        F.lit(0).alias("partition"),
        F.col("_offset").alias("offset"),
        F.col("_arrived").alias("timestamp"),
        *carry,
    )
    # Through a generator, so that the parser's filters see finished messages,
    # as from a real source, and do not encode the JSON again.
    return messages.select(F.inline(F.array(envelope)))


# Rows that the edge messages change, by the remainder of the offset.
EDGE = 97


def edge_messages(messages: DataFrame) -> DataFrame:
    """Messages of which a few hold what producers get wrong.

    By ``offset % 97``: 0 two objects, a line each; 1 trailing text; 2 a time beyond
    any calendar; 3 an amount beyond the column; 4 an amount that is no number; 5 a
    time decades after arrival; 6 a time in milliseconds.
    """
    value, kind = F.col("value"), F.col("offset") % EDGE

    def time(text: str) -> Column:
        return F.regexp_replace(value, '"timestamp":[0-9]+', f'"timestamp":{text}')

    def amount(text: str) -> Column:
        return F.regexp_replace(value, '"amount":[0-9.E]+', f'"amount":{text}')

    changed = (
        F.when(kind == 0, F.concat(value, F.lit("\n"), value))
        .when(kind == 1, F.concat(value, F.lit(" trailing")))
        .when(kind == 2, time("9223372036854775807"))
        .when(kind == 3, amount("1000000000.0"))
        .when(kind == 4, amount('"NaN"'))
        .when(kind == 5, time("2711000000"))
        .when(kind == 6, time("1704067200000"))
        .otherwise(value)
    )
    return messages.withColumn("value", changed)


def orders_as_messages(orders: DataFrame) -> DataFrame:
    """``orders`` rows as order messages, whose amounts cross the upper guard."""
    value = F.struct(
        F.lit("order_event").alias("event_type"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit(" o#"), F.col("o_orderkey")).alias("order_id"),
        F.concat(F.lit("session-"), F.col("o_custkey")).alias("session_id"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        F.col("o_totalprice").alias("amount"),
        F.concat(F.lit(" "), F.col("o_orderstatus")).alias("status"),
    )
    return orders.select(
        F.concat(F.lit("user-"), F.col("o_custkey")).alias("key"),
        F.to_json(value).alias("value"),
        F.lit(S.ORDER_TOPIC).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("o_orderkey").alias("offset"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw(table(spark, sf_dir, "events"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events*.parquet")
        .parquet(sf_dir)
    )


SLICES = 7
ROWS_PER_FILE = 100_000


def message_files(
    spark: SparkSession, sf_dir: str, path: str, backwards: bool = False
) -> int:
    """The messages as files of a slice of time each, written in order of time.

    The slices share the table's own range of times; each is as many files as its
    rows need, the same number for all, which is returned.  Every fifth message or so is
    up to 40 minutes late, so that it may stand in the slice after its own; and each
    slice has a message of the year 2055.  ``backwards`` writes the latest slice first.
    Slices are cut from the events, so that each is encoded once, by as many tasks as
    it has files.
    """
    arrived = F.unix_seconds(F.col("ts").cast("timestamp"))
    late = arrived + (F.col("event_id") % 5) * 600
    events = table(spark, sf_dir, "events").withColumn("_late", late)
    first, last, rows = events.agg(F.min("_late"), F.max("_late"), F.count("*")).first()
    step = (last - first) // SLICES + 1
    far = F.regexp_replace("value", '"timestamp":[0-9]+', '"timestamp":2711000000')
    files = -(-rows // SLICES // ROWS_PER_FILE) or 1
    for i in sorted(range(SLICES), reverse=backwards):
        begin = first + i * step
        mine = events.where((F.col("_late") >= begin) & (F.col("_late") < begin + step))
        ahead = mine.where("event_type = 'purchase'").limit(1)
        both = mine.withColumn("_far", F.lit(False)).union(ahead.withColumn("_far", F.lit(True)))
        messages = as_messages(both.repartition(files, "event_id"), "_far")
        value = F.when(F.col("_far"), far).otherwise(F.col("value"))
        messages.withColumn("value", value).drop("_far").write.mode("append").parquet(path)
    return files
