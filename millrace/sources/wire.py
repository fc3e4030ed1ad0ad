"""Message sources: reading records and decoding one JSON object per message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas as S
from millrace.operators.conform import cart_columns, order_columns, view_columns

_CORRUPT = "_corrupt"
_PARSED = "_parsed"
_OBJECT = "m"
_END = "~end"

# Reasons for which a message is rejected.
FOREIGN = "foreign topic"
EMPTY = "empty"
MALFORMED = "malformed"
BAD_TIME = "time out of range"
AHEAD = "time ahead of arrival"
BAD_AMOUNT = "amount out of range"


def read_events(
    spark: SparkSession,
    source: str = "all",
    fmt: str = "kafka",
    streaming: bool = True,
    **options: str,
) -> DataFrame:
    """Message envelopes (key, value, topic, partition, offset, timestamp).

    ``source`` is ``views``, ``carts``, ``orders`` or ``all``.  With the Kafka
    format all topics are read by one consumer, whose offsets live in the
    query's checkpoint.  A first start reads each topic from its earliest message,
    unless ``startingOffsets`` says otherwise.  Any file format holding the same
    envelope works too, with ``path`` among the options.
    """
    topics = list(S.TOPICS.values()) if source == "all" else [S.TOPICS[source]]
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "earliest", **options}
        records = reader.option("subscribe", ",".join(topics)).options(**options).load()
    else:
        records = reader.schema(S.RECORD_SCHEMA).options(**options).load()
        if source != "all":
            records = records.where(F.col("topic") == topics[0])
    return records.withColumn("value", F.col("value").cast("string"))


def _one_object_each(records: DataFrame, value_col: str = "value") -> DataFrame:
    """A row for every object: a message may hold several, one on each line.

    A message that is one object, on however many lines, stays as it is.
    """
    value = F.col(value_col).cast("string")
    whole = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    lines = F.filter(
        F.split(value, r"\r\n|\r|\n"), lambda line: F.length(F.trim(line)) > 0
    )
    several = value.rlike(r"[\r\n]") & ~F.coalesce(whole, F.lit(False))
    parts = F.when(several & (F.size(lines) > 0), lines).otherwise(F.array(value))
    rest = [F.col(c) for c in records.columns if c != value_col]
    split = records.select(*rest, F.explode(parts).alias(value_col))
    return split.select(*records.columns)


def _decode(value: Column, schema: T.StructType) -> Column:
    """The object of a message, decoded as a field of one that ends in a mark.

    The decoder stops at the end of the first object.  Anything that follows a
    message's own object spoils the enclosing one or hides the mark, which is a hash
    of the message, so that no message holds it by chance or design.
    """
    enclosing = T.StructType(
        [
            T.StructField(_OBJECT, schema),
            T.StructField(_END, T.LongType()),
            T.StructField(_CORRUPT, T.StringType()),
        ]
    )
    return F.from_json(
        F.concat(
            F.lit(f'{{"{_OBJECT}":'), value, F.lit(f',"{_END}":'), F.xxhash64(value), F.lit("}")
        ),
        enclosing,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )


def _decoded_once(df: DataFrame, **decoded: Column) -> DataFrame:
    """Add decoded columns that later filters do not evaluate a second time.

    A filter on a projected column is moved below the projection together with
    its expression, so splitting good rows from bad would decode each message
    twice.  Nothing is moved below a generator.
    """
    one = F.struct(*[column.alias(name) for name, column in decoded.items()])
    return df.select("*", F.inline(F.array(one)))


def _fault(value: Column, parsed: str, schema: T.StructType, arrived: Column) -> Column:
    """Why a message of one topic is rejected, NULL if it is not.

    What passes can be conformed without any cast failing.
    """
    fields = schema.fieldNames()
    ended = F.col(f"{parsed}.`{_END}`")
    spoiled = F.col(f"{parsed}.{_CORRUPT}").isNotNull() | F.col(f"{parsed}.{_OBJECT}").isNull()
    fault = F.when(value.isNull() | (F.length(F.trim(value)) == 0), EMPTY).when(
        spoiled | ~ended.eqNullSafe(F.xxhash64(value)), MALFORMED
    )
    if "timestamp" in fields:
        time = F.coalesce(F.col(f"{parsed}.{_OBJECT}.timestamp"), F.lit(S.MIN_EPOCH))
        fault = fault.when((time < S.MIN_EPOCH) | (time >= S.MAX_EPOCH), BAD_TIME)
        fault = fault.when(time > F.unix_seconds(arrived) + S.AHEAD_SECONDS, AHEAD)
    if "amount" in fields:
        amount = F.col(f"{parsed}.{_OBJECT}.amount")
        # NaN is greater than any number.
        fault = fault.when(F.abs(F.round(amount, 2)) > S.MAX_AMOUNT, BAD_AMOUNT)
    return fault


def _filled(parsed: str, schema: T.StructType) -> list[Column]:
    defaults = {T.StringType: "", T.LongType: 0, T.DoubleType: 0.0}
    return [
        F.coalesce(
            F.col(f"{parsed}.{field.name}"), F.lit(defaults[type(field.dataType)])
        ).alias(field.name)
        for field in schema
    ]


def _arrival(df: DataFrame) -> Column:
    # Without an arrival time nothing is ahead of it.
    return F.col("timestamp") if "timestamp" in df.columns else F.lit(None).cast("timestamp")


def parse_json(
    df: DataFrame, schema: T.StructType, value_col: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Decode one topic's messages and split off those that cannot be conformed.

    ``good`` holds the schema's fields, with type defaults for missing ones, plus
    ``_offset`` and ``_ingested_at`` when the envelope has them.  ``bad`` holds
    the envelope and the reason, ready for a quarantine table.  Of a message of
    several lines, each line is judged by itself.
    """
    value = F.col(value_col).cast("string")
    parsed = _decoded_once(
        _one_object_each(df, value_col), **{_PARSED: _decode(value, schema)}
    )
    fault = _fault(value, _PARSED, schema, _arrival(df))
    carried = [
        F.col(name).alias(alias)
        for name, alias in (("offset", "_offset"), ("timestamp", "_ingested_at"))
        if name in df.columns
    ]
    judged = parsed.withColumn(S.REASON, fault)
    good = judged.where(F.col(S.REASON).isNull())
    bad = judged.where(F.col(S.REASON).isNotNull())
    return good.select(*_filled(f"{_PARSED}.{_OBJECT}", schema), *carried), bad.drop(_PARSED)


def decoded_records(records: DataFrame) -> DataFrame:
    """Messages of all topics, one object each, decoded and judged.

    The envelope's columns, a struct per topic, NULL for messages of the other
    topics, and the reason for rejection.  Both halves of ``split_records`` can be
    taken from this frame persisted, so that the source is read and decoded once.
    """
    topic, value = F.col("topic"), F.col("value").cast("string")
    parsed = _decoded_once(
        _one_object_each(records),
        **{
            column: F.when(topic == name, _decode(value, S.WIRE_SCHEMAS[name]))
            for name, column in _TOPIC_COLUMNS.items()
        },
    )
    fault = F.when(~F.coalesce(topic.isin(*_TOPIC_COLUMNS), F.lit(False)), FOREIGN)
    for name, column in _TOPIC_COLUMNS.items():
        judged = _fault(value, column, S.WIRE_SCHEMAS[name], _arrival(records))
        fault = fault.when(topic == name, judged)
    return parsed.withColumn(S.REASON, fault)


_TOPIC_COLUMNS = {
    S.VIEW_TOPIC: "_view",
    S.CART_TOPIC: "_cart",
    S.ORDER_TOPIC: "_order",
}


def split_records(
    decoded: DataFrame, session_from_user: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Decoded messages as (wide rows, rejected envelopes with their reason)."""
    topic, offset, arrived = F.col("topic"), F.col("offset"), F.col("timestamp")

    def field_of(column: str):
        return lambda name: F.col(f"{column}.{_OBJECT}.{name}")

    rows = {
        S.VIEW_TOPIC: view_columns(field_of("_view"), offset),
        S.CART_TOPIC: cart_columns(
            field_of("_cart"), offset, arrived, session_from_user
        ),
        S.ORDER_TOPIC: order_columns(field_of("_order"), offset),
    }
    # The topic is looked at once for a row, not once for each of its columns.
    wide = reduce(
        lambda branch, name: branch.when(topic == name, F.struct(*rows[name])), rows, F
    )
    good = decoded.where(F.col(S.REASON).isNull()).select(F.inline(F.array(wide)))
    rejected = decoded.where(F.col(S.REASON).isNotNull())
    return good, rejected.drop(*_TOPIC_COLUMNS.values())


def conform_records(
    records: DataFrame, session_from_user: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Messages of all topics as (wide rows, rejected envelopes with their reason).

    The same rows as decoding and conforming each topic on its own and merging
    the three, but the source is read once instead of three times.  Messages of
    a foreign topic are rejected.
    """
    return split_records(decoded_records(records), session_from_user)


def union_events(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def field_profile(records: DataFrame) -> DataFrame:
    """What the objects of each topic hold: fields, in and outside the wire schema.

    Every object is parsed once, to a variant, and its fields come from that, whatever
    their number and type.  Messages that hold no object are left out.
    Result: topic, field, type (of the value in JSON), known, messages.
    """
    topic = F.col("topic")
    objects = _one_object_each(records).select(
        "topic", F.try_parse_json(F.col("value").cast("string")).alias("_object")
    )
    whole = objects.where(F.schema_of_variant("_object").startswith("OBJECT"))
    explode = records.sparkSession.tvf.variant_explode
    fields = whole.lateralJoin(explode(F.col("_object").outer())).select("topic", "key", "value")
    kind = F.schema_of_variant("value")
    kind = (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("number")
    )
    known = F.lit(False)
    for name, schema in S.WIRE_SCHEMAS.items():
        known = F.when(topic == name, F.col("key").isin(*schema.fieldNames())).otherwise(known)
    return fields.groupBy("topic", F.col("key").alias("field"), kind.alias("type")).agg(
        F.first(known).alias("known"), F.count("*").alias("messages")
    )
