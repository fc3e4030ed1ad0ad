"""Which messages were loaded: offsets by topic and partition, one bit each.

A load stores the bitmaps of its offsets beside its rows.  From them follow where the
next batch starts, which offsets are missing, and which messages came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas as S
from millrace.sources.tables import read_table, write_load

OFFSET_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        # Number of a block of offsets, and which of them were loaded.
        T.StructField("block", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("first_offset", T.LongType()),
        T.StructField("next_offset", T.LongType()),
        T.StructField("messages", T.LongType()),
    ]
)
_IDENTITY = ["topic", "partition", "offset"]
# Offsets whose gaps one task looks for at a time.
_SPAN = 1 << 16


def offset_bitmaps(records: DataFrame) -> DataFrame:
    """The offsets of some messages, a row for each block of them."""
    return (
        records.where("offset is not null")
        .groupBy("topic", "partition", F.bitmap_bucket_number("offset").alias("block"))
        .agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("offset")).alias("bits"),
            F.min("offset").alias("first_offset"),
            (F.max("offset") + 1).alias("next_offset"),
            F.count("*").alias("messages"),
        )
    )


def write_offsets(records: DataFrame, path: str, load: str) -> None:
    """Store the offsets of a load; a repeated load replaces its own."""
    write_load(offset_bitmaps(records), path, load)


def read_offsets(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """The loaded offsets, all loads together but one that is being repeated."""
    rows = read_table(spark, path, OFFSET_SCHEMA, S.LOAD)
    if without is not None:
        rows = rows.where(F.col(S.LOAD) != without)
    return rows.groupBy("topic", "partition", "block").agg(
        F.bitmap_or_agg("bits").alias("bits"),
        F.min("first_offset").alias("first_offset"),
        F.max("next_offset").alias("next_offset"),
        F.sum("messages").alias("messages"),
    )


def fresh_records(records: DataFrame, loaded: DataFrame) -> DataFrame:
    """Messages not loaded before, each once; those without an offset all stay.

    A join by block with one row per block of offsets, and a bit looked up in it.
    """
    bits = loaded.select(
        F.col("topic").alias("_topic"), F.col("partition").alias("_partition"),
        F.col("block").alias("_block"), F.col("bits").alias("_bits"),
    )
    known = records.where("offset is not null").dropDuplicates(_IDENTITY)
    matched = known.join(
        bits,
        F.col("topic").eqNullSafe(F.col("_topic"))
        & F.col("partition").eqNullSafe(F.col("_partition"))
        & (F.bitmap_bucket_number("offset") == F.col("_block")),
        "left",
    ).withColumn("_at", F.bitmap_bit_position("offset").cast("int"))
    byte = F.expr("cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) as int)")
    held = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) > 0
    new = matched.where(~F.coalesce(held, F.lit(False))).select(*records.columns)
    return new.unionByName(records.where("offset is null"))


def next_offsets(loaded: DataFrame) -> DataFrame:
    """Where the next batch of each topic and partition starts."""
    return loaded.groupBy("topic", "partition").agg(F.max("next_offset").alias("next_offset"))


def starting_offsets(loaded: DataFrame) -> str:
    """``next_offsets`` as the option that a Kafka batch read takes: a number a partition."""
    parts = next_offsets(loaded).groupBy("topic").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("partition").cast("string"), "next_offset"))
        ).alias("parts")
    )
    whole = F.map_from_entries(F.collect_list(F.struct("topic", "parts")))
    return parts.agg(F.to_json(whole)).first()[0]


def offset_gaps(records: DataFrame) -> DataFrame:
    """Runs of offsets that are missing between the first and the last of a partition.

    Gaps inside a span of offsets are found by its own task; between spans only their
    edges are compared, so that one partition with all messages is many tasks.
    """
    offsets = records.where("offset is not null").select(*_IDENTITY).distinct()
    spans = offsets.withColumn("span", F.floor(F.col("offset") / _SPAN))
    within = Window.partitionBy("topic", "partition", "span").orderBy("offset")
    inner = spans.select(
        "topic", "partition", "offset", F.lead("offset").over(within).alias("following")
    )
    edges = spans.groupBy("topic", "partition", "span").agg(
        F.min("offset").alias("first"), F.max("offset").alias("last")
    )
    across = Window.partitionBy("topic", "partition").orderBy("span")
    outer = edges.select(
        "topic", "partition", F.col("last").alias("offset"),
        F.lead("first").over(across).alias("following"),
    )
    return inner.union(outer).where("following > offset + 1").select(
        "topic", "partition", (F.col("offset") + 1).alias("gap_start"),
        (F.col("following") - 1).alias("gap_end"),
        (F.col("following") - F.col("offset") - 1).alias("missing"),
    )


def offset_repeats(records: DataFrame) -> DataFrame:
    """Offsets that came more than once, and how often."""
    counted = records.where("offset is not null").groupBy(*_IDENTITY)
    return counted.agg(F.count("*").alias("deliveries")).where("deliveries > 1")
