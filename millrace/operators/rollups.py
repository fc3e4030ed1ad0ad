"""Distinct sessions that roll up: from minutes to hours, days or any range.

Counts of distinct sessions can't be added.  Sets of session numbers can be united:
as bitmaps, exactly, or as sketches, with a small error.  Rows of the finest bucket
are computed once from the events and stored; every coarser figure comes from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.functions import bucket_start
from millrace.operators.enrich import of_services

# log2 of a sketch's registers: an error of about 1.04 / 2 ** 7, 0.8 %.
SKETCH_BITS = 14
_COUNTED = {
    S.VIEW_SERVICE: "viewing_sessions",
    S.CART_SERVICE: "cart_sessions",
    S.ORDER_SERVICE: "order_sessions",
}


def number_sessions(enriched: DataFrame, path: str) -> DataFrame:
    """Give every session a number and store them: session_id, number.

    Numbers follow the first event of a session, so that sessions of one time stand
    close together and a bucket's bitmaps are few.
    """
    first = of_services(enriched).groupBy("session_id").agg(F.min("timestamp").alias("first"))
    dealt = first.repartitionByRange("first", "session_id").sortWithinPartitions("first", "session_id")
    dealt.select("session_id", F.monotonically_increasing_id().alias("number")).write.mode(
        "overwrite"
    ).parquet(path)
    return read_numbers(enriched.sparkSession, path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("session_id string, number long").parquet(path)


def session_bitmaps(enriched: DataFrame, numbers: DataFrame, bucket: str = "minute") -> DataFrame:
    """bucket, service_source, part, bits: which sessions touched a service, and when."""
    touched = of_services(enriched).select(
        bucket_start("timestamp", bucket).alias("bucket"), "service_source", "session_id"
    ).distinct()
    return (
        touched.join(numbers, "session_id")
        .groupBy("bucket", "service_source", F.bitmap_bucket_number("number").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    )


def session_sketches(enriched: DataFrame, bucket: str = "minute") -> DataFrame:
    """bucket, service_source, sketch: the same as sketches of a fixed size."""
    return of_services(enriched).groupBy(
        bucket_start("timestamp", bucket).alias("bucket"), "service_source"
    ).agg(F.hll_sketch_agg("session_id", SKETCH_BITS).alias("sketch"))


def _coarser(bucket: str | None) -> Column:
    return (
        F.lit(None).cast("timestamp") if bucket is None else bucket_start("bucket", bucket)
    ).alias("bucket")


def _by_service(rows: DataFrame, count: str) -> DataFrame:
    return rows.groupBy("bucket").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("service_source") == service, F.col(count))), F.lit(0))
            .cast("long").alias(name)
            for service, name in _COUNTED.items()
        ]
    )


def roll_up_bitmaps(bitmaps: DataFrame, bucket: str | None = None) -> DataFrame:
    """Exact distinct sessions per service and coarser bucket, or over all of it."""
    united = bitmaps.groupBy(_coarser(bucket), "service_source", "part").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("sessions")
    )
    return _by_service(united, "sessions")


def roll_up_sketches(sketches: DataFrame, bucket: str | None = None) -> DataFrame:
    """About as many distinct sessions, from sketches."""
    united = sketches.groupBy(_coarser(bucket), "service_source").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sessions")
    )
    return _by_service(united, "sessions")
