"""A ledger of deliveries: each point is sent until it arrived, and then no more.

Points go to an outbox first.  A run sends those that haven't arrived and whose time
has come, and stores what became of each attempt.  A failed point waits longer after
every attempt and is parked after the last one allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas as S
from millrace.functions import instant, seconds_in
from millrace.operators.conform import with_event_month
from millrace.operators.export import Sender, import_payload
from millrace.sources.tables import read_table

OUTBOX_SCHEMA = T.StructType(
    [
        T.StructField("point_id", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)
ATTEMPT_SCHEMA = T.StructType(
    [
        T.StructField("point_id", T.StringType()),
        T.StructField("attempted_at", T.TimestampType()),
        T.StructField("delivered", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)
_RUN = "attempt_run"
DELIVERED, WAITING, PARKED, QUEUED = "delivered", "waiting", "parked", "queued"


def enqueue(metrics: DataFrame, outbox_path: str) -> int:
    """Add the points that aren't in the outbox yet; returns how many.

    A point is its document: metric, labels, time and value.  A value computed anew is
    another point.
    """
    documents = import_payload(metrics).select(
        F.sha2("payload", 256).alias("point_id"), "metric_name", "timestamp", "payload"
    )
    rows = with_event_month(documents.dropDuplicates(["point_id"])).persist()
    try:
        span = rows.agg(F.min(S.MONTH), F.max(S.MONTH)).first()
        if span[0] is None:
            return 0
        queued = read_table(metrics.sparkSession, outbox_path, OUTBOX_SCHEMA).where(
            F.col(S.MONTH).between(*span)
        )
        new = rows.join(queued.select("point_id"), "point_id", "left_anti").persist()
        try:
            added = new.count()
            if added:
                new.hint("rebalance", S.MONTH).select(
                    *OUTBOX_SCHEMA.fieldNames(), S.MONTH
                ).write.mode("append").partitionBy(S.MONTH).parquet(outbox_path)
            return added
        finally:
            new.unpersist()
    finally:
        rows.unpersist()


def outbox_state(
    outbox: DataFrame, attempts: DataFrame, max_attempts: int, backoff: str
) -> DataFrame:
    """Each point with its attempts so far, its status, and when it is due.

    After attempt k a point waits ``backoff`` times 2 to the power of k - 1.
    """
    tried = attempts.groupBy("point_id").agg(
        F.count("*").alias("attempts"),
        F.bool_or("delivered").alias("arrived"),
        F.max("attempted_at").alias("last_attempt"),
    )
    state = outbox.join(tried, "point_id", "left").withColumn(
        "attempts", F.coalesce("attempts", F.lit(0)).cast("long")
    )
    wait = F.lit(seconds_in(backoff)) * F.pow(F.lit(2.0), F.col("attempts") - 1)
    status = (
        F.when(F.col("attempts") == 0, QUEUED)
        .when(F.col("arrived"), DELIVERED)
        .when(F.col("attempts") >= max_attempts, PARKED)
        .otherwise(WAITING)
    )
    due = F.timestamp_micros(
        F.unix_micros("last_attempt") + (wait * 1_000_000).cast("long")
    )
    return state.withColumn("status", status).withColumn(
        "due_at", F.when(F.col("status") == WAITING, due)
    )


def read_outbox(
    spark: SparkSession, outbox_path: str, attempts_path: str,
    max_attempts: int = 5, backoff: str = "1 minute", without_run: str | None = None,
) -> DataFrame:
    """The outbox as it stands, perhaps without what one run did."""
    attempts = read_table(spark, attempts_path, ATTEMPT_SCHEMA, _RUN)
    if without_run is not None:
        attempts = attempts.where(F.col(_RUN) != without_run)
    outbox = read_table(spark, outbox_path, OUTBOX_SCHEMA)
    return outbox_state(outbox, attempts, max_attempts, backoff)


def _run_name(as_of: str | datetime | Column) -> Column:
    return F.date_format(instant(as_of), "yyyyMMdd'T'HHmmss")


def delivery_job(
    spark: SparkSession,
    outbox_path: str,
    attempts_path: str,
    sender: Sender,
    as_of: str | datetime,
    max_attempts: int = 5,
    backoff: str = "1 minute",
) -> None:
    """Send what is due at ``as_of`` and store the outcome of each attempt.

    Attempts are stored by run.  A run that is repeated sends the same points again and
    replaces its own attempts: a run cut short may have sent some of them, which an
    import endpoint absorbs, since they carry the same time and value.
    """
    moment = instant(as_of)
    run = spark.range(1).select(_run_name(as_of)).first()[0]
    state = read_outbox(spark, outbox_path, attempts_path, max_attempts, backoff, run)
    due = state.where(
        (F.col("status") == QUEUED) | ((F.col("status") == WAITING) & (F.col("due_at") <= moment))
    )

    def deliver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                errors = list(sender(batch["payload"].tolist()))
            except Exception as failure:
                errors = [str(failure)] * len(batch)
            status = batch[["point_id"]].copy()
            status["delivered"] = [e is None for e in errors]
            status["error"] = pd.Series(errors, index=status.index, dtype=object)
            yield status

    sent = due.select("point_id", "payload").mapInPandas(
        deliver, "point_id string, delivered boolean, error string"
    )
    sent.select(
        "point_id", moment.alias("attempted_at"), "delivered", "error", F.lit(run).alias(_RUN)
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        _RUN
    ).parquet(attempts_path)


def ledger_report(state: DataFrame) -> DataFrame:
    """Points of each metric by status, and the attempts they took."""
    return state.groupBy("metric_name").agg(
        F.count("*").alias("points"),
        *[F.count_if(F.col("status") == s).alias(s) for s in (DELIVERED, WAITING, PARKED, QUEUED)],
        F.sum("attempts").alias("attempts"),
    )
