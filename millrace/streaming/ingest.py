"""Continuous ingest of the three topics into the raw event table."""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from millrace.session import adaptive, use_rocksdb
from millrace.sources.tables import write_quarantine, write_raw_events
from millrace.sources.wire import decoded_records, split_records


def triggered(writer: DataStreamWriter, trigger: str | None) -> DataStreamWriter:
    """``trigger`` as a processing interval, or ``None`` to drain and stop."""
    if trigger is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


def load_name(checkpoint: str, batch_id: int) -> str:
    """Name of the load that a micro-batch writes, the same whenever it is repeated."""
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    return f"stream-{stream}-{batch_id}"


def store_records(
    records: DataFrame,
    raw_path: str | None,
    quarantine_path: str | None,
    load: str | None = None,
    session_from_user: bool = True,
) -> None:
    """Store a batch of messages, good and rejected ones, from one pass over them."""
    decoded = decoded_records(records)
    both = raw_path is not None and quarantine_path is not None
    if both:
        decoded = decoded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        wide, rejected = split_records(decoded, session_from_user)
        if raw_path is not None:
            write_raw_events(wide, raw_path, load)
        if quarantine_path is not None:
            write_quarantine(rejected, quarantine_path, load)
    finally:
        if both:
            decoded.unpersist()


def _stored_stream(
    records: DataFrame,
    raw_path: str | None,
    quarantine_path: str | None,
    checkpoint: str,
    trigger: str | None,
    session_from_user: bool = True,
) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        load = load_name(checkpoint, batch_id)
        with adaptive(batch.sparkSession):
            store_records(batch, raw_path, quarantine_path, load, session_from_user)

    writer = records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return triggered(writer, trigger).start()


def ingest_stream(
    records: DataFrame,
    path: str,
    checkpoint: str,
    trigger: str | None = "10 seconds",
    session_from_user: bool = True,
    quarantine_path: str | None = None,
    redelivery: str | None = None,
) -> StreamingQuery:
    """Append every message that can be conformed to the raw event table.

    Each micro-batch is a load of its own, sorted and laid out as a batch writer's; one
    that is repeated after a failure replaces itself.  With ``quarantine_path`` the
    rejected messages are stored from the same pass; without, they are dropped here,
    and ``quarantine_stream`` can store them.  Offsets live in ``checkpoint``, whose
    path names the loads: two streams into one table need two.

    ``redelivery`` is how long after a message it may come again: within that time a
    topic, partition and offset counts once.  State holds one row per message of it.
    """
    if redelivery is not None:
        use_rocksdb(records.sparkSession)
        records = records.withWatermark("timestamp", redelivery)
        records = records.dropDuplicatesWithinWatermark(["topic", "partition", "offset"])
    return _stored_stream(
        records, path, quarantine_path, checkpoint, trigger, session_from_user
    )


def quarantine_stream(
    records: DataFrame, path: str, checkpoint: str, trigger: str | None = "1 minute"
) -> StreamingQuery:
    """Append the messages that ingest rejects, envelope, reason and all."""
    return _stored_stream(records, None, path, checkpoint, trigger)
