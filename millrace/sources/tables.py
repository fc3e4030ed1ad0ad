"""Stored tables: month-partitioned parquet with declared schemas."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas as S
from millrace.functions import bucket_start, labels_key
from millrace.operators.conform import with_event_month
from millrace.sources.files import Folder


# What a compaction is about to do, and the mark that its merged load is whole.
_PENDING = "_compactions"
_INTENT = f"{_PENDING}/intent"
_MERGED = f"{_PENDING}/merged"
# Which loads each merged load was made of.
_PARTS_OF = "_parts"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, *parts: str
) -> DataFrame:
    """A stored table with its partition columns (the month, if none are given).

    A missing table reads as empty.
    """
    names = parts or (S.MONTH,)
    full = T.StructType(schema.fields + [T.StructField(n, T.StringType()) for n in names])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """The raw event table, whoever wrote its rows."""
    return read_loads(spark, path).drop(S.LOAD)


def read_loads(spark: SparkSession, path: str, loads: Sequence[str] | None = None) -> DataFrame:
    """Raw events with the load of each; of the named loads only, if any are named."""
    Folder(spark, path).refuse_commit_log()
    rows = read_whole_loads(spark, path, S.RAW_EVENT_SCHEMA, S.MONTH)
    return rows if loads is None else rows.where(F.col(S.LOAD).isin(*loads))


def read_whole_loads(
    spark: SparkSession, path: str, schema: T.StructType, part: str
) -> DataFrame:
    """A table of loads within ``part``, each row once.

    Of a merge that was cut short, or still runs, one side is left out: the merged
    load until it is whole, from then on the loads it was made of.  Files are listed
    again if a merge went on meanwhile.
    """
    folder = Folder(spark, path)
    state = _merge_state(folder)
    while True:
        rows = read_table(spark, path, schema, part, S.LOAD)
        state, before = _merge_state(folder), state
        if state == before:
            break
    pending, whole, _ = state
    if pending is not None:
        within, name, parts = pending
        value = within.partition("=")[2]
        hidden = parts if whole else [name]
        rows = rows.where((F.col(part) != value) | ~F.col(S.LOAD).isin(*hidden))
    return rows


def raw_loads(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The raw table's loads, and of merged ones the loads they were made of."""
    folder = Folder(spark, path)
    found: dict[str, list[str]] = {}
    for month in folder.folders():
        if month.startswith(f"{S.MONTH}="):
            for load in folder.folders(month):
                found.setdefault(load.partition("=")[2], [])
    for name in folder.names(_PARTS_OF):
        if name in found:
            found[name] = json.loads(folder.read_text(f"{_PARTS_OF}/{name}"))
    return found


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Rejected message envelopes with the reason of each."""
    Folder(spark, path).refuse_commit_log()
    schema = T.StructType(S.RECORD_SCHEMA.fields + [T.StructField(S.REASON, T.StringType())])
    return read_table(spark, path, schema, S.LOAD).drop(S.LOAD)


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    stored = read_table(spark, path, S.ANOMALY_SCHEMA)
    # Rows from before series were stored are series of their metric alone.
    alone = F.to_json(F.struct("metric_name"))
    return stored.withColumn("series", F.coalesce("series", alone))


def stored_layout(
    df: DataFrame, together: list[str | Column], sort: list[str | Column]
) -> DataFrame:
    """Rows that share ``together`` brought into one file, ordered by ``sort``.

    A rebalancing shuffle: adaptive execution sees the real sizes, splits what is
    too large between tasks, be it one month, one hour or copies of one row, and
    merges what is too small.  Unlike range partitioning it does not compute the
    input a first time to sample it.
    """
    return df.hint("rebalance", *together).sortWithinPartitions(S.MONTH, *sort)


def write_load(df: DataFrame, path: str, load: str | None, *parts: str) -> None:
    """Add rows as a load of their own; a named load replaces itself when repeated."""
    Folder(df.sparkSession, path).refuse_commit_log()
    rows = df.withColumn(S.LOAD, F.lit(load or f"batch-{uuid.uuid4().hex}"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *parts, S.LOAD
    ).parquet(path)


def write_raw_events(df: DataFrame, path: str, load: str | None = None) -> None:
    """Append wide event rows, an hour to a file or less, ordered by time.

    A lookback then skips most files and row groups by their time range.  Batch and
    streaming writers share a table: each write is a load, a folder within the month's.
    A writer that may repeat itself names its ``load`` and then replaces it.
    """
    hour = bucket_start("timestamp", "hour")
    rows = stored_layout(
        with_event_month(df).withColumn("_hour", hour),
        ["_hour"],
        ["timestamp", "session_id", "user_id", "event_type"],
    ).drop("_hour")
    write_load(rows, path, load, S.MONTH)


def write_quarantine(df: DataFrame, path: str, load: str | None = None) -> None:
    """Append rejected envelopes; ``load`` as for the raw table."""
    write_load(df.select(*S.RECORD_SCHEMA.fieldNames(), S.REASON), path, load)


def _pending(folder: Folder) -> tuple[str, str, list[str]] | None:
    """The folder, merged load and parts of a merge that hasn't ended."""
    if not folder.exists(_INTENT):
        return None
    intent = json.loads(folder.read_text(_INTENT))
    return intent["within"], intent["name"], intent["parts"]


def _merge_state(folder: Folder) -> tuple[tuple[str, str, list[str]] | None, bool, list[str]]:
    return _pending(folder), folder.exists(_MERGED), folder.names(_PARTS_OF)


def _load_folder(within: str, load: str) -> str:
    return f"{within}/{S.LOAD}={load}"


def finish_merge(folder: Folder) -> None:
    """Bring a merge to an end that was cut short, from wherever it stands.

    Without the mark the merged load may be half written, and goes; with it, its parts
    go.  The intent goes before the mark: a mark alone means that nothing is left to do.
    """
    if (pending := _pending(folder)) is not None:
        within, name, parts = pending
        if folder.exists(_MERGED):
            for part in parts:
                folder.delete(_load_folder(within, part))
        else:
            folder.delete(_load_folder(within, name))
        folder.delete(_INTENT)
    if folder.exists(_PENDING):
        folder.delete(_PENDING)


def merge_loads(
    folder: Folder, within: str, loads: list[str], made_of: list[str],
    write: Callable[[str], None],
) -> None:
    """Put one load in the place of others; ``write`` stores it under the name given.

    The job may be killed at any point: readers of ``read_whole_loads`` see each row
    once at all times, and ``finish_merge`` ends what this began.
    """
    name = "merged-" + hashlib.md5("\n".join([within, *loads]).encode()).hexdigest()
    folder.write_text(f"{_PARTS_OF}/{name}", json.dumps(made_of))
    folder.commit_text(_INTENT, json.dumps({"within": within, "name": name, "parts": loads}))
    write(name)
    folder.write_text(_MERGED, "")
    finish_merge(folder)


def compact_raw_events(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> int:
    """Merge the loads of each month into one; returns how many were merged.

    ``keep`` names loads to leave alone, such as a stream's latest, which may still be
    repeated, or those that a job over new loads hasn't read yet.  One job at a time.
    The job may be killed at any point: ``read_raw_events`` gives each row once at all
    times, and the next compaction ends what this one began.
    """
    folder = Folder(spark, path)
    folder.refuse_commit_log()
    finish_merge(folder)
    merged = 0
    for within in folder.folders():
        if not within.startswith(f"{S.MONTH}="):
            continue
        loads = [x.partition("=")[2] for x in folder.folders(within)]
        loads = [x for x in loads if x not in keep]
        if len(loads) < 2:
            continue
        known = raw_loads(spark, path)
        made_of = sorted({p for x in loads for p in known.get(x) or [x]})
        stored = read_table(spark, path, S.RAW_EVENT_SCHEMA, S.MONTH, S.LOAD).where(
            (F.col(S.MONTH) == within.partition("=")[2]) & F.col(S.LOAD).isin(*loads)
        )
        rows = stored.drop(S.MONTH, S.LOAD)
        merge_loads(
            folder, within, loads, made_of, lambda name: write_raw_events(rows, path, name)
        )
        merged += len(loads)
    return merged


def metric_layout(df: DataFrame) -> DataFrame:
    """Metric rows in the order series reads want: by name, then by time."""
    together = [c for c in (S.MONTH, S.DAY) if c in df.columns]
    return df.hint("rebalance", *together).sortWithinPartitions(
        *together, "metric_name", "timestamp", labels_key("labels")
    )


def write_by_session(events: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Store events as a table hashed by session, and return it.

    What groups or joins by session then needs no shuffle: a session's rows are in one
    bucket already.  ``buckets`` is fixed for the life of the table; a bucket should fit
    a task.
    """
    events.repartition(buckets, "session_id").write.mode("overwrite").bucketBy(
        buckets, "session_id"
    ).sortBy("session_id").option("path", path).saveAsTable(name)
    return events.sparkSession.table(name)
