"""Long-format metric history: upsert, storage and reads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.functions import day_of, instant, labels_key
from millrace.operators.conform import with_event_month
from millrace.sources.files import Folder
from millrace.sources.tables import metric_layout, read_table

KEYS = ("metric_name", "timestamp", "labels")
_COLUMNS = S.HISTORY_SCHEMA.fieldNames()
_BATCH = "_batch"
_PARTS = (S.MONTH, S.DAY)


def stamp(metrics: DataFrame, computed_at: str | datetime | Column) -> DataFrame:
    """Metric rows in stored form, marked with the time they were computed."""
    return metrics.withColumn("computed_at", instant(computed_at)).select(
        "timestamp",
        "metric_name",
        F.col("metric_value").cast("double").alias("metric_value"),
        "labels",
        "computed_at",
    )


def current_points(stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The latest computed row of each key; a later value wins a tie.

    Keys are taken from the grouping itself, so that filters on metric, time or
    month pass below it and reach the scan.
    """
    plain = [k for k in keys if k != "labels"]
    plain += [c for c in _PARTS if c in stored.columns]
    # A map is no legal join or window key; its canonical text is.
    text = [labels_key("labels").alias("_labels_key")] if "labels" in keys else []
    rest = [c for c in _COLUMNS if c not in plain]
    if _BATCH not in stored.columns:
        stored = stored.withColumn(_BATCH, F.lit(0))
    newest = F.max_by(F.struct(*rest), F.struct("computed_at", _BATCH, "metric_value"))
    current = stored.groupBy(*plain, *text).agg(newest.alias("row"))
    ordered = [c if c in plain else f"row.{c}" for c in _COLUMNS]
    return current.select(*ordered, *[c for c in plain if c not in _COLUMNS])


def upsert_history(
    existing: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``existing`` with ``new`` merged in: one row per key, the latest computed.

    At equal ``computed_at`` the new row wins, so repeating a run is harmless.
    """
    merged = (
        existing.select(*_COLUMNS)
        .withColumn(_BATCH, F.lit(0))
        .unionByName(new.select(*_COLUMNS).withColumn(_BATCH, F.lit(1)))
    )
    return current_points(merged, keys)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    folder = Folder(spark, path)
    for month in folder.folders():
        if month.startswith(f"{S.MONTH}=") and not folder.folders(month):
            raise ValueError(
                f"{path} is a history by month only: read its rows with read_table and"
                " write them to another folder with write_history"
            )
    return read_table(spark, path, S.HISTORY_SCHEMA, *_PARTS)


def read_history(spark: SparkSession, path: str, deduplicate: bool = False) -> DataFrame:
    """The stored history; ``deduplicate`` when it was written in append mode."""
    stored = _stored(spark, path).drop(S.DAY)
    return current_points(stored) if deduplicate else stored


def _with_parts(rows: DataFrame) -> DataFrame:
    return with_event_month(rows).withColumn(S.DAY, day_of("timestamp"))


def _replace_days(rows: DataFrame, path: str) -> None:
    # Dynamic overwrite must be set here: under a static default the write would drop
    # every other day, and the input with it.
    metric_layout(rows).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*_PARTS).parquet(path)


def write_history(
    df: DataFrame, path: str, mode: str = "upsert", persisted: bool = False
) -> None:
    """Store stamped metric rows, by month and day.

    ``upsert`` merges with the days the rows fall into and rewrites only those, one
    writer at a time.  ``append`` adds files and touches nothing else; read such a
    table with ``deduplicate=True``, and reduce it with ``compact_history``.
    ``persisted`` says that the caller holds the rows already.
    """
    rows = _with_parts(df.select(*_COLUMNS))
    if mode == "append":
        metric_layout(rows).write.mode("append").partitionBy(*_PARTS).parquet(path)
        return
    if mode != "upsert":
        raise ValueError(f"mode must be 'upsert' or 'append', not {mode!r}")
    # Bucketed metrics are small next to the events behind them; hold them once
    # rather than aggregate the events again for each of the two reads below.
    if not persisted:
        rows = rows.persist()
    try:
        span = rows.agg(*[f(c) for c in _PARTS for f in (F.min, F.max)]).first()
        if span[0] is None:
            return
        touched = rows.select(S.DAY).distinct()
        existing = (
            _stored(df.sparkSession, path)
            .where(F.col(S.MONTH).between(*span[:2]) & F.col(S.DAY).between(*span[2:]))
            .join(touched, S.DAY, "left_semi")
        )
        _replace_days(_with_parts(upsert_history(existing, rows)), path)
    finally:
        if not persisted:
            rows.unpersist()


def compact_history(spark: SparkSession, path: str, days: Sequence[str] = ()) -> None:
    """Reduce an append-mode history to the latest row of each key.

    All days, or those given (``yyyyMMdd``), one writer at a time.  Only whole days are
    replaced, so runs that append to other days aren't in the way.
    """
    stored = _stored(spark, path)
    if days:
        months = sorted({d[:6] for d in days})
        stored = stored.where(F.col(S.MONTH).isin(*months) & F.col(S.DAY).isin(*days))
    _replace_days(current_points(stored), path)
