"""Z-score detection on metric series, live and over the whole history.

Input rows must be unique on (metric name, time, labels): read an append-mode
history with ``deduplicate=True`` first.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import schemas as S
from millrace.functions import instant, labels_key, seconds_in, since
from millrace.functions.time import until
from millrace.operators.conform import with_event_month
from millrace.sources.tables import read_anomalies, stored_layout

INSUFFICIENT = "insufficient"
NO_VARIANCE = "no variance"
NORMAL = "normal"
NO_VALUE = "no value"
ANOMALY = "anomaly"
RECORDED = "already recorded"

_POINT = ("timestamp", "metric_name", "metric_value")
# What tells a row from the others of its series, the time first.
_IDENTITY = ("timestamp", "_label", "metric_name")
_STATS = ("z_score", "mean_value", "stdev_value", "history_count", "status")


def _with_series(metrics: DataFrame, series_key: Sequence[str]) -> DataFrame:
    """Add ``_series``, the JSON text of what identifies a row's series."""
    parts = [
        (labels_key(k) if k == "labels" else F.col(k)).alias(k) for k in series_key
    ]
    return metrics.withColumn("_series", F.to_json(F.struct(*parts)))


# Series whose newest point may be broadcast: about a hundred bytes each.
BROADCAST_SERIES = 50_000

# What a history is reduced to: the number of its values, sums of their distances
# from a center and of the squared distances, and their range.
_SUMS = ("n", "center", "s1", "s2", "lo", "hi")


def _judged(df: DataFrame, min_points: int, threshold: float) -> DataFrame:
    """Replace the history's sums by its statistics, z-score and status.

    The center is a value of the history no further from the mean than about one
    deviation, so the subtraction below loses one bit at most; and with values
    that are exact in binary nothing is rounded before the final division, which
    keeps a z of exactly the threshold from being flagged.
    """
    n, center, s1, s2, lo, hi = (F.col(c) for c in _SUMS)
    variance = F.try_divide(F.greatest(n * s2 - s1 * s1, F.lit(0.0)), n * (n - 1))
    flat = lo == hi
    counted = (
        df.withColumn("history_count", n.cast("long"))
        .withColumn("mean_value", center + F.try_divide(s1, n))
        .withColumn(
            "stdev_value", F.when(n > 1, F.when(flat, 0.0).otherwise(F.sqrt(variance)))
        )
    )
    sd = F.col("stdev_value")
    enough = F.col("history_count") >= F.lit(min_points - 1)
    varied = F.coalesce(sd > 0, F.lit(False))
    distance = F.abs(n * (F.col("metric_value") - center) - s1)
    z = F.col("z_score")
    status = (
        F.when(F.col("metric_value").isNull(), NO_VALUE)
        .when(~enough, INSUFFICIENT)
        .when(~varied, NO_VARIANCE)
        .when(z > F.lit(threshold), ANOMALY)
        .otherwise(NORMAL)
    )
    return counted.withColumn(
        "z_score", F.when(enough & varied, F.try_divide(distance, n * sd))
    ).withColumn("status", status)


def _report(df: DataFrame, with_status: bool, detected_at: Column) -> DataFrame:
    series = F.col("_series").alias("series")
    if with_status:
        return df.select(*_POINT, *_STATS, series)
    return df.where(F.col("status") == ANOMALY).select(
        *_POINT,
        "z_score",
        "mean_value",
        "stdev_value",
        detected_at.alias("detected_at"),
        series,
    )


def _newest_rows(points: DataFrame, *more: Column) -> DataFrame:
    """Each series' newest row as ``now``."""
    now = F.max(F.struct(*_IDENTITY, "metric_value")).alias("now")
    return points.groupBy("_series").agg(now, *more)


def _counted_newest(newest: DataFrame) -> DataFrame:
    """The newest rows, to be broadcast if they are counted to be few."""
    few = newest.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES
    return F.broadcast(newest) if few else newest


def detect_anomalies(
    metrics: DataFrame,
    as_of: str | datetime | Column,
    lookback: str | timedelta = "30 minutes",
    min_points: int = 5,
    threshold: float = 2.0,
    series_key: Sequence[str] = ("metric_name",),
    metric_names: Sequence[str] | None = None,
    with_status: bool = False,
) -> DataFrame:
    """Judge each series' newest point before ``as_of`` against its lookback.

    Returns the flagged points, or with ``with_status`` one row per series and
    the reason it was or was not flagged.  ``metric_names`` restricts the check;
    a named metric without any point is then reported as insufficient.

    All series are handled by one plan.  The newest point and a center of each series
    come first; the rows are then compared with them where they are, and only sums
    travel.  The newest points are broadcast if they are counted to be few, which
    reads the lookback once when this is called; with more of them the rows are
    shuffled to meet them.
    """
    if metric_names is not None:
        metrics = metrics.where(F.col("metric_name").isin(*metric_names))
    recent = _with_series(until(since(metrics, as_of, lookback), as_of), series_key)
    recent = recent.select("_series", *_POINT, labels_key("labels").alias("_label"))

    newest = _counted_newest(
        # The median is never further from the mean than one deviation.
        _newest_rows(recent, F.percentile_approx("metric_value", 0.5).alias("center"))
    )
    is_now = F.struct(*_IDENTITY).eqNullSafe(F.struct(*[f"now.{c}" for c in _IDENTITY]))
    past = F.when(~is_now, F.col("metric_value"))
    away = past - F.col("center")
    stats = (
        recent.join(newest, "_series")
        .groupBy("_series")
        .agg(
            # The same in every row of a series.
            F.first("now").alias("now"),
            F.first("center").alias("center"),
            F.count(past).cast("double").alias("n"),
            F.sum(away).alias("s1"),
            F.sum(away * away).alias("s2"),
            F.min(past).alias("lo"),
            F.max(past).alias("hi"),
        )
    )
    points = stats.select(
        "_series", *[F.col(f"now.{c}").alias(c) for c in _POINT], *_SUMS
    )
    judged = _judged(points, min_points, threshold)
    report = _report(judged, with_status, instant(as_of))
    if with_status and metric_names is not None:
        report = _listed(report, metric_names)
    return report


def _listed(report: DataFrame, metric_names: Sequence[str]) -> DataFrame:
    """Add a row for every named metric that has no point in the lookback."""
    listed = F.array(*[F.lit(n) for n in metric_names])
    names = report.sparkSession.range(1).select(F.explode(listed).alias("metric_name"))
    full = names.join(report, "metric_name", "left")
    return full.select(
        *_POINT,
        "z_score",
        "mean_value",
        "stdev_value",
        F.coalesce("history_count", F.lit(0)).cast("long").alias("history_count"),
        F.coalesce("status", F.lit(INSUFFICIENT)).alias("status"),
        F.coalesce("series", F.to_json(F.struct("metric_name"))).alias("series"),
    )


def backfill_anomalies(
    metrics: DataFrame,
    lookback: str | timedelta = "30 minutes",
    min_points: int = 5,
    threshold: float = 2.0,
    block: str | timedelta | None = None,
    series_key: Sequence[str] = ("metric_name",),
    with_status: bool = False,
) -> DataFrame:
    """Judge every point against the ``lookback`` that ends just before it.

    Time is cut into blocks as long as the lookback.  The history of a point is then a
    tail of the block before its own and a head of its own block, and running sums,
    backwards over the one and forwards over the other, give both: the work per point
    doesn't depend on the length of the lookback.  Rows that share a series and a time
    are first combined into one, so that what a block's window sorts is one row per
    distinct time, however many label sets, and however many points, a series holds.

    Each side is summed around a value of its own, the head around its first and the
    tail around its last, which every head and every tail has: sums never hold more
    than the spread of the very values they sum.
    """
    lookback_us = seconds_in(lookback) * 1_000_000
    points = _with_series(metrics, series_key).select(
        "_series", *_POINT, F.unix_micros("timestamp").alias("_us")
    )
    value = F.col("metric_value")
    instants = points.groupBy("_series", "_us").agg(
        F.count(value).cast("double").alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    us = F.col("_us")
    block = us - F.pmod(us, F.lit(lookback_us))

    def role(shift: int, head: bool) -> Column:
        # Rows of the block before stand where they leave the lookback.
        return F.struct(
            (block + shift).alias("_block"), (us + shift).alias("_at"), F.lit(head).alias("_head")
        )

    placed = instants.select(
        "*", F.inline(F.array(role(0, True), role(lookback_us, False)))
    )
    of_block = Window.partitionBy("_series", "_block").orderBy("_at")
    whole = of_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_head = F.col("_head")
    known = F.when(F.col("n") > 0, F.col("mean"))
    centered = placed.withColumns(
        {
            "_c_head": F.first(F.when(is_head, known), ignorenulls=True).over(whole),
            "_c_tail": F.last(F.when(~is_head, known), ignorenulls=True).over(whole),
        }
    )
    before = of_block.rangeBetween(Window.unboundedPreceding, -1)
    from_here = (
        Window.partitionBy("_series", "_block")
        .orderBy(F.col("_at").desc())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = {}
    for name, mine, frame in (("head", is_head, before), ("tail", ~is_head, from_here)):
        away = F.col("mean") - F.col(f"_c_{name}")
        n = F.col("n")
        for column, of in {
            "n": F.sum(F.when(mine, n)),
            "s1": F.sum(F.when(mine, n * away)),
            "s2": F.sum(F.when(mine, F.col("m2") + n * away * away)),
            "lo": F.min(F.when(mine, F.col("lo"))),
            "hi": F.max(F.when(mine, F.col("hi"))),
        }.items():
            sums[f"_{name}_{column}"] = of.over(frame)
    summed = centered.withColumns(sums).where(is_head)

    def part(name: str, column: str) -> Column:
        return F.coalesce(F.col(f"_{name}_{column}"), F.lit(0.0))

    # Both around one center: the head's, if there is a head.
    has_head, has_tail = part("head", "n") > 0, part("tail", "n") > 0
    center = F.when(has_head, F.col("_c_head")).otherwise(F.col("_c_tail"))
    shift = F.when(has_head & has_tail, F.col("_c_tail") - F.col("_c_head")).otherwise(0.0)
    n, s1 = part("tail", "n"), part("tail", "s1")
    history = summed.select(
        "_series",
        "_us",
        (part("head", "n") + n).alias("n"),
        center.alias("center"),
        (part("head", "s1") + s1 + n * shift).alias("s1"),
        (part("head", "s2") + part("tail", "s2") + shift * (2 * s1 + n * shift)).alias("s2"),
        F.least("_head_lo", "_tail_lo").alias("lo"),
        F.greatest("_head_hi", "_tail_hi").alias("hi"),
    )
    judged = _judged(
        points.join(history, ["_series", "_us"]), min_points, threshold
    )
    return _report(judged, with_status, F.col("timestamp"))


def _keys_of(df: DataFrame) -> list[str]:
    return ["series" if "series" in df.columns else "metric_name", "timestamp"]


def new_only(
    candidates: DataFrame, existing: DataFrame, keys: Sequence[str] | None = None
) -> DataFrame:
    """Candidates whose series has no record at their time yet."""
    keys = list(keys or _keys_of(candidates))
    recorded = existing.select(*keys).distinct()
    return candidates.join(recorded, keys, "left_anti").select(*candidates.columns)


def mark_recorded(report: DataFrame, existing: DataFrame) -> DataFrame:
    """A status report in which anomalies stored before are told apart."""
    keys = _keys_of(report)
    stored = existing.select(*keys).distinct().withColumn("_stored", F.lit(True))
    known = F.col("_stored") & (F.col("status") == ANOMALY)
    return (
        report.join(stored, keys, "left")
        .withColumn("status", F.when(known, RECORDED).otherwise(F.col("status")))
        .select(*report.columns)
    )


def write_anomalies(df: DataFrame, path: str) -> int:
    """Append the anomalies not stored yet and return how many there were.

    Running it again with the same rows adds nothing.
    """
    candidates = with_event_month(df.select(*S.ANOMALY_SCHEMA.fieldNames())).persist()
    try:
        span = candidates.agg(F.min(S.MONTH), F.max(S.MONTH)).first()
        if span[0] is None:
            return 0
        existing = read_anomalies(df.sparkSession, path).where(
            F.col(S.MONTH).between(*span)
        )
        fresh = new_only(candidates, existing).persist()
        try:
            added = fresh.count()
            if added:
                stored_layout(
                    fresh.select(*S.ANOMALY_SCHEMA.fieldNames(), S.MONTH),
                    [S.MONTH],
                    ["metric_name", "timestamp"],
                ).write.mode("append").partitionBy(S.MONTH).parquet(path)
            return added
        finally:
            fresh.unpersist()
    finally:
        candidates.unpersist()
