"""Detection from stored block moments: long lookbacks, and backfills that resume.

What a block of time holds of a series is one row: the number of its values, their
mean, the sum of squared distances from it, and their range.  Such rows merge, so the
history of a point is the end of one block, whole blocks, and the beginning of its own.
Only points of the first and the last are read, for backfills and for the newest points.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas as S
from millrace.functions import bucket_start, instant, labels_key, month_of, seconds_in
from millrace.operators.history import read_history
from millrace.operators.outliers import (
    ANOMALY,
    _counted_newest,
    _IDENTITY,
    _judged,
    _listed,
    _newest_rows,
    _POINT,
    _report,
    _with_series,
    detect_anomalies,
    write_anomalies,
)
from millrace.sources.files import Folder

_MOMENTS = ("n", "mean", "m2", "lo", "hi")
MOMENTS_SCHEMA = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("block", T.TimestampType()),
        *[T.StructField(name, T.DoubleType()) for name in _MOMENTS],
    ]
)
_COMMITS = "_commits"


def _moments_of(value: Column) -> list[Column]:
    return [
        F.count(value).cast("double").alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.min(value).cast("double").alias("lo"),
        F.max(value).cast("double").alias("hi"),
    ]


def block_moments(
    metrics: DataFrame,
    block: str | timedelta,
    series_key: Sequence[str] = ("metric_name",),
) -> DataFrame:
    """One row per series and block: series, block (its start), n, mean, m2, lo, hi.

    ``metrics`` is unique on (metric name, time, labels).  Points without a value are
    not counted; a block that has no others has a row with n = 0.
    """
    points = _with_series(metrics, series_key)
    return points.groupBy(
        F.col("_series").alias("series"), bucket_start("timestamp", block).alias("block")
    ).agg(*_moments_of(F.col("metric_value")))


def _joined(a: Column, b: Column) -> Column:
    """The moments of two sets of values from those of each."""
    n = a["n"] + b["n"]
    away = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"),
        (a["mean"] + away * F.try_divide(b["n"], n)).alias("mean"),
        (a["m2"] + b["m2"] + away * away * F.try_divide(a["n"] * b["n"], n)).alias("m2"),
        F.least(a["lo"], b["lo"]).alias("lo"),
        F.greatest(a["hi"], b["hi"]).alias("hi"),
    )
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def _all_of(moments: Column) -> Column:
    """One struct of moments from an array of them."""
    none = F.struct(
        F.lit(0.0).alias("n"),
        *[F.lit(None).cast("double").alias(name) for name in _MOMENTS[1:]],
    )
    return F.aggregate(moments, none, _joined)


def _in_order() -> Column:
    """The moments of a group by block, so that sums don't depend on how rows arrive."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct("block", *_MOMENTS))),
        lambda x: F.struct(*[x[name].alias(name) for name in _MOMENTS]),
    )


def merge_moments(moments: DataFrame, block: str | timedelta | None = None) -> DataFrame:
    """One row per series and block, of ``block``'s length if that is given.

    Rows of the same block, as two loads may leave them, become one; finer blocks
    become coarser ones.
    """
    at = F.col("block") if block is None else bucket_start("block", block)
    gathered = moments.groupBy("series", at.alias("block")).agg(_in_order().alias("_rows"))
    one = gathered.select("series", "block", _all_of(F.col("_rows")).alias("_one"))
    return one.select("series", "block", *[F.col(f"_one.{name}") for name in _MOMENTS])


def _block_seconds(lookback: str | timedelta, blocks: int) -> int:
    length, rest = divmod(seconds_in(lookback), blocks) if blocks > 0 else (0, 0)
    if rest or not length:
        raise ValueError(f"{lookback} can't be cut into {blocks} blocks of whole seconds")
    return int(length)


def _moment_of(us: int) -> Column:
    return F.timestamp_micros(F.lit(us))


def _within(df: DataFrame, *spans: tuple[int, int], ts: str = "timestamp") -> DataFrame:
    """Rows in one of the spans (microseconds, the end left out), months pruned too."""
    any_of: Column | None = None
    for low, high in spans:
        start, end = _moment_of(low), _moment_of(high)
        inside = (F.col(ts) >= start) & (F.col(ts) < end)
        if S.MONTH in df.columns:
            inside &= F.col(S.MONTH).between(month_of(start), month_of(end))
        any_of = inside if any_of is None else any_of | inside
    return df.where(any_of)


def judge_by_moments(
    metrics: DataFrame,
    moments: DataFrame,
    lookback: str | timedelta,
    blocks: int,
    span: tuple[int, int] | None = None,
    min_points: int = 5,
    threshold: float = 2.0,
    series_key: Sequence[str] = ("metric_name",),
    with_status: bool = False,
) -> DataFrame:
    """Judge points against the ``lookback`` before each, whole blocks from ``moments``.

    The lookback is ``blocks`` blocks long.  ``span`` (microseconds, whole blocks)
    limits what is judged; of ``metrics`` then only the span is read, and the equally
    long one a lookback earlier, whose points leave the lookback meanwhile.  ``moments``
    has one row per series and block, for the blocks judged and those of a lookback
    before.  What a task sorts is two blocks of a series, however long the lookback.
    """
    block_us = _block_seconds(lookback, blocks) * 1_000_000
    back_us = block_us * blocks
    if span is not None:
        earlier = (span[0] - back_us, span[1] - back_us)
        metrics = _within(metrics, span, earlier)
    points = _with_series(metrics, series_key).select(
        "_series", *_POINT, F.unix_micros("timestamp").alias("_us")
    )
    instants = points.groupBy("_series", "_us").agg(*_moments_of(F.col("metric_value")))
    us = F.col("_us")
    block = us - F.pmod(us, F.lit(block_us))

    def role(shift: int, head: bool) -> Column:
        return F.struct(
            (block + shift).alias("_block"), (us + shift).alias("_at"), F.lit(head).alias("_head")
        )

    placed = instants.select("*", F.inline(F.array(role(0, True), role(back_us, False))))
    if span is not None:
        placed = placed.where((F.col("_at") >= span[0]) & (F.col("_at") < span[1]))
    edges = _edges(placed)
    if blocks > 1:
        middle = _whole_blocks(moments, block_us, blocks, span)
        edges = edges.join(middle, ["_series", "_block"], "left")
    history = _around_one_center(edges, ("head", "middle", "tail") if blocks > 1 else ("head", "tail"))
    if span is not None:
        points = points.where((us >= span[0]) & (us < span[1]))
    judged = _judged(points.join(history, ["_series", "_us"]), min_points, threshold)
    return _report(judged, with_status, F.col("timestamp"))


def _edges(placed: DataFrame) -> DataFrame:
    """Sums of the block's head before each instant, and of the tail from it on.

    Each around a value of its own, the head's first and the tail's last.
    """
    of_block = Window.partitionBy("_series", "_block").orderBy("_at")
    whole = of_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_head = F.col("_head")
    known = F.when(F.col("n") > 0, F.col("mean"))
    centered = placed.withColumns(
        {
            "_head_c": F.first(F.when(is_head, known), ignorenulls=True).over(whole),
            "_tail_c": F.last(F.when(~is_head, known), ignorenulls=True).over(whole),
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
        away = F.col("mean") - F.col(f"_{name}_c")
        n = F.col("n")
        for column, of in {
            "n": F.sum(F.when(mine, n)),
            "s1": F.sum(F.when(mine, n * away)),
            "s2": F.sum(F.when(mine, F.col("m2") + n * away * away)),
            "lo": F.min(F.when(mine, F.col("lo"))),
            "hi": F.max(F.when(mine, F.col("hi"))),
        }.items():
            sums[f"_{name}_{column}"] = of.over(frame)
    return centered.withColumns(sums).where(is_head)


def _whole_blocks(
    moments: DataFrame, block_us: int, blocks: int, span: tuple[int, int] | None
) -> DataFrame:
    """For each series and block judged, what the blocks between its edges hold."""
    if span is not None:
        moments = _within(moments, (span[0] - block_us * blocks, span[1]), ts="block")
    at = F.unix_micros("block")
    window = (
        Window.partitionBy("series")
        .orderBy("_block")
        .rangeBetween(-(blocks - 1) * block_us, -block_us)
    )
    one = _all_of(F.collect_list(F.struct(*_MOMENTS)).over(window))
    merged = moments.withColumn("_block", at).select("series", "_block", one.alias("_one"))
    if span is not None:
        merged = merged.where(F.col("_block") >= span[0])
    return merged.select(
        F.col("series").alias("_series"),
        "_block",
        F.col("_one.n").alias("_middle_n"),
        F.col("_one.mean").alias("_middle_c"),
        F.lit(0.0).alias("_middle_s1"),
        F.col("_one.m2").alias("_middle_s2"),
        F.col("_one.lo").alias("_middle_lo"),
        F.col("_one.hi").alias("_middle_hi"),
    )


def _around_one_center(edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """The sums of all parts of a history, around the center of the first that has one."""

    def part(name: str, column: str) -> Column:
        return F.coalesce(F.col(f"_{name}_{column}"), F.lit(0.0))

    center = F.coalesce(*[F.when(part(x, "n") > 0, F.col(f"_{x}_c")) for x in names])
    n: Column = F.lit(0.0)
    s1: Column = F.lit(0.0)
    s2: Column = F.lit(0.0)
    for name in names:
        shift = F.when(part(name, "n") > 0, F.col(f"_{name}_c") - center).otherwise(0.0)
        mine, first = part(name, "n"), part(name, "s1")
        n, s1 = n + mine, s1 + first + mine * shift
        s2 = s2 + part(name, "s2") + shift * (2 * first + mine * shift)
    return edges.select(
        "_series",
        "_us",
        n.alias("n"),
        center.alias("center"),
        s1.alias("s1"),
        s2.alias("s2"),
        F.least(*[F.col(f"_{x}_lo") for x in names]).alias("lo"),
        F.greatest(*[F.col(f"_{x}_hi") for x in names]).alias("hi"),
    )


def backfill_by_blocks(
    metrics: DataFrame,
    lookback: str | timedelta,
    blocks: int,
    min_points: int = 5,
    threshold: float = 2.0,
    series_key: Sequence[str] = ("metric_name",),
    with_status: bool = False,
) -> DataFrame:
    """``backfill_anomalies`` for long lookbacks: a task sorts blocks, not lookbacks."""
    length = timedelta(seconds=_block_seconds(lookback, blocks))
    return judge_by_moments(
        metrics,
        block_moments(metrics, length, series_key),
        lookback,
        blocks,
        min_points=min_points,
        threshold=threshold,
        series_key=series_key,
        with_status=with_status,
    )


# --- The newest points -----------------------------------------------------------
def detect_by_moments(
    metrics: DataFrame,
    moments: DataFrame,
    as_of: str | datetime,
    lookback: str | timedelta,
    block: str | timedelta,
    covered: tuple[int, int],
    min_points: int = 5,
    threshold: float = 2.0,
    series_key: Sequence[str] = ("metric_name",),
    metric_names: Sequence[str] | None = None,
    with_status: bool = False,
) -> DataFrame:
    """``detect_anomalies`` for long lookbacks: whole blocks come from ``moments``.

    ``moments`` has one row per series and block for all blocks in ``covered``
    (microseconds, the end left out).  Of ``metrics`` only what the lookback has
    outside of them is read, at its two ends.  A series that is silent since has its
    newest point in a block: of that block, for that series, the points are read
    instead, since what is judged isn't part of its own history.

    Neither ``as_of`` nor the lookback need be whole blocks.  Points changed in covered
    blocks count as they were when their moments were taken.  When this is called it
    asks for the newest blocks of silent series, no more than the lookback has.
    """
    block_us = seconds_in(block) * 1_000_000
    high = _micros(as_of)
    low = high - seconds_in(lookback) * 1_000_000
    first = -(-max(low, covered[0]) // block_us) * block_us
    last = min(high, covered[1]) // block_us * block_us
    if metric_names is not None and "metric_name" not in series_key:
        raise ValueError("metrics of one series can't be told apart in its moments")
    if first >= last:
        return detect_anomalies(
            metrics, as_of, lookback, min_points, threshold, series_key, metric_names, with_status
        )
    middle = _within(moments, (first, last), ts="block")
    if metric_names is not None:
        metrics = metrics.where(F.col("metric_name").isin(*metric_names))
        name = F.get_json_object("series", "$.metric_name")
        middle = middle.where(name.isin(*metric_names))

    def points_of(*spans: tuple[int, int]) -> DataFrame:
        return _with_series(_within(metrics, *spans), series_key).select(
            "_series", *_POINT, labels_key("labels").alias("_label")
        )

    points = points_of((low, first), (last, high))
    active = points_of((last, high)).select(F.col("_series").alias("series"))
    silent = (
        middle.groupBy("series").agg(F.max("block").alias("block"))
        .join(active, "series", "left_anti")
    )
    ends = silent.agg(F.collect_set(F.unix_micros("block"))).first()[0]  # no more than blocks
    if ends:
        own = silent.select(F.col("series").alias("_series"), F.col("block").alias("_block"))
        held = points_of(*[(b, b + block_us) for b in sorted(ends)])
        held = held.withColumn("_block", bucket_start("timestamp", block))
        held = held.join(own, ["_series", "_block"], "left_semi").drop("_block")
        points = points.unionByName(held)
        middle = middle.join(silent, ["series", "block"], "left_anti")

    newest = _counted_newest(_newest_rows(points))
    is_now = F.struct(*_IDENTITY).eqNullSafe(F.struct(*[f"now.{c}" for c in _IDENTITY]))
    edges = (
        points.join(newest, "_series")
        .groupBy("_series")
        .agg(F.first("now").alias("now"), *_moments_of(F.when(~is_now, F.col("metric_value"))))
    )
    whole = middle.groupBy(F.col("series").alias("_series")).agg(
        _all_of(_in_order()).alias("_whole")
    )
    both = F.array_compact(F.array(F.struct(*_MOMENTS), F.col("_whole")))
    merged = edges.join(whole, "_series", "left").withColumn("_one", _all_of(both))
    history = merged.select(
        "_series",
        *[F.col(f"now.{c}").alias(c) for c in _POINT],
        F.col("_one.n").alias("n"),
        F.col("_one.mean").alias("center"),
        F.lit(0.0).alias("s1"),
        F.col("_one.m2").alias("s2"),
        F.col("_one.lo").alias("lo"),
        F.col("_one.hi").alias("hi"),
    )
    report = _report(_judged(history, min_points, threshold), with_status, instant(as_of))
    if with_status and metric_names is not None:
        report = _listed(report, metric_names)
    return report


def detect_from_state(
    spark: SparkSession,
    metrics: DataFrame,
    state_path: str,
    as_of: str | datetime,
    lookback: str | timedelta,
    series_key: Sequence[str] = ("metric_name",),
    **options,
) -> DataFrame:
    """``detect_by_moments`` with what ``resumed_backfill_job`` has stored so far."""
    last = _last_commit(Folder(spark, state_path))
    if last is None:
        return detect_anomalies(metrics, as_of, lookback, series_key=series_key, **options)
    if last["series_key"] != list(series_key):
        raise ValueError(f"{state_path} holds other series")
    covered = (min(p["low"] for p in last["parts"]), last["until"])
    block = timedelta(microseconds=last["block_us"])
    moments = _read_parts(spark, state_path, last["parts"])
    return detect_by_moments(
        metrics, moments, as_of, lookback, block, covered, series_key=series_key, **options
    )


# --- A backfill that resumes -----------------------------------------------------
def _micros(moment: str | datetime) -> int:
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    since_epoch = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return since_epoch // timedelta(microseconds=1)


def _last_commit(folder: Folder) -> dict | None:
    numbers = [n for n in folder.names(_COMMITS) if n.isdigit()]
    return json.loads(folder.read_text(f"{_COMMITS}/{max(numbers)}")) if numbers else None


def read_moments(spark: SparkSession, state_path: str) -> DataFrame:
    """The block moments that the runs of ``resumed_backfill_job`` have stored."""
    last = _last_commit(Folder(spark, state_path))
    return _read_parts(spark, state_path, last["parts"] if last else [])


def _read_parts(spark: SparkSession, state_path: str, parts: list[dict]) -> DataFrame:
    """Each part's blocks from its ``low`` to before its ``high``."""
    rows = spark.createDataFrame([], MOMENTS_SCHEMA)
    for part in parts:
        stored = spark.read.schema(MOMENTS_SCHEMA).parquet(f"{state_path}/{part['name']}")
        rows = rows.unionByName(_within(stored, (part["low"], part["high"]), ts="block"))
    return rows


# Parts that a run leaves as they are; more are written as one.
PARTS = 32


def resumed_backfill_job(
    spark: SparkSession,
    history_path: str,
    state_path: str,
    anomalies_path: str,
    as_of: str | datetime,
    lookback: str = "1 day",
    blocks: int = 24,
    min_points: int = 5,
    threshold: float = 2.0,
    series_key: Sequence[str] = ("metric_name",),
    again_from: str | datetime | None = None,
    deduplicate: bool = False,
    status_path: str | None = None,
) -> int:
    """Judge the points of all blocks closed since the last run; the number of new anomalies.

    A run reads the points of the new blocks, those a lookback earlier, and the moments
    between.  It ends with one file that names the stored moments, so that a run cut
    short counts nothing and its repetition stores no anomaly twice.  Points that were
    changed in blocks judged before count after a run ``again_from`` their time on;
    an anomaly recorded before stays.  With ``status_path`` every judged point's status
    is stored, a folder per run.  One job at a time.
    """
    folder = Folder(spark, state_path)
    block_us = _block_seconds(lookback, blocks) * 1_000_000
    made = {"block_us": block_us, "series_key": list(series_key)}
    last = _last_commit(folder) or {"number": 0, "until": None, "parts": [], **made}
    if {k: last[k] for k in made} != made:
        raise ValueError(f"{state_path} holds other blocks or series: use another folder")
    history = read_history(spark, history_path, deduplicate)
    whole = lambda us: us - us % block_us
    high = whole(_micros(as_of))
    low = last["until"]
    if low is None:
        first = history.agg(F.unix_micros(F.min("timestamp"))).first()[0]
        if first is None:
            return 0
        low = whole(first)
    if again_from is not None:
        low = min(low, whole(_micros(again_from)))
    if low >= high:
        return 0
    number = last["number"] + 1
    name = f"run-{number:09d}"
    oldest = low - block_us * blocks
    parts = [
        p | {"high": min(p["high"], low)}
        for p in last["parts"]
        if p["low"] < low and p["high"] > oldest
    ]
    # Blocks of the lookback that no part holds come from the history, as the new do.
    since = min([p["low"] for p in parts], default=low)
    spans = [(low, high)]
    if since > oldest:
        spans.append((oldest, since))
    fresh = block_moments(
        _within(history, *spans), timedelta(microseconds=block_us), series_key
    )
    kept = [] if len(parts) >= PARTS else parts
    if not kept:
        fresh = fresh.unionByName(_read_parts(spark, state_path, parts))
    fresh.select(*MOMENTS_SCHEMA.fieldNames()).write.mode("overwrite").parquet(
        f"{state_path}/{name}"
    )
    now = _new_parts(name, kept, spans, parts)
    report = judge_by_moments(
        history,
        _read_parts(spark, state_path, now),
        lookback,
        blocks,
        (low, high),
        min_points,
        threshold,
        series_key,
        with_status=True,
    ).persist()
    try:
        if status_path is not None:
            report.write.mode("overwrite").parquet(f"{status_path}/run={number:09d}")
        flagged = report.where(F.col("status") == ANOMALY)
        added = write_anomalies(
            flagged.withColumn("detected_at", F.col("timestamp")), anomalies_path
        )
    finally:
        report.unpersist()
    commit = {"number": number, "until": high, "parts": now, **made}
    folder.commit_text(f"{_COMMITS}/{number:09d}", json.dumps(commit))
    for old in {p["name"] for p in last["parts"]} - {p["name"] for p in now}:
        folder.delete(old)
    return added


def _new_parts(
    name: str, kept: list[dict], spans: list[tuple[int, int]], before: list[dict]
) -> list[dict]:
    """The kept parts and the spans of the run's own; one span where it took in all."""
    if kept:
        return [*kept, *[{"name": name, "low": a, "high": b} for a, b in spans]]
    low = min([a for a, _ in spans] + [p["low"] for p in before])
    return [{"name": name, "low": low, "high": max(b for _, b in spans)}]
