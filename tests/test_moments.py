"""Block moments: merging, long lookbacks, backfills that resume."""

from __future__ import annotations

import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import millrace as m
from millrace.operators import moments as M
from tests.conftest import at, points
from tests.test_outliers import by_hand

VALUES = [float((i * 7919) % 13 + (40 if i % 17 == 0 else 0)) for i in range(90)]
VALUES[20:24] = [None] * 4
VALUES[40:56] = [0.1] * 16


def by_minute(df):
    start = at("2024-01-01 00:00:00").timestamp()
    return {
        int((r["timestamp"].timestamp() - start) // 60): (
            r["history_count"], r["status"], r["z_score"],
        )
        for r in df.where("metric_value is not null").collect()
    }


def assert_same(got, want):
    """The means of blocks are rounded, so that a z of 0 is one of about 1e-16."""
    assert got.keys() == want.keys()
    for minute, (count, name, z) in want.items():
        assert got[minute][:2] == (count, name), minute
        assert (got[minute][2] is None) == (z is None)
        assert z is None or math.isclose(got[minute][2], z, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("blocks", [1, 2, 4, 12])
def test_blocks_change_nothing(spark, blocks):
    got = m.backfill_by_blocks(points(spark, VALUES), "12 minutes", blocks, with_status=True)
    assert_same(by_minute(got), by_hand(VALUES, 12))


@settings(
    max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True
)
@given(
    st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=30).filter(
        lambda v: any(x is not None for x in v)
    )
)
def test_blocks_equal_brute_force(spark, values):
    values = [v if v is None else float(v) for v in values]
    want = by_hand(values, 6)
    if not [z for _, _, z in want.values() if z and abs(z - 2) < 1e-9]:
        got = m.backfill_by_blocks(points(spark, values), "6 minutes", 3, with_status=True)
        assert_same(by_minute(got), want)


def test_a_level_shift_does_not_blur_what_follows(spark):
    values = [1e9 + i % 2 for i in range(10)] + [float(i % 3) for i in range(50)]
    got = by_minute(
        m.backfill_by_blocks(points(spark, values), "12 minutes", 4, with_status=True)
    )
    assert_same(
        {k: v for k, v in got.items() if k >= 22},
        {k: v for k, v in by_hand(values, 12).items() if k >= 22},
    )


def test_merged_moments_equal_those_of_all_values(spark):
    df = points(spark, VALUES)
    minute = F.minute("timestamp")
    halves = [m.block_moments(df.where(minute % 2 == i), "10 minutes") for i in (0, 1)]
    empty = df.where("timestamp < '2024-01-01 00:03:00'").withColumns(
        {"timestamp": F.expr("timestamp + interval 20 minutes"), "metric_value": F.expr("double(null)")}
    )
    fine = m.block_moments(df.unionByName(empty), "2 minutes")
    assert fine.where("n = 0").count() == 2
    for merged in (
        m.merge_moments(halves[0].unionByName(halves[1])),
        m.merge_moments(fine, "10 minutes"),
    ):
        rows = {r.block: r for r in merged.collect()}
        assert len(rows) == 9
        for i in range(9):
            held = [v for v in VALUES[10 * i : 10 * i + 10] if v is not None]
            row = rows[at(f"2024-01-01 {i // 6:02d}:{i % 6}0:00").replace(tzinfo=None)]
            assert (row.n, row.lo, row.hi) == (len(held), min(held), max(held))
            assert math.isclose(row["mean"], statistics.mean(held), rel_tol=1e-12)
            assert math.isclose(row.m2, statistics.pvariance(held) * len(held), abs_tol=1e-9)


def test_lookbacks_are_whole_blocks(spark):
    with pytest.raises(ValueError, match="can't be cut"):
        m.backfill_by_blocks(points(spark, [1]), "10 minutes", 7)
    with pytest.raises(ValueError, match="can't be cut"):
        m.backfill_by_blocks(points(spark, [1]), "10 minutes", 0)


def test_no_points(spark):
    none = points(spark, [1.0]).limit(0)
    assert m.backfill_by_blocks(none, "10 minutes", 5, with_status=True).collect() == []
    assert m.merge_moments(m.block_moments(none, "1 minute")).collect() == []


NAMES = ["steady", "silent", "gone", "late", "void"]


def of_names(spark, rows):
    """Points from (name, minute, value)."""
    from datetime import timedelta

    start = at("2024-01-01 00:00:00")
    schema = "timestamp timestamp, metric_name string, metric_value double, labels map<string,string>"
    return spark.createDataFrame(
        [(start + timedelta(minutes=t), n, v, {"type": "x"}) for n, t, v in rows], schema
    )


def latest(df):
    return {
        r["metric_name"]: (r["timestamp"], r["metric_value"], r["history_count"], r["status"],
                           None if r["z_score"] is None else round(r["z_score"], 9))
        for r in df.collect()
    }


ROWS_OF = [
    *[("steady", t, float((t * 7919) % 13)) for t in range(95)],
    # Newest in a stored block, and the value of it is far off.
    *[("silent", t, float(t % 5)) for t in range(61)], ("silent", 61, 90.0),
    # Ends within the first edge; begins after the blocks; has no value at its end.
    *[("gone", t, float(t % 3)) for t in range(34)],
    *[("late", t, float(t % 4)) for t in range(84, 95)],
    *[("void", t, float(t % 6)) for t in range(70)], ("void", 70, None), ("void", 71, None),
]


@pytest.mark.parametrize(
    "as_of, lookback, covered",
    [
        ("01:33:00", 63, (0, 90)),  # both edges within blocks
        ("01:30:00", 60, (0, 90)),  # whole blocks, no edge
        ("01:33:00", 63, (0, 70)),  # the last blocks not stored yet
        ("01:33:00", 63, (50, 90)),  # nor the first
        ("01:33:00", 63, (0, 30)),  # none of the lookback's
        ("01:33:00", 7, (0, 90)),  # shorter than a block
        ("01:01:30", 61, (0, 90)),  # earlier than what is stored
    ],
)
@pytest.mark.parametrize("names", [None, [*NAMES, "unknown"]])
def test_the_newest_points_from_moments(spark, as_of, lookback, covered, names):
    df = of_names(spark, ROWS_OF)
    us = lambda minute: M._micros("2024-01-01 00:00:00") + minute * 60_000_000
    moments = m.block_moments(df, "10 minutes")
    # What isn't covered must not be read from moments, nor what is from points.
    low, high = us(covered[0]), us(covered[1])
    moments = M._within(moments, (low, high), ts="block")
    options = {"metric_names": names, "with_status": True}
    at_ = f"2024-01-01 {as_of}"
    got = m.detect_by_moments(
        df, moments, at_, f"{lookback} minutes", "10 minutes", (low, high), **options
    )
    want = latest(m.detect_anomalies(df, at_, f"{lookback} minutes", **options))
    assert latest(got) == want
    assert names is None or len(want) == len(names)


def test_several_labels_at_the_newest_time(spark):
    """The others at its time are history, in an edge and in a block."""
    df = of_names(spark, [("steady", t, float(t % 7)) for t in range(40)])
    both = df.unionByName(
        df.withColumns({"labels": F.expr("map('type', 'y')"), "metric_value": F.expr("metric_value + 3")})
    )
    span = (M._micros("2024-01-01"), M._micros("2024-01-01 00:40:00"))
    for as_of in ("00:37:00", "00:45:00"):
        as_of = f"2024-01-01 {as_of}"
        moments = m.block_moments(both, "10 minutes")
        options = {"lookback": "38 minutes", "with_status": True}
        got = m.detect_by_moments(both, moments, as_of, block="10 minutes", covered=span, **options)
        assert latest(got) == latest(m.detect_anomalies(both, as_of, **options))


def test_only_the_ends_of_a_lookback_are_read(spark):
    """Points of covered blocks don't count, but those of a silent series' last block."""
    df = of_names(spark, ROWS_OF)
    span = (M._micros("2024-01-01"), M._micros("2024-01-01 01:30:00"))
    moments = m.block_moments(df, "10 minutes")
    ends = df.where(
        "timestamp < '2024-01-01 00:40:00' or timestamp >= '2024-01-01 01:30:00'"
        " or timestamp between '2024-01-01 01:00:00' and '2024-01-01 01:19:59'"
    )
    run = lambda points: latest(
        m.detect_by_moments(
            points, moments, "2024-01-01 01:33:00", "60 minutes", "10 minutes", span, with_status=True
        )
    )
    assert run(ends) == run(df)


def test_series_without_a_name_have_no_named_moments(spark):
    with pytest.raises(ValueError, match="told apart"):
        m.detect_by_moments(
            points(spark, [1.0]), m.block_moments(points(spark, [1.0]), "1 minute", ("labels",)),
            "2024-01-01 01:00:00", "1 hour", "1 minute", (0, 2**60),
            series_key=("labels",), metric_names=["a"],
        )


class Store:
    def __init__(self, spark, folder):
        self.spark = spark
        names = ("history", "state", "anomalies", "status")
        self.history, self.state, self.anomalies, self.status = (str(folder / n) for n in names)

    def write(self, values):
        m.write_history(
            m.stamp(points(self.spark, values), "2024-01-02 00:00:00"), self.history
        )

    def run(self, as_of, **options):
        return m.resumed_backfill_job(
            self.spark, self.history, self.state, self.anomalies, f"2024-01-01 {as_of}",
            "12 minutes", 4, status_path=self.status, **options,
        )

    def judged(self, run):
        return by_minute(self.spark.read.parquet(f"{self.status}/run={run:09d}"))

    def anomalous(self):
        rows = m.read_anomalies(self.spark, self.anomalies)
        start = at("2024-01-01 00:00:00").timestamp()
        return sorted(int((r["timestamp"].timestamp() - start) // 60) for r in rows.collect())


def flagged(judged):
    return sorted(k for k, (_, status, _) in judged.items() if status == "anomaly")


def test_runs_resume_after_the_last_closed_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "PARTS", 2)
    store = Store(spark, tmp_path)
    assert store.run("00:30:00") == 0  # no history yet
    store.write(VALUES)
    want = by_hand(VALUES, 12)
    found = {}
    bounds = [0, 27, 27, 45, 48, 63, 90]
    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
        # Two minutes into an open block, which waits.
        added = store.run(f"{(high + 2) // 60:02d}:{(high + 2) % 60:02d}:00")
        if low == high:
            assert added == 0
            continue
        done = len([b for b in bounds[1 : number + 2] if b != 27]) + 1
        got = store.judged(done)
        assert got.keys() == {k for k in want if low <= k < high}
        found |= got
        assert store.anomalous() == flagged(found)
    assert_same(found, want)
    # Parts beyond the lookback are gone, the others few.
    parts = M._last_commit(M.Folder(spark, store.state))["parts"]
    assert len({p["name"] for p in parts}) <= 3
    assert {p["name"] for p in parts} == set(M.Folder(spark, store.state).folders()) - {"_commits"}


def test_a_run_cut_short_counts_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, tmp_path)
    store.write(VALUES)
    store.run("00:30:00")
    for cut in ("write_anomalies", "judge_by_moments"):
        def fail(*_, **__):
            raise OSError("cut")

        with monkeypatch.context() as patch:
            patch.setattr(M, cut, fail)
            with pytest.raises(OSError, match="cut"):
                store.run("01:30:00")
    with monkeypatch.context() as patch:
        patch.setattr(M.Folder, "commit_text", fail)
        with pytest.raises(OSError, match="cut"):
            store.run("01:30:00")
    assert store.run("01:30:00") == 0  # stored before the cut, and once
    want = by_hand(VALUES, 12)
    assert_same(store.judged(1) | store.judged(2), want)
    assert store.anomalous() == flagged(want)


def test_changed_points_count_again(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.write(VALUES)
    store.run("01:30:00")
    changed = VALUES.copy()
    changed[37:39] = [25.0, -3.0]
    store.write(changed)
    store.run("01:30:00", again_from="2024-01-01 00:37:30")
    want = by_hand(changed, 12)
    assert_same(store.judged(2), {k: v for k, v in want.items() if k >= 36})
    # From a time before all that is stored.
    store.run("01:30:00", again_from="2023-12-31 00:00:00")
    assert_same(store.judged(3), want)


def test_detection_goes_on_from_a_backfill(spark, tmp_path):
    """Before the first run, after it, and after parts were judged again."""
    store = Store(spark, tmp_path)
    store.write(VALUES)

    def detect(moments_path, run):
        status = f"{store.status}-{run}-{moments_path is None}"
        m.detection_job(
            spark, store.history, f"{store.anomalies}-{run}-{moments_path is None}",
            "2024-01-01 01:25:30", "70 minutes", metric_names=None, status_path=status,
            moments_path=moments_path,
        )
        return latest(spark.read.parquet(status))

    for run, options in enumerate([None, {}, {"again_from": "2024-01-01 00:37:30"}]):
        if options is not None:
            store.run("01:05:00", **options)
        assert detect(store.state, run) == detect(None, run)
    with pytest.raises(ValueError, match="other series"):
        m.detection_job(
            spark, store.history, store.anomalies, "2024-01-01 01:25:30", "70 minutes",
            metric_names=None, moments_path=store.state, series_key=("labels",),
        )


def test_a_state_of_other_blocks_is_refused(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.write(VALUES)
    store.run("01:30:00")
    with pytest.raises(ValueError, match="another folder"):
        store.run("01:40:00", series_key=("metric_name", "labels"))


def test_a_resumed_run_reads_its_days_and_those_a_lookback_before(spark, tmp_path):
    """Neither the days between nor older ones are opened."""
    path = str(tmp_path / "history")
    days = m.stamp(
        spark.range(60 * 24).selectExpr(
            "timestamp'2024-01-01' + make_dt_interval(0, id) `timestamp`", "'a' metric_name",
            "double(id % 11) metric_value", "map('type', 'x') labels",
        ),
        "2024-04-01 00:00:00",
    )
    m.write_history(days, path)
    history = m.read_history(spark, path)
    us = lambda text: M._micros(text)
    span = (us("2024-02-28 00:00:00"), us("2024-02-29 00:00:00"))
    read = M._within(history, span, (us("2024-01-29 00:00:00"), us("2024-01-30 00:00:00")))
    got = {r[0] for r in read.selectExpr("date_format(timestamp, 'MMdd')").distinct().collect()}
    assert got == {"0228", "0129"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "event_month" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "timestamp" in plan.partition("PushedFilters: [")[2].partition("]")[0]
