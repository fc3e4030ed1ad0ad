import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace import schemas as S
from tests.conftest import at, points, raw, rows_of


def stored(spark, *rows):
    """(minute, value, computed minute[, labels]) rows of one metric."""
    full = [
        (
            at(f"2024-01-01 00:{minute:02}:00"),
            "m",
            float(value),
            labels[0] if labels else {"type": "x"},
            at(f"2024-01-01 01:{computed:02}:00"),
        )
        for minute, value, computed, *labels in rows
    ]
    return spark.createDataFrame(full, S.HISTORY_SCHEMA)


def values(df):
    return rows_of(df, F.minute("timestamp"), "metric_value")


def test_the_latest_computed_value_wins(spark):
    old = stored(spark, (0, 1, 0), (0, 3, 2), (0, 2, 1), (1, 9, 0))
    new = stored(spark, (1, 8, 3), (2, 5, 3))
    assert values(m.upsert_history(old, new)) == [(0, 3.0), (1, 8.0), (2, 5.0)]


def test_an_older_run_does_not_overwrite(spark):
    old, new = stored(spark, (0, 1, 5)), stored(spark, (0, 2, 4))
    assert values(m.upsert_history(old, new)) == [(0, 1.0)]


def test_the_new_row_wins_a_tie(spark):
    old, new = stored(spark, (0, 5, 5)), stored(spark, (0, 2, 5))
    assert values(m.upsert_history(old, new)) == [(0, 2.0)]


def test_label_order_is_no_identity(spark):
    one, other = {"a": "1", "b": "2"}, {"b": "2", "a": "1"}
    merged = m.upsert_history(
        stored(spark, (0, 1, 0, one)), stored(spark, (0, 2, 1, other))
    )
    assert values(merged) == [(0, 2.0)]
    apart = m.upsert_history(
        stored(spark, (0, 1, 0, one)), stored(spark, (0, 2, 1, {"a": "1"}))
    )
    assert apart.count() == 2


def test_stored_upsert_is_idempotent_and_touches_its_months_only(spark, tmp_path):
    path = str(tmp_path / "history")
    assert m.read_history(spark, path).count() == 0
    january = m.stamp(points(spark, [1, 2]), "2024-03-01 00:00:00")
    february = m.stamp(
        points(spark, [3], start="2024-02-01 00:00:00"), "2024-03-01 00:00:00"
    )
    m.write_history(january, path)
    files = {p.name for p in (tmp_path / "history/event_month=202401").iterdir()}
    for _ in range(2):
        m.write_history(february, path)
    assert {p.name for p in (tmp_path / "history/event_month=202401").iterdir()} == files
    assert rows_of(m.read_history(spark, path), "metric_value") == [(1.0,), (2.0,), (3.0,)]
    better = m.stamp(points(spark, [7]), "2024-03-01 00:01:00")
    m.write_history(better, path)
    assert rows_of(m.read_history(spark, path), "metric_value") == [(2.0,), (3.0,), (7.0,)]


def test_overwrite_is_dynamic_whatever_the_session_says(spark, tmp_path):
    path = str(tmp_path / "history")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    for start in ("2024-01-01 00:00:00", "2024-02-01 00:00:00"):
        m.write_history(
            m.stamp(points(spark, [1], start=start), "2024-03-01 00:00:00"), path
        )
    assert m.read_history(spark, path).count() == 2


def test_nothing_to_write(spark, tmp_path):
    path = str(tmp_path / "history")
    m.write_history(m.stamp(points(spark, []), "2024-03-01 00:00:00"), path)
    assert m.read_history(spark, path).count() == 0


def test_append_mode_deduplicates_on_read(spark, tmp_path):
    path = str(tmp_path / "history")
    for value, run in ((1, "00:01:00"), (2, "00:02:00")):
        m.write_history(
            m.stamp(points(spark, [value]), f"2024-03-01 {run}"), path, mode="append"
        )
    assert m.read_history(spark, path).count() == 2
    assert rows_of(m.read_history(spark, path, deduplicate=True), "metric_value") == [(2.0,)]


def test_unknown_mode(spark, tmp_path):
    with pytest.raises(ValueError, match="mode"):
        m.write_history(m.stamp(points(spark, [1]), "2024-01-01"), str(tmp_path), "merge")


def test_values_are_stored_as_doubles(spark):
    whole = points(spark, [1]).withColumn("metric_value", F.lit(3))
    assert m.stamp(whole, "2024-01-01").schema["metric_value"].dataType.typeName() == "double"


def test_raw_table_prunes_months(spark, tmp_path):
    path = str(tmp_path / "raw")
    events = raw(
        spark,
        [{"timestamp": at(f"2024-0{month}-15 00:00:00"), "_offset": month} for month in (1, 2, 3)],
    )
    m.write_raw_events(events, path)
    m.write_raw_events(events, path)
    table = m.read_raw_events(spark, path)
    assert table.count() == 6
    recent = m.enrich(m.since(table, "2024-03-16 00:00:00", "2 days"))
    assert recent.count() == 2
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "event_month" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in plan


def test_one_hot_hour_is_written_by_many_tasks(spark, tmp_path):
    one = raw(spark, [{}])
    columns = {
        f.name: F.lit(v).cast(f.dataType)
        for f, v in zip(S.RAW_EVENT_SCHEMA, one.first(), strict=True)
    }
    columns["session_id"] = F.sha2(F.col("id").cast("string"), 256)
    hot = spark.range(0, 80_000, 1, 8).select(
        *[column.alias(name) for name, column in columns.items()]
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256KB")
    try:
        m.write_raw_events(hot, str(tmp_path / "raw"))
    finally:
        spark.conf.unset(size)
    table = m.read_raw_events(spark, str(tmp_path / "raw"))
    per_file = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 80_000
    assert len(per_file) > 4 and max(per_file) < 40_000


def test_filters_pass_below_the_deduplication(spark, tmp_path):
    path = str(tmp_path / "history")
    for start in ("2024-01-01 00:00:00", "2024-02-01 00:00:00"):
        rows = m.stamp(points(spark, [1, 2], start=start), "2024-03-01 00:00:00")
        m.write_history(rows, path, mode="append")
    recent = m.since(
        m.read_history(spark, path, deduplicate=True), "2024-02-01 00:10:00", "1 hour"
    ).where("metric_name = 'm'")
    assert recent.count() == 2
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "event_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(timestamp" in pushed
    assert "EqualTo(metric_name,m)" in pushed


def test_a_run_rewrites_the_days_it_touches(spark, tmp_path):
    path = tmp_path / "history"
    days = [f"2024-01-{d:02}" for d in range(1, 29)]
    whole = [m.stamp(points(spark, [1, 2, 3], start=f"{d} 10:00:00"), "2024-02-01") for d in days]
    m.write_history(m.union_events(*whole), str(path))

    def files():
        return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}

    before = files()
    late = points(spark, [7, 8], start="2024-01-15 10:01:00")
    m.write_history(m.stamp(late, "2024-02-02"), str(path))
    changed = {p for p in before.keys() | files().keys() if before.get(p) != files().get(p)}
    assert changed and all("event_day=20240115" in p for p in changed)
    got = m.read_history(spark, str(path)).where("day(timestamp) = 15")
    assert rows_of(got, "metric_value") == [(1.0,), (7.0,), (8.0,)]


def test_a_history_by_month_only_is_refused(spark, tmp_path):
    rows = m.with_event_month(m.stamp(points(spark, [1, 2]), "2024-02-01"))
    rows.write.partitionBy("event_month").parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="by month only"):
        m.read_history(spark, str(tmp_path / "old"))
