"""The plans are the ones meant: scans, shuffles and pushed filters."""

import re

import pytest

import millrace as m
from checks import adapter as A
from checks.queries import QUERIES
from millrace import schemas as S
from tests.conftest import SF, SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return len(re.findall(r"Exchange (?:hash|range|Single)", text))


def test_kpis_take_one_scan_and_two_shuffles(spark):
    text = plan(m.kpi_metrics(m.enrich(A.raw_events(spark, SF)), "minute"))
    assert text.count("FileScan") == 1
    assert shuffles(text) == 2
    assert "Expand" not in text and "SortAggregate" not in text
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {
        "ts", "user_id", "event_type", "value",
    }


def test_time_and_user_filters_reach_the_scan(spark):
    text = plan(QUERIES["kpi_closed_hours"](spark, SF))
    pushed = text.split("PushedFilters: [")[1]
    assert "GreaterThan(user_id,0)" in pushed
    assert "GreaterThanOrEqual(ts,2024-01-02T10:00" in pushed
    assert "LessThan(ts,2024-01-20T12:00" in pushed


@pytest.mark.parametrize(
    "name", ["session_funnel", "conversion_rate_total", "cart_abandonment_sessions"]
)
def test_session_totals_shuffle_sessions_once(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan") == 1 and shuffles(text) == 2
    assert "Join" not in text and "Expand" not in text


def test_counts_shuffle_once(spark):
    for name in ("topic_counts", "event_source_counts", "gmv_total"):
        assert shuffles(plan(QUERIES[name](spark, SF))) == 1


def test_enrichment_does_not_shuffle(spark):
    assert shuffles(plan(QUERIES["enriched_events"](spark, SF))) == 0


def test_top_k_does_not_sort_everything(spark):
    text = plan(QUERIES["latest_points"](spark, SF))
    assert "TakeOrderedAndProject" in text


def test_service_filters_reach_the_scan_of_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "raw")
    m.write_raw_events(A.raw_events(spark, SF_SMALL), path)
    events = m.enrich(m.read_raw_events(spark, path))
    assert "In(event_type" in plan(m.kpi_metrics(events))
    orders = plan(m.gmv_total(events)).split("PushedFilters: [")[1]
    assert "order_event" in orders.split("ReadSchema")[0]
    scan = plan(m.kpi_metrics(events)).split("ReadSchema: struct<")[1]
    assert "props" not in scan and "order_id" not in scan


def test_messages_are_decoded_once(spark, tmp_path):
    path = str(tmp_path / "wire")
    A.messages(spark, SF_SMALL).write.parquet(path)
    wire = m.read_events(spark, fmt="parquet", streaming=False, path=path)
    wide, rejected = m.conform_records(wire)
    for df in (wide, rejected):
        assert plan(df).count("from_json") == len(S.WIRE_SCHEMAS)
        assert plan(df).count("FileScan") == 1 and shuffles(plan(df)) == 0


def test_backfill_sorts_one_row_per_time_in_blocks(spark):
    text = plan(QUERIES["zscore_backfill"](spark, SF))
    # All windows share one shuffle, by the series' blocks.
    below = text.rsplit("Window", 1)[1]
    assert "_block" in below.split("Exchange hashpartitioning")[1].split(")")[0]
    windows = text.split("Window", 1)[1].rsplit("Window", 1)[0]
    assert "Exchange" not in windows
    assert "collect_list" not in text


def test_live_detection_shuffles_sums_only(spark, tmp_path):
    path = str(tmp_path / "history")
    m.write_history(m.stamp(m.kpi_metrics(m.enrich(A.raw_events(spark, SF)), "hour"), "2024-02-01"), path)
    text = plan(m.detect_anomalies(m.read_history(spark, path), "2024-01-29 03:00:00", "24 hours"))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    for part in text.split("Exchange hashpartitioning")[1:]:
        below = part.split("\n")[1]
        assert "partial_" in below, below


def test_stored_messages_are_read_and_decoded_once(spark, tmp_path):
    """Good and rejected messages leave in one pass of the source."""
    wire = str(tmp_path / "wire")
    A.messages(spark, SF_SMALL).write.parquet(wire)
    records = m.read_events(spark, fmt="parquet", streaming=False, path=wire)
    decoded = m.decoded_records(records).persist()
    try:
        wide, rejected = m.split_records(decoded)
        for df in (wide, rejected):
            text = plan(df)
            assert "InMemoryTableScan" in text
            assert text.split("InMemoryRelation")[0].count("from_json") == 0
    finally:
        decoded.unpersist()


def test_broadcasts_are_checked():
    from pathlib import Path

    package = Path(m.__file__).parent
    for source in package.rglob("*.py"):
        if "llm" in source.parts:
            continue
        lines = source.read_text().splitlines()
        for number, line in enumerate(lines):
            for word in (".collect()", ".toPandas(", "localCheckpoint", ".rdd"):
                assert word not in line, (source, word)
            if "broadcast(" in line:
                assert ".count() <= BROADCAST" in lines[number - 1], (source, line)
