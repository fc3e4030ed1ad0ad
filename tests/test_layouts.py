"""Session-hashed tables, step-aligned reads and field profiles."""

from __future__ import annotations

import json

import millrace as m
from millrace import schemas as S
from tests.conftest import CART, ORDER, VIEW, at, points, raw, rows_of, session_rows


def test_a_session_hashed_table_needs_no_shuffle_by_session(spark, tmp_path):
    rows = session_rows("a", VIEW, CART) + session_rows("b", VIEW, ORDER) + session_rows("c", CART)
    events = m.enrich(raw(spark, rows))
    table = m.write_by_session(events, "events_by_session_test", str(tmp_path / "t"), 4)
    for operator in (m.session_funnel, m.cart_abandonment_sessions):
        plan = operator(table)._jdf.queryExecution().executedPlan().toString()
        # One exchange: the partial counts that meet in the final aggregate.
        assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan
        assert rows_of(operator(table)) == rows_of(operator(events))
    carts = table.where("service_source = 'cart_service'").select("session_id")
    orders = table.where("service_source = 'order_service'").select("session_id")
    lost = carts.join(orders, "session_id", "left_anti")
    assert "Exchange" not in lost._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in lost.collect()) == ["a", "c"]
    spark.sql("DROP TABLE events_by_session_test")


def test_steps_show_the_last_point_until_it_is_stale(spark):
    series = points(spark, [1, 2, None, None, None, 6], "ecommerce_gmv")
    got = m.panel_steps(series, at("2024-01-01 00:00:30"), at("2024-01-01 00:07:59"), "30 seconds", "2 minutes")
    found = [(r.timestamp.strftime("%M:%S"), r.metric_value) for r in got.orderBy("timestamp").collect()]
    assert found == [
        ("00:30", 1.0), ("01:00", 2.0), ("01:30", 2.0), ("02:00", 2.0), ("02:30", 2.0),
        ("05:00", 6.0), ("05:30", 6.0), ("06:00", 6.0), ("06:30", 6.0),
    ]
    # Each label set is a series; names outside the panel have no row.
    two = series.union(points(spark, [9], "ecommerce_gmv", label="y")).union(points(spark, [7], "other"))
    first = m.panel_steps(two, at("2024-01-01 00:00:00"), at("2024-01-01 00:00:00"))
    assert rows_of(first.selectExpr("labels.type", "metric_value")) == [("x", 1.0), ("y", 9.0)]
    assert m.panel_steps(two.limit(0), at("2024-01-01 00:00:00"), at("2024-01-02 00:00:00")).count() == 0


def test_profile_of_fields_known_and_unknown(spark):
    values = [
        (S.VIEW_TOPIC, json.dumps({"event_type": "page_view", "user_id": 1, "ab": {"x": 1}})),
        (S.VIEW_TOPIC, json.dumps({"user_id": "one", "ab": [1], "gone": None})),
        (S.CART_TOPIC, '{"type":"a"}\n{"type":"b","vip":false}'),
        (S.CART_TOPIC, "no json"), (S.CART_TOPIC, None), (S.CART_TOPIC, "[1]"), ("other", '{"type":1.5}'),
    ]
    records = spark.createDataFrame(
        [("k", v, t, 0, i, at("2024-01-01 00:00:00")) for i, (t, v) in enumerate(values)], S.RECORD_SCHEMA
    )
    got = rows_of(m.field_profile(records), "topic", "field", "type", "known", "messages")
    assert got == sorted([
        (S.VIEW_TOPIC, "event_type", "string", True, 1), (S.VIEW_TOPIC, "user_id", "number", True, 1),
        (S.VIEW_TOPIC, "user_id", "string", True, 1), (S.VIEW_TOPIC, "ab", "object", False, 1),
        (S.VIEW_TOPIC, "ab", "array", False, 1), (S.VIEW_TOPIC, "gone", "null", False, 1),
        (S.CART_TOPIC, "type", "string", True, 2), (S.CART_TOPIC, "vip", "boolean", False, 1),
        ("other", "type", "number", False, 1),
    ], key=repr)
