from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

import millrace as m
from checks import adapter as A
from millrace import schemas as S
from tests.conftest import CART, ORDER, SF_SMALL, VIEW, points, raw, rows_of, session_rows


@pytest.fixture(scope="module")
def funnel(spark):
    """One session for each combination of view, cart and order."""
    rows = []
    for i, chosen in enumerate(product((False, True), repeat=3)):
        kinds = [kind for kind, on in zip((VIEW, CART, ORDER), chosen, strict=True) if on]
        rows += session_rows(f"s{i}", *(kinds or [{"event_type": "error"}]))
    return m.enrich(raw(spark, rows))


def test_session_funnel(funnel):
    assert m.session_funnel(funnel).first().asDict() == {
        "total_sessions": 8,
        "sessions_with_views": 4,
        "sessions_with_cart": 4,
        "sessions_with_orders": 4,
        "view_to_cart_rate": 1.0,
        "cart_to_order_rate": 1.0,
        "conversion_rate": 1.0,
    }


def test_abandoned_sessions(funnel):
    assert tuple(m.cart_abandonment_sessions(funnel).first()) == (4, 2, 0.5)


def test_abandoned_sessions_equal_an_anti_join(spark):
    events = m.enrich(A.raw_events(spark, SF_SMALL))
    of = lambda s: events.where(F.col("service_source") == s).select("session_id").distinct()
    carts = of(S.CART_SERVICE)
    left = carts.join(of(S.ORDER_SERVICE), "session_id", "left_anti")
    got = m.cart_abandonment_sessions(events).first()
    assert (got[0], got[1]) == (carts.count(), left.count())


def test_totals(funnel):
    assert tuple(m.conversion_rate_total(funnel).first()) == ("conversion_rate", 1.0)
    assert tuple(m.cart_abandonment_literal(funnel).first()) == (
        "cart_abandonment_rate", 1.0,
    )
    assert tuple(m.gmv_total(funnel).first()) == ("gmv", 40.0)


def test_totals_of_nothing(spark):
    nothing = m.enrich(raw(spark, []))
    assert m.conversion_rate_total(nothing).first()["metric_value"] is None
    assert m.cart_abandonment_literal(nothing).first()["metric_value"] is None
    assert m.cart_abandonment_sessions(nothing).first()["abandonment_rate"] is None
    assert m.gmv_total(nothing).first()["metric_value"] == 0.0
    funnel = m.session_funnel(nothing).first().asDict()
    assert set(funnel.values()) == {0}
    got = m.product_metrics(nothing, "2024-01-31 00:00:00").collect()
    assert [(r["metric_name"], r["metric_value"]) for r in got] == [("gmv", 0.0)]


def test_product_metrics_agree_with_the_totals(funnel):
    got = {
        r["metric_name"]: r["metric_value"]
        for r in m.product_metrics(funnel, "2024-01-31 00:00:00").collect()
    }
    want = dict(
        tuple(total(funnel).first()) for total in (m.conversion_rate_total, m.gmv_total)
    )
    literal = m.cart_abandonment_literal(funnel).first()["metric_value"]
    share = m.cart_abandonment_sessions(funnel).first()["abandonment_rate"]
    want |= {"cart_abandonment_literal": literal, "cart_abandonment_rate": share}
    assert got == want


def test_counts(spark):
    df = raw(spark, [VIEW, VIEW, {**CART, "_topic": S.CART_TOPIC}, {**VIEW, "user_id": 0}])
    assert rows_of(m.topic_counts(df)) == [("cart-events", 1), ("page-views", 3)]
    assert rows_of(m.event_source_counts(m.enrich(df))) == [
        ("add_to_cart", "cart_service", 1),
        ("page_view", "view_service", 2),
    ]


def test_summary_and_span(spark):
    df = points(spark, [1, 2, 6])
    assert rows_of(m.metric_summary(df)) == [("m", 3, 3.0)]
    row = m.metric_span(df).first()
    assert (row["last_point"] - row["first_point"]).total_seconds() == 120


def test_recent_points_are_strictly_newer(spark):
    df = points(spark, [1, 2, 3])
    row = m.recent_points(df, "2024-01-01 00:06:00").first()
    assert row["new_records"] == 1
    empty = m.recent_points(df, "2024-01-02 00:00:00").first()
    assert tuple(empty) == (0, None)


def test_latest_points_break_ties_by_name(spark):
    df = points(spark, range(12), "b").unionByName(points(spark, range(12), "a"))
    got = m.latest_points(df, 3).collect()
    assert [(r["metric_name"], r["metric_value"]) for r in got] == [
        ("a", 11.0), ("b", 11.0), ("a", 10.0),
    ]


def test_series_range_includes_both_ends(spark):
    df = points(spark, range(5)).unionByName(points(spark, range(5), "other"))
    got = m.series_range(df, "m", "2024-01-01 00:01:00", "2024-01-01 00:03:00")
    assert [r["metric_value"] for r in got.collect()] == [1.0, 2.0, 3.0]


def test_panel_series(spark):
    df = points(spark, range(90), S.GMV).unionByName(points(spark, range(90), "other"))
    got = m.panel_series(df, "2024-01-01 01:30:00").collect()
    assert len(got) == 60 and {r["metric_name"] for r in got} == {S.GMV}


def test_gmv_is_exact(spark):
    df = raw(spark, [{**ORDER, "amount": Decimal("0.10")}] * 3)
    assert m.gmv_total(m.enrich(df)).first()["metric_value"] == 0.3
