from decimal import Decimal
from functools import reduce

import pytest
from pyspark.sql import functions as F

import millrace as m
from checks import adapter as A
from millrace import schemas as S
from tests.conftest import CART, ORDER, SF_SMALL, VIEW, at, raw, rows_of, session_rows

COUNTS = ("viewing_sessions", "cart_sessions", "order_sessions")


def buckets(spark, rows, **options):
    return m.bucket_sessions(m.enrich(raw(spark, rows)), **options)


def test_sessions_are_counted_once_per_service_and_bucket(spark):
    rows = (
        session_rows("a", VIEW, VIEW, CART, ORDER, ORDER)
        + session_rows("b", VIEW)
        + session_rows("a", VIEW, time="2024-01-01 00:01:00")
    )
    got = rows_of(buckets(spark, rows), F.minute("bucket"), *COUNTS, "gmv")
    assert got == [(0, 2, 1, 1, Decimal("20.00")), (1, 1, 0, 0, Decimal("0.00"))]


def test_only_order_amounts_count(spark):
    rows = [
        {**VIEW, "amount": Decimal("5.00")},
        {**ORDER, "amount": Decimal("7.00")},
        {**ORDER, "amount": Decimal("100000.00")},
    ]
    assert buckets(spark, rows).first()["gmv"] == Decimal("7.00")


def test_rates_may_leave_the_unit_interval(spark):
    rows = session_rows("a", VIEW, CART) + sum(
        (session_rows(s, ORDER) for s in "bcd"), []
    )
    got = dict(rows_of(m.to_metric_rows(buckets(spark, rows)), "metric_name", "metric_value"))
    assert got == {S.CONVERSION: 3.0, S.ABANDONMENT: -2.0, S.GMV: 30.0}


@pytest.mark.parametrize(
    "kinds, names",
    [
        ((CART, ORDER), {S.ABANDONMENT, S.GMV}),
        ((VIEW, ORDER), {S.CONVERSION, S.GMV}),
        ((VIEW, CART), {S.CONVERSION, S.ABANDONMENT}),
        (({"event_type": "error"},), set()),
    ],
)
def test_a_series_has_no_point_without_its_base(spark, kinds, names):
    metrics = m.to_metric_rows(buckets(spark, session_rows("a", *kinds)))
    assert {r["metric_name"] for r in metrics.collect()} == names


def test_labels(spark):
    metrics = m.to_metric_rows(buckets(spark, session_rows("a", VIEW, CART, ORDER)))
    assert {r["metric_name"]: r["labels"] for r in metrics.collect()} == {
        S.CONVERSION: {"type": "conversion"},
        S.ABANDONMENT: {"type": "abandonment"},
        S.GMV: {"type": "revenue"},
    }


EDGE = [
    {**VIEW, "session_id": "a", "timestamp": at("2024-01-01 00:10:00")},
    {**VIEW, "session_id": "b", "timestamp": at("2024-01-01 00:50:00")},
    {**VIEW, "session_id": "c", "timestamp": at("2024-01-01 01:10:00")},
    {**VIEW, "session_id": "d", "timestamp": at("2024-01-01 02:10:00")},
]


def test_lookback_floors_to_the_bucket_unless_told_not_to(spark):
    def first(**options):
        got = buckets(spark, EDGE, bucket="hour", since="2024-01-01 00:30:00", **options)
        return got.orderBy("bucket").first()["viewing_sessions"]

    assert first() == 2
    assert first(align=False) == 1


def test_open_bucket(spark):
    def hours(**options):
        got = buckets(spark, EDGE, bucket="hour", **options)
        return [r[0] for r in rows_of(got, F.hour("bucket"))]

    assert hours(as_of="2024-01-01 02:30:00") == [0, 1, 2]
    assert hours(as_of="2024-01-01 02:30:00", include_open_bucket=False) == [0, 1]
    assert hours(as_of="2024-01-01 02:00:00") == [0, 1]


def test_approximate_counts_are_close(spark):
    rows = [r for i in range(200) for r in session_rows(f"s{i}", VIEW, ORDER)]
    exact = buckets(spark, rows).first()
    close = buckets(spark, rows, exact=False).first()
    assert exact["viewing_sessions"] == 200
    assert abs(close["viewing_sessions"] - 200) < 30
    assert close["gmv"] == exact["gmv"]
    assert close.asDict().keys() == exact.asDict().keys()


def test_one_pass_equals_the_union_of_three_series(spark):
    wide = m.bucket_sessions(m.enrich(A.raw_events(spark, SF_SMALL)), "hour")
    flat = lambda df: df.withColumn("labels", F.col("labels")["type"])
    together = flat(m.to_metric_rows(wide))
    separate = reduce(
        lambda a, b: a.unionByName(b),
        [flat(m.metric_series(wide, name)) for name in S.METRIC_LABELS],
    )
    assert together.exceptAll(separate).count() == 0
    assert separate.exceptAll(together).count() == 0


def test_two_stage_counts_equal_distinct_counts(spark):
    events = m.enrich(A.raw_events(spark, SF_SMALL))
    of = lambda s: F.countDistinct(
        F.when(F.col("service_source") == s, F.col("session_id"))
    )
    plain = events.groupBy(F.date_trunc("hour", "timestamp")).agg(
        of(S.VIEW_SERVICE), of(S.CART_SERVICE), of(S.ORDER_SERVICE)
    )
    assert rows_of(m.bucket_sessions(events, "hour"), "bucket", *COUNTS) == rows_of(plain)


def test_input_order_does_not_matter(spark):
    events = m.enrich(A.raw_events(spark, SF_SMALL))
    shuffled = events.repartition(7).orderBy(F.xxhash64("session_id", "timestamp"))
    key = ("metric_name", "timestamp", "metric_value")
    assert rows_of(m.kpi_metrics(events, "hour"), *key) == rows_of(
        m.kpi_metrics(shuffled, "hour"), *key
    )


def test_a_hot_session_and_a_hot_bucket(spark):
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("s"), F.col("id") % 500))
        .alias("session_id"),
        F.when(F.col("id") % 2 == 0, F.lit("page_view")).otherwise("order_event").alias("event_type"),
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        F.lit(1).cast(S.AMOUNT).alias("amount"),
    ).withColumn("service_source", m.classify("event_type"))
    row = m.bucket_sessions(hot).first()
    assert row["gmv"] == Decimal("30000.00")
    assert row["viewing_sessions"] == 251 and row["order_sessions"] == 251


def test_buckets_of_any_length(spark):
    rows = sum(
        (session_rows(f"s{i}", VIEW, time=f"2024-01-01 00:{i:02}:00") for i in range(60)),
        [],
    )
    got = rows_of(buckets(spark, rows, bucket="15 minutes"), F.minute("bucket"), COUNTS[0])
    assert got == [(0, 15), (15, 15), (30, 15), (45, 15)]


def test_sums_of_the_largest_amounts_are_exact(spark):
    rows = [{**ORDER, "amount": Decimal("99999.99")}] * 50
    assert buckets(spark, rows).first()["gmv"] == Decimal("4999999.50")
