from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions import (
    bounded,
    bucket_start,
    classify,
    instant,
    labels_key,
    month_of,
    normalise,
    safe_ratio,
    scrub,
    seconds_in,
    since,
)
from tests.conftest import at, points, rows_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_bounded_keeps_the_open_interval_only(spark):
    df = spark.createDataFrame([(v,) for v in (None, -1, 0, 1, 99, 100)], "x long")
    kept = df.select("x", bounded("x", 0, 100, 7).alias("y"))
    assert {r["x"]: r["y"] for r in kept.collect()} == {
        None: 7, -1: 7, 0: 7, 1: 1, 99: 99, 100: 7,
    }


def test_normalise_trims_spaces_but_not_tabs(spark):
    assert one(spark, normalise(F.lit(" HoMe "))) == "home"
    assert one(spark, normalise(F.lit("   "))) == ""
    assert one(spark, normalise(F.lit("\tX "))) == "\tx"


def test_scrub_removes_every_foreign_character(spark):
    assert one(spark, scrub(F.lit(" o@1#-_ é"))) == "o1-_"


def test_classify(spark):
    expected = {
        "page_view": "view_service",
        "product_click": "view_service",
        "add_to_cart": "cart_service",
        "remove_from_cart": "cart_service",
        "update_quantity": "cart_service",
        "order_event": "order_service",
        "PAGE_VIEW": "unknown",
        "": "unknown",
    }
    df = spark.createDataFrame([(k,) for k in expected], "event_type string")
    got = {r[0]: r[1] for r in df.select("event_type", classify("event_type")).collect()}
    assert got == expected


def test_safe_ratio_is_null_without_a_base(spark):
    assert one(spark, safe_ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, safe_ratio(F.lit(-3), F.lit(2))) == -1.5


def test_labels_key_ignores_insertion_order(spark):
    one_way = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    other = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert one(spark, labels_key(one_way) == labels_key(other))


def test_instant_does_not_depend_on_the_local_zone(spark):
    want = 1704067200
    plus_two = timezone(timedelta(hours=2))
    for value in (
        "2024-01-01 00:00:00",
        "2024-01-01T02:00:00+02:00",
        datetime(2024, 1, 1),
        datetime(2024, 1, 1, 2, tzinfo=plus_two),
    ):
        assert one(spark, F.unix_seconds(instant(value))) == want


def test_seconds_in():
    assert [seconds_in(i) for i in ("1 minute", "30 minutes", "24 hours", "1 day")] == [
        60, 1800, 86400, 86400,
    ]
    assert seconds_in(timedelta(minutes=2)) == 120


@pytest.mark.parametrize(
    "bucket, start",
    [
        ("minute", "2024-01-31 23:47:00"),
        ("15 minutes", "2024-01-31 23:45:00"),
        ("hour", "2024-01-31 23:00:00"),
        ("day", "2024-01-31 00:00:00"),
    ],
)
def test_bucket_start(spark, bucket, start):
    inside = instant("2024-01-31 23:47:12.345678")
    assert one(spark, bucket_start(inside, bucket)).timestamp() == at(start).timestamp()
    early = F.timestamp_seconds(F.lit(-1))
    length = seconds_in(bucket)
    assert one(spark, F.unix_seconds(bucket_start(early, bucket))) == -length
    if " " not in bucket:
        same = F.date_trunc(bucket, inside) == bucket_start(inside, bucket)
        assert one(spark, same)


def test_month_of(spark):
    assert one(spark, month_of(instant("2024-01-31 23:59:59"))) == "202401"


def test_since_bounds(spark):
    df = points(spark, [1, 2, 3, 4])
    loose = since(df, "2024-01-01 00:03:00", "2 minutes")
    strict = since(df, "2024-01-01 00:03:00", "2 minutes", inclusive=False)
    assert loose.count() == 3 and strict.count() == 2


def test_since_floors_to_the_bucket(spark):
    df = points(spark, range(60))
    floored = since(df, "2024-01-01 00:50:30", "30 minutes", bucket="hour")
    assert floored.count() == 60
    assert since(df, "2024-01-01 00:50:30", "30 minutes").count() == 39


def test_since_also_filters_the_month(spark):
    df = points(spark, [1]).withColumn("event_month", F.lit("202312"))
    # The month disagrees with the time on purpose: the month filter must act.
    assert since(df, "2024-01-01 00:10:00", "30 minutes").count() == 1
    assert since(df, "2024-01-01 01:10:00", "30 minutes").count() == 0
    january = points(spark, [1], start="2024-01-20 00:00:00")
    wrong = january.withColumn("event_month", F.lit("202312"))
    assert since(wrong, "2024-01-20 00:10:00", "30 minutes").count() == 0


def test_points_helper(spark):
    assert rows_of(points(spark, [5]), "metric_value", "timestamp")[0][0] == 5.0
    assert at("2024-01-01 00:00:00").tzinfo is timezone.utc
