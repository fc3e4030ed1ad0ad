from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace import schemas as S
from tests.conftest import at, raw, rows_of

ARRIVED = at("2024-01-01 00:00:30")

VIEW = (
    '{"event_type":"page_view","user_id":7,"product_id":3,'
    '"session_id":"session-9","timestamp":1704067200,"page":"home"}'
)
CART = '{"type": "add_to_cart", "user_id": 7, "product_id": 3, "quantity": 2}'
ORDER = (
    '{"event_type":"order_event","user_id":7,"order_id":"o-1",'
    '"session_id":"session-9","timestamp":1704067200,"amount":8.28,"status":"created"}'
)


def records(spark, *messages):
    return spark.createDataFrame(
        [("k", v, topic, 0, i, ARRIVED) for i, (topic, v) in enumerate(messages)],
        S.RECORD_SCHEMA,
    )


def test_view_row(spark):
    good, _ = m.parse_json(records(spark, (S.VIEW_TOPIC, VIEW)), S.VIEW_SCHEMA)
    row = m.conform_views(good).first().asDict()
    assert row.pop("timestamp").timestamp() == 1704067200
    assert row == {
        "event_type": "page_view", "user_id": 7, "session_id": "session-9",
        "page": "home", "product_id": 3, "action": "", "quantity": 0, "order_id": "",
        "cart_id": "", "amount": Decimal("0.00"), "status": "",
        "_topic": "page-views", "_offset": 0,
    }


def test_cart_row_gets_its_session_from_the_user_and_its_time_from_arrival(spark):
    good, _ = m.parse_json(records(spark, (S.CART_TOPIC, CART)), S.CART_SCHEMA)
    row = m.conform_carts(good).first()
    assert row["event_type"] == row["action"] == "add_to_cart"
    assert row["session_id"] == "session-7"
    assert row["timestamp"].timestamp() == ARRIVED.timestamp()
    assert row["quantity"] == 2
    fixed = m.conform_carts(good, ingest_ts="2024-02-01 00:00:00").first()
    assert fixed["timestamp"].timestamp() == at("2024-02-01 00:00:00").timestamp()
    assert m.conform_carts(good, session_from_user=False).first()["session_id"] == ""


@pytest.mark.parametrize(
    "amount, cents",
    [("5.02", "5.02"), ("8.20", "8.20"), ("8.28", "8.28"), ("12.345", "12.35")],
)
def test_order_amounts_keep_their_cents(spark, amount, cents):
    message = ORDER.replace("8.28", amount)
    good, _ = m.parse_json(records(spark, (S.ORDER_TOPIC, message)), S.ORDER_SCHEMA)
    assert m.conform_orders(good).first()["amount"] == Decimal(cents)


def test_missing_fields_take_type_defaults(spark):
    good, bad = m.parse_json(records(spark, (S.VIEW_TOPIC, "{}")), S.VIEW_SCHEMA)
    assert bad.count() == 0
    row = m.conform_views(good).first()
    assert (row["event_type"], row["user_id"], row["session_id"]) == ("", 0, "")
    assert row["timestamp"].timestamp() == 0
    assert None not in row.asDict().values()


BAD = [
    "not JSON",
    '{"user_id":1,',
    "",
    "   ",
    None,
    "[1]",
    "5",
    '{"event_type":"page_view","user_id":"5"}',
    '{"event_type":"page_view","user_id":99999999999999999999}',
]


def test_bad_messages_are_split_off_untouched(spark):
    wire = records(spark, (S.VIEW_TOPIC, VIEW), *[(S.VIEW_TOPIC, b) for b in BAD])
    good, bad = m.parse_json(wire, S.VIEW_SCHEMA)
    assert good.count() == 1
    assert rows_of(bad, "value") == sorted(((b,) for b in BAD), key=repr)
    assert bad.columns == [*wire.columns, S.REASON]


def test_unsigned_ids_fit(spark):
    wide = VIEW.replace('"user_id":7', '"user_id":4294967295')
    good, _ = m.parse_json(records(spark, (S.VIEW_TOPIC, wide)), S.VIEW_SCHEMA)
    assert good.first()["user_id"] == 4294967295


def test_one_pass_equals_three_conformers(spark):
    wire = records(
        spark,
        (S.VIEW_TOPIC, VIEW),
        (S.CART_TOPIC, CART),
        (S.ORDER_TOPIC, ORDER),
        (S.VIEW_TOPIC, "{}"),
        # A field of another topic's format plays no part here, whatever its type.
        (S.VIEW_TOPIC, VIEW.replace("}", ',"amount":"x"}')),
        (S.ORDER_TOPIC, ORDER.replace("8.28", '"8.28"')),
        *[(S.CART_TOPIC, b) for b in BAD[:5]],
    )
    topic = F.col("topic")
    parsed = {
        name: m.parse_json(wire.where(topic == name), schema)
        for name, schema in S.WIRE_SCHEMAS.items()
    }
    separate = m.union_events(
        m.conform_views(parsed[S.VIEW_TOPIC][0]),
        m.conform_carts(parsed[S.CART_TOPIC][0]),
        m.conform_orders(parsed[S.ORDER_TOPIC][0]),
    )
    together, rejected = m.conform_records(wire)
    assert rows_of(together) == rows_of(separate)
    assert together.schema.fieldNames() == S.RAW_EVENT_SCHEMA.fieldNames()
    assert [f.dataType for f in together.schema] == [
        f.dataType for f in S.RAW_EVENT_SCHEMA
    ]
    assert rejected.count() == sum(bad.count() for _, bad in parsed.values()) == 6


def test_a_foreign_topic_is_rejected(spark):
    good, rejected = m.conform_records(
        records(spark, ("other", VIEW), (None, VIEW), (S.VIEW_TOPIC, VIEW))
    )
    assert (good.count(), rejected.count()) == (1, 2)


def test_union_keeps_duplicates(spark):
    df = raw(spark, [{}])
    assert m.union_events(df, df, df).count() == 3


def test_records_round_trip(spark):
    events = raw(
        spark,
        [
            {"product_id": 5, "page": "home", "session_id": "s-1"},
            {"product_id": 0},
            {
                "event_type": "order_event", "_topic": S.ORDER_TOPIC, "order_id": "o",
                "amount": Decimal("54.99"), "status": "created", "session_id": "s-2",
            },
            {
                "event_type": "add_to_cart", "action": "add_to_cart", "quantity": 3,
                "product_id": 2, "user_id": 8, "session_id": "session-8",
                "_topic": S.CART_TOPIC,
            },
        ],
    )
    sent = m.to_kafka_records(events, carry=("_offset", "timestamp"))
    assert {r["key"] for r in sent.collect()} == {"user-1", "user-8"}
    assert '"product_id"' not in [
        r["value"] for r in sent.collect() if r["topic"] == S.VIEW_TOPIC
    ][1]
    back, rejected = m.conform_records(
        sent.withColumnRenamed("_offset", "offset").withColumn("partition", F.lit(0))
    )
    assert rejected.count() == 0
    assert rows_of(back) == rows_of(events)


def test_publish_and_read_back_through_files(spark, tmp_path):
    events = raw(spark, [{"page": "home", "timestamp": at("2024-01-01 00:00:00")}])
    path = str(tmp_path / "topic")
    m.publish_events(events, fmt="json", path=path)
    read = m.read_events(spark, "views", fmt="json", streaming=False, path=path)
    assert read.count() == 1
    assert m.read_events(spark, "orders", fmt="json", streaming=False, path=path).count() == 0


def test_event_month(spark):
    df = raw(
        spark,
        [
            {"timestamp": at("2024-01-31 23:59:59")},
            {"timestamp": at("2024-01-31 23:59:59") + timedelta(seconds=1)},
        ],
    )
    months = rows_of(m.with_event_month(df), "event_month")
    assert months == [("202401",), ("202402",)]
    assert rows_of(m.events_by_month(df)) == [("202401", 1), ("202402", 1)]
