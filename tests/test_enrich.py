from decimal import Decimal

import pytest

import millrace as m
from millrace import schemas as S
from tests.conftest import at, raw, rows_of


def enriched(spark, **columns):
    return m.enrich(raw(spark, [columns])).first()


@pytest.mark.parametrize(
    "given, kept", [(0, 0), (1, 1), (999_999, 999_999), (1_000_000, 0), (-5, 0)]
)
def test_product_guard(spark, given, kept):
    assert enriched(spark, product_id=given)["product_id"] == kept


@pytest.mark.parametrize("given, kept", [(0, 1), (1, 1), (99, 99), (100, 1), (-1, 1)])
def test_quantity_guard_defaults_to_one(spark, given, kept):
    assert enriched(spark, quantity=given)["quantity"] == kept


@pytest.mark.parametrize(
    "given, kept",
    [("0", "0"), ("0.01", "0.01"), ("99999.99", "99999.99"), ("100000", "0"), ("-1", "0")],
)
def test_amount_guard(spark, given, kept):
    assert enriched(spark, amount=Decimal(given))["amount"] == Decimal(kept)


@pytest.mark.parametrize(
    "given, kept", [("", ""), ("   ", ""), (" HoMe ", "home"), ("\tX ", "\tx")]
)
def test_text_columns(spark, given, kept):
    row = enriched(spark, page=given, action=given, status=given)
    assert (row["page"], row["action"], row["status"]) == (kept, kept, kept)


def test_order_id_scrub(spark):
    assert enriched(spark, order_id=" o@1#-_ ")["order_id"] == "o1-_"


def test_users_must_be_positive(spark):
    df = m.enrich(raw(spark, [{"user_id": u} for u in (-1, 0, 1, 2**32)]))
    assert rows_of(df, "user_id") == [(1,), (4294967296,)]


def test_columns_and_types(spark):
    df = m.enrich(raw(spark, [{}]))
    assert df.columns == [
        "event_type", "user_id", "session_id", "timestamp", "service_source", "page",
        "product_id", "action", "quantity", "order_id", "amount", "status", "_topic",
    ]
    assert df.schema["amount"].dataType == S.AMOUNT


def test_month_passes_through(spark):
    df = m.enrich(m.with_event_month(raw(spark, [{}])))
    assert df.columns[-1] == S.MONTH


def test_service_filter_follows_the_classification(spark):
    kinds = [*S.VIEW_EVENTS, *S.CART_EVENTS, *S.ORDER_EVENTS, "error"]
    df = m.enrich(raw(spark, [{"event_type": k, "timestamp": at("2024-01-01 00:00:00")} for k in kinds]))
    from millrace.operators.enrich import of_services

    for service in S.SERVICE_EVENTS:
        want = rows_of(df.where(df.service_source == service))
        assert rows_of(of_services(df, service)) == want
    assert of_services(df).count() == 6
