from __future__ import annotations

import sys
from datetime import datetime, timezone
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace import schemas as S  # noqa: E402
from millrace.session import configure  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def at(text: str) -> datetime:
    """A UTC instant, safe from the zone of the test machine."""
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


_RAW_DEFAULTS = {
    "event_type": "page_view",
    "user_id": 1,
    "session_id": "s",
    "timestamp": at("2024-01-01 00:00:00"),
    "page": "",
    "product_id": 0,
    "action": "",
    "quantity": 0,
    "order_id": "",
    "cart_id": "",
    "amount": Decimal("0.00"),
    "status": "",
    "_topic": S.VIEW_TOPIC,
    "_offset": 0,
}


def raw(spark, rows):
    """Raw events from dicts that state only what matters."""
    full = [tuple({**_RAW_DEFAULTS, **row}.values()) for row in rows]
    return spark.createDataFrame(full, S.RAW_EVENT_SCHEMA)


VIEW, CART, ORDER = (
    {"event_type": "page_view"},
    {"event_type": "add_to_cart"},
    {"event_type": "order_event", "amount": Decimal("10.00")},
)


def session_rows(session, *kinds, time="2024-01-01 00:00:00"):
    return [{**kind, "session_id": session, "timestamp": at(time)} for kind in kinds]


def points(spark, values, metric="m", start="2024-01-01 00:00:00", label="x"):
    """One metric point a minute."""
    from datetime import timedelta

    begin = at(start)
    rows = [
        (begin + timedelta(minutes=i), metric, float(v), {"type": label})
        for i, v in enumerate(values)
        if v is not None
    ]
    return spark.createDataFrame(rows, S.METRIC_SCHEMA)


def rows_of(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
