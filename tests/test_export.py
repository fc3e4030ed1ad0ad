import json
import urllib.request

import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace import schemas as S
from tests.conftest import at, points, rows_of


def documents(df):
    return [json.loads(r["payload"]) for r in m.import_payload(df).collect()]


def test_payload_shape(spark):
    df = points(spark, [0.5], S.CONVERSION, label="conversion")
    assert m.import_payload(df).first()["payload"] == (
        '{"metric":{"__name__":"ecommerce_conversion_rate","type":"conversion"},'
        '"values":[0.5],"timestamps":[1704067200000]}'
    )


def test_payload_labels(spark):
    stamp = at("2024-01-01 00:00:00")
    df = spark.createDataFrame(
        [
            (stamp, "m", 1.0, {"a": "1", "b": 'x"y'}),
            (stamp, "m", 2.0, {"__name__": "other"}),
            (stamp, "m", 3.0, {}),
            (stamp, "m", 4.0, None),
        ],
        S.METRIC_SCHEMA,
    )
    got = {d["values"][0]: d["metric"] for d in documents(df)}
    assert got == {
        1.0: {"__name__": "m", "a": "1", "b": 'x"y'},
        2.0: {"__name__": "other"},
        3.0: {"__name__": "m"},
        4.0: {"__name__": "m"},
    }


@pytest.mark.parametrize("value", [1e-7, 12345678.9, 1e22, -3.0])
def test_payload_values_survive(spark, value):
    assert documents(points(spark, [value]))[0]["values"] == [value]


def test_import_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    m.write_import_lines(points(spark, [1, 2]), path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert sorted(d["values"][0] for d in lines) == [1.0, 2.0]


def test_each_point_has_a_delivery_status(spark):
    def flaky(batch):
        return ["refused" if '"values":[2.0]' in d else None for d in batch]

    status = m.publish(points(spark, [1, 2, 3]), flaky)
    assert rows_of(status, F.minute("timestamp"), "delivered", "error") == [
        (0, True, None), (1, False, "refused"), (2, True, None),
    ]
    assert rows_of(m.delivery_report(status)) == [("m", 3, 2, 1)]


def test_a_failing_sender_marks_its_points_and_does_not_stop_the_job(spark):
    def broken(batch):
        raise TimeoutError("no answer")

    status = m.publish(points(spark, [1, 2]), broken)
    assert rows_of(status, "delivered", "error") == [(False, "no answer")] * 2


class Answer:
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def test_http_sender_batches_and_reports_failures(monkeypatch):
    requests = []

    def urlopen(request, timeout):
        requests.append((request, timeout))
        if len(requests) == 2:
            raise OSError("down")
        return Answer()

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    send = m.http_sender("http://store.invalid/import", timeout=10, per_request=2)
    assert send(["a", "b", "c", "d", "e"]) == [None, None, "down", "down", None]
    first, timeout = requests[0]
    assert (first.data, first.get_method(), timeout) == (b"a\nb", "POST", 10)
    assert first.get_header("Content-type") == "application/json"


def test_keyed_records(spark):
    from tests.conftest import raw

    df = raw(
        spark,
        [{"user_id": 42, "product_id": 9, "session_id": "s-1", "page": "home"}],
    )
    row = m.to_kafka_records(df).first()
    assert (row["topic"], row["key"]) == ("page-views", "user-42")
    assert row["value"] == (
        '{"event_type":"page_view","user_id":42,"product_id":9,"session_id":"s-1",'
        '"timestamp":1704067200,"page":"home"}'
    )
