from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import millrace as m
from checks import adapter as A
from checks.queries import QUERIES
from millrace import schemas as S
from tests.conftest import ORDER, SF, SF_SMALL, VIEW, at, raw, rows_of

BAD = "not JSON"


def arrive(spark, folder, events, offset=0, bad=0):
    """Write one file of messages, as a broker would hand them over."""
    sent = m.to_kafka_records(events, carry=("timestamp",))
    broken = spark.createDataFrame(
        [("k", BAD, S.VIEW_TOPIC, at("2024-01-01 00:00:00"))] * bad,
        "key string, value string, topic string, timestamp timestamp",
    )
    wire = (
        sent.unionByName(broken)
        .withColumn("partition", F.lit(0))
        .withColumn("offset", F.lit(offset).cast("long"))
        .select(*S.RECORD_SCHEMA.fieldNames())
    )
    wire.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, **options):
    return m.read_events(spark, fmt="parquet", path=folder, **options)


def test_ingest_resumes_from_its_checkpoint(spark, tmp_path):
    wire, table, checkpoint = (str(tmp_path / n) for n in ("wire", "raw", "cp"))
    one = raw(spark, [{"session_id": "a"}, {**ORDER, "_topic": S.ORDER_TOPIC}])
    for expected in (2, 4):
        arrive(spark, wire, one, bad=1)
        m.ingest_stream(
            stream(spark, wire), table, checkpoint, trigger=None
        ).awaitTermination()
        assert m.read_raw_events(spark, table).count() == expected
    # A run without new files adds nothing.
    m.ingest_stream(stream(spark, wire), table, checkpoint, trigger=None).awaitTermination()
    assert m.read_raw_events(spark, table).count() == 4


def test_rejected_messages_reach_quarantine(spark, tmp_path):
    wire, table, checkpoint = (str(tmp_path / n) for n in ("wire", "bad", "cp"))
    arrive(spark, wire, raw(spark, [{}]), bad=3)
    m.quarantine_stream(stream(spark, wire), table, checkpoint, trigger=None).awaitTermination()
    rejected = spark.read.schema(S.RECORD_SCHEMA).parquet(table)
    assert rows_of(rejected, "value") == [(BAD,)] * 3


def minutes(spark, *given):
    """(minute, session, kind) events."""
    return raw(
        spark,
        [
            {
                **kind,
                "session_id": session,
                "timestamp": at("2024-01-01 00:00:00") + timedelta(minutes=minute),
                "_topic": S.ORDER_TOPIC if kind is ORDER else S.VIEW_TOPIC,
            }
            for minute, session, kind in given
        ],
    )


def drain(spark, tmp_path, wire, lateness):
    wide, _ = m.conform_records(stream(spark, wire))
    buckets = m.bucket_sessions_stream(m.enrich(wide), "1 minute", lateness)
    out = str(tmp_path / "out")
    (
        buckets.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(buckets.schema).parquet(out)


def test_buckets_appear_once_when_closed_and_wait_for_late_events(spark, tmp_path):
    wire = str(tmp_path / "wire")
    arrive(spark, wire, minutes(spark, (0, "a", VIEW), (0, "a", VIEW), (10, "b", VIEW)))
    closed = drain(spark, tmp_path, wire, "1 hour")
    assert closed.count() == 0
    # 50 minutes late is within the tolerance; the same session is not counted twice.
    late = minutes(spark, (0, "a", ORDER), (0, "c", VIEW), (75, "d", VIEW))
    arrive(spark, wire, late)
    drain(spark, tmp_path, wire, "1 hour")
    columns = (F.minute("bucket"), "viewing_sessions", "order_sessions")
    assert rows_of(closed.sparkSession.read.parquet(str(tmp_path / "out")), *columns) == [
        (0, 2, 1), (10, 1, 0),
    ]
    # Two hours late is beyond it.
    arrive(spark, wire, minutes(spark, (0, "e", VIEW), (200, "f", VIEW)))
    again = drain(spark, tmp_path, wire, "1 hour")
    assert rows_of(again.where("minute(bucket) = 0"), *columns) == [(0, 2, 1)]


def test_stream_equals_batch_on_closed_buckets(spark):
    got = QUERIES["stream_buckets"](spark, SF)
    whole = m.bucket_sessions(m.enrich(A.raw_events(spark, SF)), "hour")
    newest = A.raw_events(spark, SF).where("user_id > 0").agg(F.max("timestamp")).first()[0]
    closed = whole.where(
        F.col("bucket") + F.expr("INTERVAL 2 HOURS") <= F.lit(newest)
    ).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    closed = closed.withColumn("gmv", F.col("gmv").cast("double"))
    assert got.count() == 718
    assert got.exceptAll(closed.select(*got.columns)).count() == 0


def test_detection_behind_the_stream_is_idempotent(spark, tmp_path):
    history, anomalies = str(tmp_path / "history"), str(tmp_path / "anomalies")
    events = m.enrich(A.as_raw(A.event_stream(spark, SF_SMALL)))

    def run(checkpoint):
        m.detect_stream(
            m.kpi_stream(events, "1 hour"),
            history,
            anomalies,
            str(tmp_path / checkpoint),
            bucket="1 hour",
            lookback="24 hours",
            threshold=0.1,
            trigger=None,
        ).awaitTermination()
        return (
            rows_of(m.read_history(spark, history), "metric_name", "timestamp"),
            rows_of(m.read_anomalies(spark, anomalies)),
        )

    # A fresh checkpoint replays everything, as after a lost one.
    first = run("one")
    assert first[0] and first[1]
    assert run("two") == first


@pytest.mark.parametrize("source", ["views", "carts", "orders"])
def test_streams_of_one_topic(spark, tmp_path, source):
    wire = str(tmp_path / "wire")
    arrive(spark, wire, minutes(spark, (0, "a", VIEW), (0, "a", ORDER)))
    got = stream(spark, wire, source=source, streaming=False)
    assert got.count() == (0 if source == "carts" else 1)


def test_a_poison_message_does_not_stop_ingest(spark, tmp_path):
    wire, table, bad, checkpoint = (str(tmp_path / n) for n in ("wire", "raw", "bad", "cp"))
    good = raw(spark, [{"session_id": "a"}, {**ORDER, "_topic": S.ORDER_TOPIC}])
    arrive(spark, wire, good)
    time = at("2024-01-01 00:00:00")
    poison = [
        (S.ORDER_TOPIC, '{"amount":1e9}'), (S.ORDER_TOPIC, '{"amount":"NaN"}'),
        (S.VIEW_TOPIC, '{"timestamp":9223372036854775807}'), (S.VIEW_TOPIC, '{"timestamp":-1}'),
        (S.VIEW_TOPIC, "{} {}"), (S.VIEW_TOPIC, "{}} junk"), (S.VIEW_TOPIC, '{},"~end":1} x'),
        (S.VIEW_TOPIC, '{"timestamp":2711000000}'), ("strange", "{}"), (S.VIEW_TOPIC, None),
    ]
    rows = [("k", v, t, 0, i, time) for i, (t, v) in enumerate(poison)]
    kinds = "key string, value string, topic string, partition int, offset long, timestamp timestamp"
    frame = spark.createDataFrame(rows, kinds).select(*S.RECORD_SCHEMA.fieldNames())
    frame.coalesce(1).write.mode("append").parquet(wire)
    for _ in range(2):
        m.ingest_stream(
            stream(spark, wire), table, checkpoint, trigger=None, quarantine_path=bad
        ).awaitTermination()
    assert m.read_raw_events(spark, table).count() == 2
    rejected = m.read_quarantine(spark, bad)
    assert rejected.count() == len(poison)
    assert rows_of(rejected.groupBy("reason").count()) == [
        ("amount out of range", 2), ("empty", 1), ("foreign topic", 1), ("malformed", 3),
        ("time ahead of arrival", 1), ("time out of range", 2),
    ]


def test_a_message_may_hold_several_objects(spark):
    value = '{"user_id":1}\n{"user_id":2}\r\nnone\n'
    pretty = '{\n "user_id": 3\n}'
    rows = [(value, S.VIEW_TOPIC, 1), (pretty, S.VIEW_TOPIC, 2)]
    frame = spark.createDataFrame(rows, "value string, topic string, offset long").selectExpr(
        "*", "'k' as key", "0 as partition", "timestamp'2024-01-01' as timestamp")
    wide, rejected = m.conform_records(frame)
    assert rows_of(wide, "user_id", "_offset") == [(1, 1), (2, 1), (3, 2)]
    assert rows_of(rejected, "value", "reason") == [("none", "malformed")]


def test_a_stream_and_batches_share_a_table(spark, tmp_path):
    wire, table, checkpoint = (str(tmp_path / n) for n in ("wire", "raw", "cp"))
    one = raw(spark, [{"session_id": "a"}, {"session_id": "b"}])
    m.write_raw_events(one, table)
    arrive(spark, wire, one)
    m.ingest_stream(stream(spark, wire), table, checkpoint, trigger=None).awaitTermination()
    m.write_raw_events(one, table)
    assert m.read_raw_events(spark, table).count() == 6
    # Without its commits, the stream repeats its only batch, which replaces itself.
    for log in (tmp_path / "cp" / "commits").iterdir():
        log.unlink()
    m.ingest_stream(stream(spark, wire), table, checkpoint, trigger=None).awaitTermination()
    assert m.read_raw_events(spark, table).count() == 6


def test_late_and_early_events_are_counted(spark, tmp_path):
    wire = str(tmp_path / "wire")
    for i, minute in enumerate((0, 60, 120, 0)):
        arrive(spark, wire, minutes(spark, (minute, f"s{i}", VIEW)), offset=i)
    wide, _ = m.conform_records(stream(spark, wire, maxFilesPerTrigger="1"))
    buckets = m.bucket_sessions_stream(m.enrich(wide), "1 minute", "10 minutes")
    query = (
        buckets.writeStream.format("noop")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert m.dropped_rows(query) >= 1
    events = minutes(spark, (0, "a", VIEW), (60 * 48, "b", VIEW))
    arrived = F.lit("2024-01-01 00:00:00").cast("timestamp")
    kept, ahead = m.not_ahead(events, arrived)
    assert rows_of(kept, "session_id") == [("a",)] and rows_of(ahead, "session_id") == [("b",)]


def test_streams_keep_their_state_in_rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.unset(key)
    events = m.enrich(A.as_raw(A.event_stream(spark, SF_SMALL)))
    m.kpi_stream(events, "1 hour")
    assert "RocksDB" in spark.conf.get(key)


def test_detection_behind_state_plans_adaptively(spark, tmp_path, monkeypatch):
    from checks.queries import stream_detect_all
    from millrace.streaming import detect

    seen, write = [], detect.write_history

    def recorded(rows, *args, **options):
        seen.append(rows.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        write(rows, *args, **options)

    monkeypatch.setattr(detect, "write_history", recorded)
    stream_detect_all(spark, SF_SMALL)
    assert seen and set(seen) == {"true"}


def test_a_slice_of_messages_is_encoded_alone(spark, tmp_path, monkeypatch):
    from checks import adapter

    taken, encode = [], adapter.as_messages

    def recorded(events, *carry):
        taken.append(events.count())
        return encode(events, *carry)

    monkeypatch.setattr(adapter, "as_messages", recorded)
    monkeypatch.setattr(adapter, "ROWS_PER_FILE", 50)
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    path = str(tmp_path / "wire")
    files = adapter.message_files(spark, SF_SMALL, path)
    stored = spark.read.parquet(path)
    assert files > 1 and len(stored.inputFiles()) == files * adapter.SLICES
    assert len(taken) == adapter.SLICES
    assert sum(taken) == stored.count() == events + adapter.SLICES
    assert stored.where("value LIKE '%2711000000%'").count() == adapter.SLICES
