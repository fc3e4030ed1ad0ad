"""Mergeable state, ledgers and open buckets: what repeated and partial runs leave."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import millrace as m
from checks import adapter as A
from millrace import schemas as S
from millrace.operators import sessions
from millrace.operators.delivery import outbox_state
from millrace.operators.reports import sessions_of, total_metrics
from millrace.sources import files, tables
from tests.conftest import CART, ORDER, SF_SMALL, VIEW, at, points, raw, rows_of, session_rows

AS_OF = "2024-01-31 00:00:00"


def totals(df):
    return rows_of(df, "metric_name", "metric_value")


# --- Session state ---------------------------------------------------------------
def test_totals_read_new_loads_only(spark, tmp_path, monkeypatch):
    path, state, product = (str(tmp_path / n) for n in ("raw", "state", "product"))
    read = []
    monkeypatch.setattr(
        sessions, "read_loads",
        lambda spark, path, loads: read.append(loads) or tables.read_loads(spark, path, loads),
    )
    loads = {
        "a": session_rows("s1", VIEW, CART) + session_rows("s2", VIEW, time="2024-02-03 00:00:00"),
        "b": session_rows("s1", ORDER) + session_rows("s3", CART),
        "c": session_rows("s2", ORDER, ORDER, time="2024-02-05 00:00:00"),
    }
    given = []
    for name, rows in loads.items():
        given += rows
        m.write_raw_events(raw(spark, rows), path, name)
        assert m.totals_job(spark, path, state, product, AS_OF, buckets=4) == [name]
        whole = total_metrics(sessions_of(m.enrich(raw(spark, given))), AS_OF)
        found = total_metrics(m.read_session_state(spark, state), AS_OF)
        assert totals(found) == totals(whole)
    assert read == [["a"], ["b"], ["c"]]
    # Such a read is limited to the load's folders before any file is opened.
    plan = tables.read_loads(spark, path, ["b"])._jdf.queryExecution().executedPlan()
    assert f"{S.LOAD}" in plan.toString().partition("PartitionFilters: [")[2].partition("]")[0]
    # Repeated loads and compacted ones add nothing.
    m.write_raw_events(raw(spark, loads["b"]), path, "b")
    assert m.update_session_state(spark, path, state) == []
    m.compact_raw_events(spark, path)
    assert m.update_session_state(spark, path, state) == []
    m.write_raw_events(raw(spark, session_rows("s9", VIEW)), path, "d")
    assert m.update_session_state(spark, path, state) == ["d"]
    m.compact_raw_events(spark, path)
    assert m.update_session_state(spark, path, state) == []
    assert m.read_session_state(spark, state).count() == 4


def test_a_run_cut_short_before_its_commit_counts_nothing(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path / "raw"), str(tmp_path / "state")
    m.write_raw_events(raw(spark, session_rows("s", VIEW, ORDER)), path, "a")
    m.update_session_state(spark, path, state)
    m.write_raw_events(raw(spark, session_rows("s", ORDER)), path, "b")
    with monkeypatch.context() as broken:
        broken.setattr(files.Folder, "commit_text", lambda *a: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            m.update_session_state(spark, path, state)
    value = lambda: m.read_session_state(spark, state).first().session_gmv
    assert value() == Decimal("10.00")
    assert m.update_session_state(spark, path, state) == ["b"]
    assert value() == Decimal("20.00")


def test_a_load_compacted_with_new_ones_is_refused(spark, tmp_path):
    path, state = str(tmp_path / "raw"), str(tmp_path / "state")
    m.write_raw_events(raw(spark, session_rows("s", VIEW)), path, "a")
    m.update_session_state(spark, path, state)
    m.write_raw_events(raw(spark, session_rows("t", VIEW)), path, "b")
    m.compact_raw_events(spark, path)
    with pytest.raises(ValueError, match="compact with"):
        m.update_session_state(spark, path, state)


def test_merged_states_equal_one(spark):
    rows = [session_rows(f"s{i % 5}", (VIEW, CART, ORDER)[i % 3]) for i in range(40)]
    flat = [r for part in rows for r in part]
    parts = [sessions_of(m.enrich(raw(spark, flat[i::3]))) for i in range(3)]
    whole = m.merge_sessions(sessions_of(m.enrich(raw(spark, flat))))
    assert rows_of(m.merge_sessions(*parts)) == rows_of(whole)


# --- Compaction ------------------------------------------------------------------
def test_a_compaction_killed_anywhere_doubles_and_loses_nothing(spark, tmp_path, monkeypatch):
    """Fails at each call that changes a folder, and at each write, in turn."""
    rows = session_rows("s", VIEW, CART) + session_rows("t", ORDER, time="2024-02-03 00:00:00")
    calls = {"left": 0}

    def failing(function):
        def run(*args, **kwargs):
            if calls["left"] == 0:
                raise OSError("killed")
            calls["left"] -= 1
            return function(*args, **kwargs)

        return run

    def after(function):
        """Killed after the work, before anything else."""
        def run(*args, **kwargs):
            done = function(*args, **kwargs)
            if calls["left"] == 0:
                raise OSError("killed")
            calls["left"] -= 1
            return done

        return run

    killed = 0
    for kind in (failing, after):
        for step in range(60):
            path = str(tmp_path / f"{kind.__name__}-{step}")
            for load in "abc":
                m.write_raw_events(raw(spark, rows), path, load)
            want = rows_of(m.read_raw_events(spark, path))
            calls["left"] = step
            with monkeypatch.context() as broken:
                for name in ("delete", "write_text", "commit_text"):
                    broken.setattr(files.Folder, name, kind(getattr(files.Folder, name)))
                broken.setattr(tables, "write_raw_events", kind(tables.write_raw_events))
                try:
                    m.compact_raw_events(spark, path)
                    break
                except OSError:
                    killed += 1
            assert rows_of(m.read_raw_events(spark, path)) == want
            m.compact_raw_events(spark, path)
            assert rows_of(m.read_raw_events(spark, path)) == want
            assert len(tables.raw_loads(spark, path)) == 2
        else:
            raise AssertionError("never ended")
    assert killed > 15


# --- Offsets ---------------------------------------------------------------------
def envelopes(spark, offsets, topic=S.VIEW_TOPIC, partition=0):
    rows = [("k", json.dumps({"event_type": "page_view", "user_id": 1}), topic, partition, o,
             at("2024-01-01 00:00:00")) for o in offsets]
    return spark.createDataFrame(rows, S.RECORD_SCHEMA)


def test_offsets_of_several_blocks(spark, tmp_path):
    path = str(tmp_path / "offsets")
    loaded = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 10**12]
    m.write_offsets(envelopes(spark, loaded), path, "a")
    m.write_offsets(envelopes(spark, [5], partition=1), path, "b")
    held = m.read_offsets(spark, path)
    given = sorted({o + d for o in loaded for d in (-1, 0, 1) if o + d >= 0})
    twice = envelopes(spark, given + given)
    found = [r.offset for r in m.fresh_records(twice, held).collect()]
    assert sorted(found) == sorted(set(given) - set(loaded))
    assert json.loads(m.starting_offsets(held)) == {S.VIEW_TOPIC: {"0": 10**12 + 1, "1": 6}}
    # The same load again isn't held against itself.
    own = m.read_offsets(spark, path, without="a")
    assert m.fresh_records(envelopes(spark, loaded), own).count() == len(loaded)


def test_messages_without_an_offset_all_stay(spark):
    held = m.read_offsets(spark, "/tmp/no-such-folder-of-offsets")
    assert m.fresh_records(envelopes(spark, [None, None, 3, 3]), held).count() == 3


def test_gaps_and_repeats(spark):
    seen = [3, 4, 4, 9, 65535, 65536, 65540, 300_000, None]
    records = envelopes(spark, seen).union(envelopes(spark, [1, 2], partition=1))
    gaps = rows_of(m.offset_gaps(records), "partition", "gap_start", "gap_end", "missing")
    assert gaps == sorted(
        [(0, 5, 8, 4), (0, 10, 65534, 65525), (0, 65537, 65539, 3), (0, 65541, 299_999, 234_459)],
        key=repr,
    )
    assert rows_of(m.offset_repeats(records), "offset", "deliveries") == [(4, 2)]
    assert m.offset_gaps(records.limit(0)).count() == 0


def test_a_load_with_offsets_needs_a_name(spark, tmp_path):
    with pytest.raises(ValueError, match="name the load"):
        m.load_job(envelopes(spark, [1]), str(tmp_path / "raw"), offsets_path=str(tmp_path / "o"))


# --- Open buckets ----------------------------------------------------------------
def test_a_bucket_shows_while_it_fills(spark, tmp_path):
    wire, partial, history, checkpoint = (
        str(tmp_path / n) for n in ("wire", "sessions", "history", "checkpoint")
    )
    schema = S.RAW_EVENT_SCHEMA
    steps = [
        session_rows("s1", VIEW) + session_rows("s2", VIEW, CART),
        session_rows("s1", ORDER, time="2024-01-01 00:00:30"),
        # Later hours, and then a row that is days late.
        session_rows("s3", VIEW, ORDER, time="2024-01-05 07:00:00"),
        session_rows("s2", ORDER, time="2024-01-01 00:00:59"),
    ]
    conversion = []
    for rows in steps:
        raw(spark, rows).write.mode("append").parquet(wire)
        events = m.enrich(spark.readStream.schema(schema).parquet(wire))
        m.open_bucket_stream(
            events, partial, history, checkpoint, trigger=None
        ).awaitTermination()
        stored = m.read_history(spark, history)
        first = stored.where("metric_name = 'ecommerce_conversion_rate'").orderBy("timestamp")
        conversion.append(first.first().metric_value)
    assert conversion == [0.0, 0.5, 0.5, 1.0]
    whole = m.kpi_metrics(m.enrich(raw(spark, [r for s in steps for r in s])), "minute")
    columns = ["metric_name", "timestamp", "metric_value"]
    assert rows_of(m.read_history(spark, history), *columns) == rows_of(whole, *columns)
    assert m.compact_bucket_sessions(spark, partial, "20240101") == 3
    assert m.compact_bucket_sessions(spark, partial, "20240101") == 0


def bucket_rows(spark, path):
    from millrace.streaming.open_buckets import read_bucket_sessions

    merged = read_bucket_sessions(spark, path).groupBy("bucket", "session_id")
    found = merged.agg(F.bit_or("touched").alias("t"), F.sum("session_gmv").alias("v"))
    return rows_of(found)


def test_bucket_sessions_survive_a_kill_at_any_step(spark, tmp_path, monkeypatch):
    """A sum would double with a merged load beside its parts."""
    from millrace.sources.files import Folder
    from millrace.streaming import open_buckets as B

    events = m.enrich(raw(spark, session_rows("s1", VIEW, ORDER) + session_rows("s2", ORDER)))
    # Every call of a compaction, killed before it; two of them after it; and none.
    calls = {"write_text": 3, "commit_text": 1, "delete": 4, "write_load": 1}
    kills = [(name, call, False) for name, n in calls.items() for call in range(n)]
    kills += [("write_load", 0, True), ("delete", 0, True), ("write_load", 1, False)]
    ended = 0
    path = str(tmp_path / "table")
    for load in ("a", "b", "kept"):
        B.add_bucket_sessions(events, path, load, "1 minute")
    want = bucket_rows(spark, path)
    assert len(want) == 2
    for number, (name, call, late) in enumerate(kills):
        where = B if name == "write_load" else Folder
        whole, count = getattr(where, name), [0]

        def killed(*args, **kwargs):
            count[0] += 1
            if count[0] - 1 < call:
                return whole(*args, **kwargs)
            if late:
                whole(*args, **kwargs)
            raise OSError("killed")

        with monkeypatch.context() as patch:
            patch.setattr(where, name, killed)
            try:
                m.compact_bucket_sessions(spark, path, "20240101", keep=("kept",))
                ended += 1
            except OSError:
                pass
        assert bucket_rows(spark, path) == want, (name, call, late)
        m.compact_bucket_sessions(spark, path, "20240101", keep=("kept",))
        assert bucket_rows(spark, path) == want, (name, call, late)
        loads = Folder(spark, path).folders("event_day=20240101")
        assert len(loads) == 2 and f"{S.LOAD}=kept" in loads
        # An empty load, so that there is something to merge again.
        B.add_bucket_sessions(
            m.enrich(raw(spark, session_rows("s1", VIEW))), path, f"more-{number}", "1 minute"
        )
    assert ended == 1


def test_a_reader_lists_again_what_a_merge_changed(spark, tmp_path, monkeypatch):
    """A merge that ends between the listing of files and the look at its mark."""
    path = str(tmp_path / "raw")
    for user in (1, 2):
        m.write_raw_events(raw(spark, [{"user_id": user}]), path)
    listed, whole = [], tables.read_table

    def read_table(*args):
        rows = whole(*args)
        if not listed:
            listed.append(True)
            m.compact_raw_events(spark, path)
        return rows

    monkeypatch.setattr(tables, "read_table", read_table)
    assert sorted(r.user_id for r in m.read_raw_events(spark, path).collect()) == [1, 2]


# --- Rollups ---------------------------------------------------------------------
def test_rollups_equal_distinct_counts_and_sketches_come_close(spark, tmp_path):
    events = m.enrich(A.raw_events(spark, SF_SMALL)).persist()
    numbers = m.number_sessions(events, str(tmp_path / "numbers"))
    assert numbers.select("number").distinct().count() == numbers.count()
    bitmaps, sketches = m.session_bitmaps(events, numbers), m.session_sketches(events)
    counts = ["viewing_sessions", "cart_sessions", "order_sessions"]
    for bucket in ("hour", "day"):
        want = rows_of(m.bucket_sessions(events.where("service_source <> 'unknown'"), bucket), "bucket", *counts)
        assert rows_of(m.roll_up_bitmaps(bitmaps, bucket), "bucket", *counts) == want
    exact = m.roll_up_bitmaps(bitmaps).first()
    about = m.roll_up_sketches(sketches).first()
    for name in counts:
        assert exact[name] > 50
        assert abs(about[name] - exact[name]) <= 0.03 * exact[name]
    events.unpersist()


# --- Deliveries ------------------------------------------------------------------
def endpoint(refused):
    """A sender that fails by what a document says: it lives in other processes."""

    def send(documents):
        return ["no" if json.loads(d)["values"][0] in refused else None for d in documents]

    return send


def test_only_what_failed_is_sent_again(spark, tmp_path):
    outbox, attempts = str(tmp_path / "outbox"), str(tmp_path / "attempts")
    assert m.enqueue(points(spark, [1, 2, 3]), outbox) == 3
    assert m.enqueue(points(spark, [1, 2, 3, 4]), outbox) == 1
    limits = {"max_attempts": 2, "backoff": "10 minutes"}

    def report():
        row = m.ledger_report(m.read_outbox(spark, outbox, attempts, **limits)).first()
        return tuple(row)[1:]

    def run(moment, *refused):
        m.delivery_job(spark, outbox, attempts, endpoint(refused), f"2024-01-01 {moment}", **limits)
        return report()

    # points, delivered, waiting, parked, queued, attempts
    assert report() == (4, 0, 0, 0, 4, 0)
    assert run("00:00:00", 2, 3) == (4, 2, 2, 0, 0, 4)
    assert run("00:00:00", 2, 3) == (4, 2, 2, 0, 0, 4)  # repeated: replaces its attempts
    assert run("00:05:00") == (4, 2, 2, 0, 0, 4)  # too early
    assert run("00:10:00", 3) == (4, 3, 0, 1, 0, 6)  # the second time is the last
    assert run("09:00:00") == (4, 3, 0, 1, 0, 6)
    assert m.enqueue(points(spark, [1, 2, 3, 5]), outbox) == 1  # a value computed anew
    assert run("09:01:00") == (5, 4, 0, 1, 0, 7)


def test_a_sender_that_fails_whole_loses_nothing(spark, tmp_path):
    outbox, attempts = str(tmp_path / "outbox"), str(tmp_path / "attempts")
    m.enqueue(points(spark, [1, 2]), outbox)

    def broken(documents):
        raise ConnectionError("down")

    m.delivery_job(spark, outbox, attempts, broken, "2024-01-01 00:00:00")
    state = m.read_outbox(spark, outbox, attempts)
    assert rows_of(state, "status", "attempts") == [("waiting", 1), ("waiting", 1)]
    waits = outbox_state(
        state.select("point_id", "metric_name", "timestamp", "payload"),
        spark.createDataFrame(
            [(r.point_id, at("2024-01-01 00:00:00"), False, "x") for r in state.collect()] * 3,
            "point_id string, attempted_at timestamp, delivered boolean, error string",
        ), 9, "1 minute",
    )
    assert {r.due_at for r in waits.select(F.unix_seconds("due_at").alias("due_at")).collect()} == {
        int(at("2024-01-01 00:04:00").timestamp())
    }
