"""Every operator as a query over the whole test tables.

Results use only types both engines share: times without zone, doubles instead
of decimals, and the label text instead of the label map.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace as m
from checks import adapter as A
from millrace import schemas as S
from millrace.functions.time import until
from millrace.streaming.kpi import bucket_sessions_stream

Query = Callable[[SparkSession, str], DataFrame]

# Just after the last test event, and two points inside the series.
AS_OF = "2024-01-31 00:00:00"
DETECT_AS_OF = "2024-01-29 03:00:00"
EARLIER_RUN = "2024-01-20 12:30:00"
LOOKBACK = "24 hours"
LONG_LOOKBACK = "14 days"


def shared_types(df: DataFrame) -> DataFrame:
    columns: list[Column] = []
    for field in df.schema:
        kind = field.dataType.typeName()
        if field.name == "series":
            continue
        if field.name == "labels":
            columns.append(F.col("labels")["type"].alias("label_type"))
        elif kind == "timestamp":
            columns.append(F.col(field.name).cast("timestamp_ntz").alias(field.name))
        elif kind == "decimal":
            columns.append(F.col(field.name).cast("double").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(
        *[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns]
    )


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.enrich(A.raw_events(spark, sf_dir))


def _kpi(spark: SparkSession, sf_dir: str, bucket: str, **bounds) -> DataFrame:
    return m.kpi_metrics(_enriched(spark, sf_dir), bucket, **bounds)


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kpi(spark, sf_dir, "hour")


def _on_raw(operator) -> Query:
    return lambda spark, sf: shared_types(operator(A.raw_events(spark, sf)))


def _on_enriched(operator, *to_round: str) -> Query:
    return lambda spark, sf: rounded(
        shared_types(operator(_enriched(spark, sf))), *to_round
    )


def _on_hourly(operator, *to_round: str) -> Query:
    return lambda spark, sf: rounded(
        shared_types(operator(_hourly(spark, sf))), "metric_value", *to_round
    )


def _of_topic(spark: SparkSession, sf_dir: str, topic: str) -> DataFrame:
    """Decodable messages of one topic, through the per-topic parser."""
    records = A.messages(spark, sf_dir).where(F.col("topic") == topic)
    good, _ = m.parse_json(records, S.WIRE_SCHEMAS[topic])
    return good


def conform_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_types(m.conform_views(_of_topic(spark, sf_dir, S.VIEW_TOPIC)))


def conform_carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_types(m.conform_carts(_of_topic(spark, sf_dir, S.CART_TOPIC)))


def conform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_types(m.conform_orders(_of_topic(spark, sf_dir, S.ORDER_TOPIC)))


def conform_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_types(
        m.union_events(
            m.conform_views(_of_topic(spark, sf_dir, S.VIEW_TOPIC)),
            m.conform_carts(_of_topic(spark, sf_dir, S.CART_TOPIC)),
            m.conform_orders(_of_topic(spark, sf_dir, S.ORDER_TOPIC)),
        )
    )


def conform_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, _ = m.conform_records(A.messages(spark, sf_dir))
    return shared_types(wide)


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = m.conform_records(A.messages(spark, sf_dir))
    return rejected.groupBy("topic").agg(F.count("*").alias("rejected"))


def enriched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = A.orders_as_messages(A.table(spark, sf_dir, "orders"))
    wide, _ = m.conform_records(records)
    return shared_types(m.enrich(wide))


def kafka_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.to_kafka_records(A.raw_events(spark, sf_dir))


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An early KPI run that ends mid-bucket, and a later one that looks back."""
    early = m.stamp(_kpi(spark, sf_dir, "hour", as_of=EARLIER_RUN), EARLIER_RUN)
    late = m.stamp(_kpi(spark, sf_dir, "hour", since="2024-01-18 06:20:00"), AS_OF)
    return early, late


def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = _two_runs(spark, sf_dir)
    return rounded(shared_types(m.upsert_history(early, late)), "metric_value")


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two runs through the stored table."""
    path = m.scratch_dir(spark, "history")
    for run in _two_runs(spark, sf_dir):
        m.write_history(run, path)
    stored = m.read_history(spark, path)
    return rounded(shared_types(stored), "metric_value")


def raw_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events written by month and read back through a time lookback."""
    path = m.scratch_dir(spark, "raw")
    m.write_raw_events(A.raw_events(spark, sf_dir), path)
    recent = m.since(m.read_raw_events(spark, path), AS_OF, "10 days")
    return shared_types(recent)


def raw_table_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch, a stream and another batch into one table, then merged."""
    path = m.scratch_dir(spark, "raw")
    raw = A.raw_events(spark, sf_dir)
    m.write_raw_events(raw.where("_offset % 3 = 0"), path)
    m.ingest_stream(
        A.as_messages(A.event_stream(spark, sf_dir).where("event_id % 3 = 1")),
        path,
        m.scratch_dir(spark, "ingest-checkpoint"),
        trigger=None,
    ).awaitTermination()
    m.write_raw_events(raw.where("_offset % 3 = 2"), path)
    m.compact_raw_events(spark, path)
    return shared_types(m.read_raw_events(spark, path))


def _edge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return m.conform_records(A.edge_messages(A.messages(spark, sf_dir)))


def conform_edge_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_types(_edge(spark, sf_dir)[0])


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _edge(spark, sf_dir)[1]
    return rejected.groupBy("topic", S.REASON).agg(F.count("*").alias("rejected"))


def read_events_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each source, through files of envelopes."""
    path = m.scratch_dir(spark, "wire")
    A.messages(spark, sf_dir).write.parquet(path)
    sources = [
        m.read_events(spark, source, fmt="parquet", streaming=False, path=path)
        .groupBy(F.lit(source).alias("source"), "topic")
        .agg(F.count("*").alias("messages"), F.sum("offset").alias("offsets"))
        for source in (*S.TOPICS, "all")
    ]
    return m.union_events(*sources)


def history_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended, then reduced to the latest row of each point."""
    path = m.scratch_dir(spark, "history")
    for run in _two_runs(spark, sf_dir):
        m.write_history(run, path, mode="append")
    m.compact_history(spark, path)
    return rounded(shared_types(m.read_history(spark, path)), "metric_value")


def product_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time totals of two moments, stored and summarised per metric."""
    path = m.scratch_dir(spark, "product")
    events = _enriched(spark, sf_dir)
    for as_of in (EARLIER_RUN, AS_OF):
        m.write_history(m.product_metrics(until(events, as_of), as_of), path)
    summary = m.metric_summary(m.read_history(spark, path))
    return rounded(summary, "avg_value")


_STATS = ("metric_value", "z_score", "mean_value", "stdev_value")


def _detected(spark: SparkSession, sf_dir: str, with_status: bool) -> DataFrame:
    found = m.detect_anomalies(
        _hourly(spark, sf_dir),
        DETECT_AS_OF,
        lookback=LOOKBACK,
        metric_names=tuple(S.METRIC_LABELS),
        with_status=with_status,
    )
    return rounded(shared_types(found), *_STATS)


def zscore_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, with_status=False)


def zscore_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, with_status=True)


def _backfill(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return m.backfill_anomalies(_hourly(spark, sf_dir), lookback=LOOKBACK, **options)


def zscore_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shared_types(_backfill(spark, sf_dir)), *_STATS)


def zscore_backfill_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute points against a day each."""
    found = m.backfill_anomalies(_kpi(spark, sf_dir, "minute"), lookback=LOOKBACK)
    # Means over a thousand points differ in the last digits by the order of adding.
    return shared_types(found).withColumns({c: F.round(c, 4) for c in _STATS})


def zscore_backfill_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _backfill(spark, sf_dir, with_status=True)
    return rounded(shared_types(every), *_STATS)


def moments_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point judged by a backfill that resumes twice and repeats a part."""
    history, state, anomalies, status = (
        m.scratch_dir(spark, n) for n in ("history", "moments", "anomalies", "status")
    )
    m.write_history(m.stamp(_hourly(spark, sf_dir), AS_OF), history)
    span = m.read_history(spark, history).agg(F.min("timestamp"), F.max("timestamp")).first()
    if span[0] is None:
        return rounded(shared_types(_backfill(spark, sf_dir, with_status=True)), *_STATS)
    length = span[1] - span[0]
    ends = [span[0] + length / 3, span[0] + 2 * length / 3, span[1] + timedelta(days=1)]
    again = [None, None, span[0] + length / 2]
    for as_of, start in zip(ends, again, strict=True):
        m.resumed_backfill_job(
            spark, history, state, anomalies, as_of, LOOKBACK, 6,
            again_from=start, status_path=status,
        )
    runs = spark.read.parquet(status)
    latest = runs.groupBy("series", "timestamp").agg(F.max("run").alias("run"))
    every = runs.join(latest, ["series", "timestamp", "run"]).drop("run")
    return rounded(shared_types(every), *_STATS)


def moments_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest points against two weeks, of which a backfill closed most blocks."""
    history, state, backfilled, anomalies, status = (
        m.scratch_dir(spark, n)
        for n in ("history", "moments", "backfilled", "anomalies", "status")
    )
    m.write_history(m.stamp(_hourly(spark, sf_dir), AS_OF), history)
    closed = "2024-01-27 05:00:00"
    m.resumed_backfill_job(spark, history, state, backfilled, closed, LOOKBACK, 6)
    m.detection_job(
        spark, history, anomalies, DETECT_AS_OF, LONG_LOOKBACK,
        status_path=status, moments_path=state,
    )
    found = spark.read.parquet(status).drop("as_of")
    return rounded(shared_types(found), *_STATS)


def new_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _backfill(spark, sf_dir)
    recorded = found.where(F.col("timestamp") < F.lit(EARLIER_RUN).cast("timestamp"))
    return rounded(shared_types(m.new_only(found, recorded)), *_STATS)


def anomaly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies stored twice over: the second write must add nothing."""
    path = m.scratch_dir(spark, "anomalies")
    found = _backfill(spark, sf_dir)
    m.write_anomalies(found, path)
    m.write_anomalies(found, path)
    return rounded(shared_types(m.read_anomalies(spark, path)), *_STATS)


def anomaly_table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label sets of each metric; the second write adds what the first left out."""
    path = m.scratch_dir(spark, "anomalies")
    events = _enriched(spark, sf_dir)
    group = lambda g: F.map_concat(
        "labels", F.create_map(F.lit("group"), F.lit(str(g)))
    )
    metrics = m.union_events(
        *[
            m.kpi_metrics(events.where(F.col("user_id") % 2 == g), "hour").withColumn(
                "labels", group(g)
            )
            for g in (0, 1)
        ]
    )
    found = m.backfill_anomalies(
        metrics, lookback=LOOKBACK, series_key=("metric_name", "labels")
    )
    of_group = F.get_json_object(F.get_json_object("series", "$.labels"), "$.group")
    m.write_anomalies(found.where(of_group == "0"), path)
    m.write_anomalies(found, path)
    stored = m.read_anomalies(spark, path).withColumn("label_group", of_group)
    return rounded(shared_types(stored), *_STATS)


def recorded_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every point when the anomalies up to the early run are stored."""
    every = _backfill(spark, sf_dir, with_status=True)
    recorded = every.where(
        (F.col("status") == "anomaly")
        & (F.col("timestamp") < F.lit(EARLIER_RUN).cast("timestamp"))
    )
    marked = m.mark_recorded(every, recorded)
    return marked.groupBy("metric_name", "status").agg(F.count("*").alias("points"))


def import_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = m.import_payload(_hourly(spark, sf_dir))
    return shared_types(points.select("metric_name", "timestamp", "payload"))


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import documents, stored as lines and read back."""
    path = m.scratch_dir(spark, "lines")
    m.write_import_lines(_hourly(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "payload")


def check_documents(documents):
    """A sender that sends nothing: it rejects documents of negative value."""
    return ["negative" if '"values":[-' in d else None for d in documents]


def delivery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.delivery_report(m.publish(_hourly(spark, sf_dir), check_documents))


def stream_kpi_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = m.enrich(A.as_raw(A.event_stream(spark, sf_dir)))
    return rounded(
        shared_types(_drained(m.kpi_stream(events, "1 hour"), "kpi")), "metric_value"
    )


def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = m.enrich(A.as_raw(A.event_stream(spark, sf_dir)))
    return shared_types(_drained(bucket_sessions_stream(events, "1 hour"), "buckets"))


def _drained(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path = m.scratch_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", m.scratch_dir(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = m.scratch_dir(spark, "ingest")
    m.ingest_stream(
        A.as_messages(A.event_stream(spark, sf_dir)),
        path,
        m.scratch_dir(spark, "ingest-checkpoint"),
        trigger=None,
    ).awaitTermination()
    return shared_types(m.read_raw_events(spark, path))


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = m.scratch_dir(spark, "quarantine")
    records = A.as_messages(A.event_stream(spark, sf_dir))
    m.quarantine_stream(
        records, path, m.scratch_dir(spark, "quarantine-checkpoint"), trigger=None
    ).awaitTermination()
    rejected = m.read_quarantine(spark, path)
    return shared_types(rejected.drop("partition", S.REASON))


def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed buckets into the history, outliers into the anomaly table."""
    history, anomalies = (m.scratch_dir(spark, n) for n in ("history", "anomalies"))
    events = m.enrich(A.as_raw(A.event_stream(spark, sf_dir)))
    m.detect_stream(
        m.kpi_stream(events, "1 hour"),
        history,
        anomalies,
        m.scratch_dir(spark, "detect-checkpoint"),
        bucket="1 hour",
        lookback=LOOKBACK,
        threshold=0.5,
        trigger=None,
    ).awaitTermination()
    return rounded(shared_types(m.read_anomalies(spark, anomalies)), *_STATS)


def _message_stream(
    spark: SparkSession, sf_dir: str, backwards: bool = False
) -> DataFrame:
    """Events decoded from a stream of several micro-batches, some rows late."""
    path = m.scratch_dir(spark, "wire")
    files = A.message_files(spark, sf_dir, path, backwards)
    records = m.read_events(
        spark, fmt="parquet", path=path, maxFilesPerTrigger=str(files)
    )
    return m.enrich(m.conform_records(records)[0])


def stream_kpi_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = m.kpi_stream(_message_stream(spark, sf_dir), "1 hour")
    return rounded(shared_types(_drained(series, "kpi")), "metric_value")


def stream_detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every closed bucket of every micro-batch judged."""
    history, anomalies = (m.scratch_dir(spark, n) for n in ("history", "anomalies"))
    m.detect_stream(
        m.kpi_stream(_message_stream(spark, sf_dir), "1 hour"),
        history,
        anomalies,
        m.scratch_dir(spark, "detect-checkpoint"),
        bucket="1 hour",
        lookback=LOOKBACK,
        trigger=None,
        every_bucket=True,
    ).awaitTermination()
    return rounded(shared_types(m.read_anomalies(spark, anomalies)), *_STATS)


def _open_buckets(spark: SparkSession, sf_dir: str, backwards: bool) -> DataFrame:
    sessions, history = (m.scratch_dir(spark, n) for n in ("sessions", "history"))
    m.open_bucket_stream(
        _message_stream(spark, sf_dir, backwards),
        sessions,
        history,
        m.scratch_dir(spark, "open-checkpoint"),
        bucket="1 hour",
        trigger=None,
    ).awaitTermination()
    stored = m.read_history(spark, history).select(*S.METRIC_SCHEMA.fieldNames())
    return rounded(shared_types(stored), "metric_value")


def stream_open_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history that every micro-batch brings up to date, open hours included."""
    return _open_buckets(spark, sf_dir, backwards=False)


def late_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, the newest messages first: all others are days late."""
    return _open_buckets(spark, sf_dir, backwards=True)


def product_totals_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-time totals after three loads, a repeated one and a compaction."""
    raw_path, state, product = (m.scratch_dir(spark, n) for n in ("raw", "state", "product"))
    raw = A.raw_events(spark, sf_dir)
    for load in (0, 1, 0):
        m.write_raw_events(raw.where(F.col("_offset") % 3 == load), raw_path, f"load-{load}")
        m.totals_job(spark, raw_path, state, product, AS_OF, buckets=8)
    m.compact_raw_events(spark, raw_path)
    m.write_raw_events(raw.where(F.col("_offset") % 3 == 2), raw_path, "load-2")
    m.totals_job(spark, raw_path, state, product, AS_OF, buckets=8)
    stored = m.read_history(spark, product)
    return rounded(shared_types(stored.drop(S.MONTH)), "metric_value")


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sessions of hours, days and all time, from stored bitmaps of minutes."""
    path = m.scratch_dir(spark, "minutes")
    events = _enriched(spark, sf_dir)
    numbers = m.number_sessions(events, m.scratch_dir(spark, "numbers"))
    m.session_bitmaps(events, numbers, "minute").write.parquet(path)
    minutes = spark.read.parquet(path)
    units = [
        m.roll_up_bitmaps(minutes, bucket).withColumn("unit", F.lit(bucket or "all"))
        for bucket in ("hour", "day", None)
    ]
    return shared_types(m.union_events(*units))


def redelivered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping loads, one of them repeated: each message is stored once."""
    raw, offsets = m.scratch_dir(spark, "raw"), m.scratch_dir(spark, "offsets")
    records = A.messages(spark, sf_dir)
    for load, taken in (
        ("a", "offset % 3 <> 2"), ("b", "offset % 3 <> 0"), ("a", "offset % 3 <> 2"), ("c", "true")
    ):
        given = records.where(taken)
        m.load_job(given.union(given), raw, load=load, offsets_path=offsets)
    return shared_types(m.read_raw_events(spark, raw))


def redelivered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a stream gets twice."""
    path = m.scratch_dir(spark, "ingest")
    once = A.as_messages(A.event_stream(spark, sf_dir))
    m.ingest_stream(
        once.union(A.as_messages(A.event_stream(spark, sf_dir))),
        path,
        m.scratch_dir(spark, "ingest-checkpoint"),
        trigger=None,
        redelivery="1 day",
    ).awaitTermination()
    return shared_types(m.read_raw_events(spark, path))


def offset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes in the offsets of each topic, which the topics share between them."""
    return m.offset_gaps(A.messages(spark, sf_dir))


def next_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = m.scratch_dir(spark, "offsets")
    records = A.messages(spark, sf_dir)
    m.write_offsets(records.where("offset % 2 = 0"), path, "even")
    m.write_offsets(records.where("offset % 2 = 1"), path, "odd")
    return m.next_offsets(m.read_offsets(spark, path))


def no_negatives(documents):
    return ["negative" if '"values":[-' in d else None for d in documents]


def not_far_below(documents):
    return [
        "too small" if json.loads(d)["values"][0] <= -1 else None for d in documents
    ]


def delivery_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that fail in part, one between them too early for a retry, and a last."""
    outbox, attempts = m.scratch_dir(spark, "outbox"), m.scratch_dir(spark, "attempts")
    m.enqueue(_hourly(spark, sf_dir), outbox)
    m.enqueue(_hourly(spark, sf_dir), outbox)
    limits = {"max_attempts": 3, "backoff": "1 minute"}
    for minute, sender in (
        ("00:00", no_negatives), ("00:30", not_far_below), ("01:00", no_negatives),
        ("09:00", not_far_below),
    ):
        m.delivery_job(spark, outbox, attempts, sender, f"2024-01-31 00:{minute}", **limits)
    return m.ledger_report(m.read_outbox(spark, outbox, attempts, **limits))


def wire_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of all messages, some of which say more than their schema knows."""
    value, offset = F.col("value"), F.col("offset")
    rest = F.substring("value", F.lit(2), F.length("value") - 1)
    more = (
        F.when(offset % 11 == 0, F.concat(F.lit('{"campaign":"spring",'), rest))
        .when(offset % 13 == 0, F.concat(F.lit('{"debug":true,"tags":[1],'), rest))
        .otherwise(value)
    )
    return m.field_profile(A.messages(spark, sf_dir).withColumn("value", more))


def panel_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hourly series on a grid of 20 minutes, points shown for 100 minutes."""
    shown = m.panel_steps(
        _hourly(spark, sf_dir), "2024-01-01 00:10:00", AS_OF, "20 minutes", "100 minutes"
    )
    return rounded(shared_types(shown), "metric_value")


def funnel_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel of a table hashed by session."""
    path = m.scratch_dir(spark, "by-session")
    name = "events_" + path.rpartition("-")[2]
    funnel = m.session_funnel(m.write_by_session(_enriched(spark, sf_dir), name, path, 8))
    return rounded(
        shared_types(funnel), "view_to_cart_rate", "cart_to_order_rate", "conversion_rate"
    )


def _series(metric_name: str) -> Query:
    return lambda spark, sf: rounded(
        shared_types(
            m.metric_series(
                m.bucket_sessions(_enriched(spark, sf), "hour"), metric_name
            )
        ),
        "metric_value",
    )


QUERIES: dict[str, Query] = {
    # Conform
    "conform_views": conform_views,
    "conform_carts": conform_carts,
    "conform_orders": conform_orders,
    "conform_union": conform_union,
    "conform_records": conform_records,
    "conform_edge_messages": conform_edge_messages,
    "quarantine_counts": quarantine_counts,
    "quarantine_reasons": quarantine_reasons,
    "raw_events": _on_raw(lambda raw: raw),
    "events_by_month": _on_raw(m.events_by_month),
    "topic_counts": _on_raw(m.topic_counts),
    "raw_event_table": raw_event_table,
    "raw_table_two_writers": raw_table_two_writers,
    # Enrich
    "enriched_events": _on_enriched(lambda e: e),
    "enriched_orders": enriched_orders,
    "event_source_counts": _on_enriched(m.event_source_counts),
    # KPIs
    "bucket_sessions_hour": _on_enriched(lambda e: m.bucket_sessions(e, "hour")),
    "conversion_series": _series(S.CONVERSION),
    "abandonment_series": _series(S.ABANDONMENT),
    "gmv_series": _series(S.GMV),
    "kpi_minute": lambda spark, sf: rounded(
        shared_types(_kpi(spark, sf, "minute")), "metric_value"
    ),
    "kpi_hour": lambda spark, sf: rounded(
        shared_types(_hourly(spark, sf)), "metric_value"
    ),
    "kpi_closed_hours": lambda spark, sf: rounded(
        shared_types(
            _kpi(
                spark,
                sf,
                "hour",
                since="2024-01-02 10:40:00",
                as_of=EARLIER_RUN,
                include_open_bucket=False,
            )
        ),
        "metric_value",
    ),
    # Reports
    "session_funnel": _on_enriched(
        m.session_funnel, "view_to_cart_rate", "cart_to_order_rate", "conversion_rate"
    ),
    "conversion_rate_total": _on_enriched(m.conversion_rate_total, "metric_value"),
    "cart_abandonment_literal": _on_enriched(
        m.cart_abandonment_literal, "metric_value"
    ),
    "cart_abandonment_sessions": _on_enriched(
        m.cart_abandonment_sessions, "abandonment_rate"
    ),
    "gmv_total": _on_enriched(m.gmv_total, "metric_value"),
    "product_metrics": _on_enriched(
        lambda e: m.product_metrics(e, AS_OF), "metric_value"
    ),
    "product_metric_table": product_metric_table,
    "metric_summary": _on_hourly(m.metric_summary, "avg_value"),
    "metric_span": _on_hourly(m.metric_span),
    "recent_points": _on_hourly(lambda h: m.recent_points(h, AS_OF, "5 hours")),
    "latest_points": _on_hourly(m.latest_points),
    "series_range": _on_hourly(
        lambda h: m.series_range(
            h, S.CONVERSION, "2024-01-10 00:00:00", "2024-01-12 00:00:00"
        )
    ),
    "panel_steps": panel_steps,
    "funnel_by_session": funnel_by_session,
    "wire_field_profile": wire_field_profile,
    "panel_series": _on_hourly(lambda h: m.panel_series(h, AS_OF, "12 hours")),
    # History
    "history_upsert": history_upsert,
    "history_table": history_table,
    "history_compacted": history_compacted,
    # Outliers
    "zscore_latest": zscore_latest,
    "zscore_status": zscore_status,
    "zscore_backfill": zscore_backfill,
    "zscore_backfill_minute": zscore_backfill_minute,
    "zscore_backfill_status": zscore_backfill_status,
    "moments_backfill": moments_backfill,
    "moments_latest": moments_latest,
    "new_anomalies": new_anomalies,
    "anomaly_table": anomaly_table,
    "anomaly_table_labels": anomaly_table_labels,
    "recorded_status": recorded_status,
    # Export
    "import_payload": import_payload,
    "import_lines": import_lines,
    "delivery_report": delivery_report,
    "kafka_records": kafka_records,
    "read_events_files": read_events_files,
    # Streaming
    "stream_ingest": stream_ingest,
    "stream_quarantine": stream_quarantine,
    "stream_buckets": stream_buckets,
    "stream_kpi_hour": stream_kpi_hour,
    "stream_kpi_batches": stream_kpi_batches,
    "stream_open_buckets": stream_open_buckets,
    "late_repair": late_repair,
    "redelivered_messages": redelivered_messages,
    "redelivered_stream": redelivered_stream,
    "offset_gaps": offset_gaps,
    "next_offsets": next_offsets,
    "product_totals_incremental": product_totals_incremental,
    "session_rollup": session_rollup,
    "delivery_retries": delivery_retries,
    "stream_detect": stream_detect,
    "stream_detect_all": stream_detect_all,
}
