import json

import pytest
from pyspark.sql import functions as F

import millrace as m
from checks import adapter as A
from checks.queries import rounded
from millrace import schemas as S
from tests.conftest import SF_SMALL, at, raw, rows_of


STATS = ("metric_value", "z_score", "mean_value", "stdev_value")


@pytest.fixture(scope="module")
def raw_table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    path, quarantine = str(folder / "raw"), str(folder / "quarantine")
    m.load_job(A.messages(spark, SF_SMALL), path, quarantine)
    rejected = spark.read.parquet(quarantine).count()
    assert rejected + m.read_raw_events(spark, path).count() == 1000
    assert rejected > 0
    return path


def test_kpi_job_stores_and_exports_the_same_points(spark, raw_table, tmp_path):
    history, lines, status = (str(tmp_path / n) for n in ("h", "l", "s"))
    for _ in range(2):
        m.kpi_job(
            spark,
            raw_table,
            history,
            as_of="2024-01-20 12:30:00",
            lookback="24 hours",
            bucket="hour",
            import_path=lines,
            sender=lambda documents: [None] * len(documents),
            status_path=status,
        )
    points = rows_of(m.read_history(spark, history), "metric_name", "metric_value")
    sent = [json.loads(r["value"]) for r in spark.read.text(lines).collect()]
    assert len(points) > 10 and len(sent) == 2 * len(points)
    exported = sorted({(d["metric"]["__name__"], d["values"][0]) for d in sent})
    assert exported == sorted(set(points))
    assert spark.read.parquet(status).where("delivered").count() == len(sent)


def test_the_oldest_bucket_of_a_run_is_whole(spark, raw_table, tmp_path):
    history = str(tmp_path / "h")
    m.kpi_job(
        spark, raw_table, history, "2024-01-20 12:30:00", lookback="6 hours", bucket="hour"
    )
    whole = m.kpi_metrics(m.enrich(m.read_raw_events(spark, raw_table)), "hour")
    oldest = F.col("timestamp") == F.lit("2024-01-20 06:00:00").cast("timestamp")
    columns = ("metric_name", "metric_value")
    got = rows_of(m.read_history(spark, history).where(oldest), *columns)
    assert got == rows_of(whole.where(oldest), *columns)


def test_detection_job_counts_new_anomalies_only(spark, raw_table, tmp_path):
    history, anomalies = str(tmp_path / "h"), str(tmp_path / "a")
    as_of = "2024-01-20 12:30:00"
    m.kpi_job(spark, raw_table, history, as_of, lookback="72 hours", bucket="hour")
    options = {"lookback": "48 hours", "threshold": 0.01}
    found = m.detection_job(spark, history, anomalies, as_of, **options)
    assert found > 0
    assert m.detection_job(spark, history, anomalies, as_of, **options) == 0
    assert m.read_anomalies(spark, anomalies).count() == found


def test_append_mode_gives_the_same_detection(spark, raw_table, tmp_path):
    paths = {mode: str(tmp_path / mode) for mode in ("upsert", "append")}
    for as_of in ("2024-01-20 11:30:00", "2024-01-20 12:30:00"):
        for mode, path in paths.items():
            m.kpi_job(
                spark, raw_table, path, as_of, lookback="72 hours", bucket="hour", mode=mode
            )
    upserted = m.read_history(spark, paths["upsert"])
    appended = m.read_history(spark, paths["append"], deduplicate=True)
    assert m.read_history(spark, paths["append"]).count() > upserted.count()
    options = {"lookback": "48 hours", "with_status": True}
    # Sums of doubles depend on task order in their last digit.
    reports = [
        rows_of(rounded(m.detect_anomalies(h, "2024-01-20 12:30:00", **options), *STATS))
        for h in (upserted, appended)
    ]
    assert len(reports[0]) == 3 and reports[0] == reports[1]


def test_a_sender_needs_somewhere_to_report(spark, raw_table, tmp_path):
    with pytest.raises(ValueError, match="status_path"):
        m.kpi_job(spark, raw_table, str(tmp_path), "2024-01-20", sender=list)


def test_every_stored_schema(spark, raw_table):
    names = m.read_raw_events(spark, raw_table).schema.fieldNames()
    assert names == [*S.RAW_EVENT_SCHEMA.fieldNames(), S.MONTH]


def test_product_job_feeds_the_product_metric_table(spark, raw_table, tmp_path):
    path = str(tmp_path / "product")
    for as_of in ("2024-01-15 00:00:00", "2024-01-31 00:00:00", "2024-01-31 00:00:00"):
        m.product_job(spark, raw_table, path, as_of)
    stored = m.read_history(spark, path)
    counts = rows_of(m.metric_summary(stored), "metric_name", "data_points")
    assert counts == [
        ("cart_abandonment_literal", 2), ("cart_abandonment_rate", 2),
        ("conversion_rate", 2), ("gmv", 2),
    ]
    events = m.enrich(m.read_raw_events(spark, raw_table))
    final = stored.where("metric_name = 'gmv'").agg(F.max("metric_value")).first()[0]
    assert final == m.gmv_total(events).first()["metric_value"]


def test_views_answer_ad_hoc_sql(spark, raw_table, tmp_path):
    history, product, anomalies = (str(tmp_path / n) for n in ("h", "p", "a"))
    as_of = "2024-01-20 12:30:00"
    m.kpi_job(spark, raw_table, history, as_of, lookback="72 hours", bucket="hour")
    m.product_job(spark, raw_table, product, as_of)
    m.register_views(spark, raw_table, history, product, anomalies)
    by_topic = spark.sql("SELECT _topic, count(*) FROM raw_events GROUP BY _topic")
    assert rows_of(by_topic) == rows_of(m.topic_counts(m.read_raw_events(spark, raw_table)))
    funnel = spark.sql(
        """SELECT count(DISTINCT session_id) FROM enriched_events
        WHERE service_source = 'view_service'"""
    )
    events = m.enrich(m.read_raw_events(spark, raw_table))
    assert funnel.first()[0] == m.session_funnel(events).first()["sessions_with_views"]
    assert spark.sql("SELECT count(*) FROM product_metrics").first()[0] == 4
    assert spark.sql("SELECT count(*) FROM anomalies").first()[0] == 0
    newest = spark.sql("SELECT max(timestamp) FROM historical_metrics").first()[0]
    assert newest == m.metric_span(m.read_history(spark, history)).agg(
        F.max("last_point")
    ).first()[0]


def test_detection_job_stores_status_rows(spark, raw_table, tmp_path):
    history, anomalies, status = (str(tmp_path / n) for n in ("h", "a", "s"))
    as_of = "2024-01-20 12:30:00"
    m.kpi_job(spark, raw_table, history, as_of, lookback="72 hours", bucket="hour")
    options = {"lookback": "48 hours", "threshold": 0.01, "status_path": status}
    for marked in ("anomaly", "already recorded"):
        m.detection_job(spark, history, anomalies, as_of, **options)
        rows = rows_of(spark.read.parquet(status), "metric_name", "status")
        assert len(rows) == 3 and marked in {s for _, s in rows}


def test_a_repeated_load_replaces_itself(spark, tmp_path):
    path, quarantine = str(tmp_path / "raw"), str(tmp_path / "bad")
    messages = A.messages(spark, SF_SMALL)
    for _ in range(2):
        m.load_job(messages, path, quarantine, load="one")
    once = m.read_raw_events(spark, path).count()
    assert once + m.read_quarantine(spark, quarantine).count() == 1000
    m.load_job(messages, path)
    assert m.read_raw_events(spark, path).count() == 2 * once
    before = rows_of(m.read_raw_events(spark, path))
    assert m.compact_raw_events(spark, path) == 2
    assert m.compact_raw_events(spark, path) == 0
    assert rows_of(m.read_raw_events(spark, path)) == before


def test_an_interrupted_compaction_is_finished(spark, tmp_path, monkeypatch):
    from millrace.sources.files import Folder

    path = str(tmp_path / "raw")
    for part in range(3):
        m.write_raw_events(A.raw_events(spark, SF_SMALL).where(F.col("_offset") % 3 == part), path)
    before = rows_of(m.read_raw_events(spark, path))

    def fail(self, name):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(Folder, "delete", fail)
        with pytest.raises(OSError):
            m.compact_raw_events(spark, path)
    m.compact_raw_events(spark, path)
    assert rows_of(m.read_raw_events(spark, path)) == before


def test_a_streaming_sinks_folder_is_refused(spark, tmp_path):
    path = tmp_path / "raw"
    (path / "_spark_metadata").mkdir(parents=True)
    with pytest.raises(ValueError, match="streaming file sink"):
        m.write_raw_events(A.raw_events(spark, SF_SMALL), str(path))
    with pytest.raises(ValueError, match="streaming file sink"):
        m.read_raw_events(spark, str(path))


def test_months_do_not_depend_on_the_zone(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = raw(spark, [{"timestamp": at("2024-02-01 02:00:00")}, {"timestamp": at("2024-01-31 23:59:59")}])
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        m.write_raw_events(rows, path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    stored = m.read_raw_events(spark, path)
    assert sorted(r[S.MONTH] for r in stored.collect()) == ["202401", "202402"]
    assert m.since(stored, "2024-02-01 03:00:00", "2 hours").count() == 1
