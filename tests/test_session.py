import pytest

import millrace as m
from checks.queries import QUERIES
from checks.compare import connect, difference
from checks.oracle import ORACLE
from millrace.session import INITIAL_PARTITIONS, STREAMING_SETTINGS, use_rocksdb
from tests.conftest import SF_SMALL


@pytest.fixture
def restored(spark):
    """Put the session's settings back after a test that changes them."""
    keys = ["spark.sql.shuffle.partitions", INITIAL_PARTITIONS, *STREAMING_SETTINGS]
    before = {key: spark.conf.get(key, None) for key in keys}
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    m.configure(spark)


def test_a_foreign_session_zone_does_not_matter(restored):
    for name in ("kpi_hour", "conform_orders", "events_by_month"):
        restored.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = QUERIES[name](restored, SF_SMALL).toPandas()
        assert difference(got, connect(SF_SMALL).execute(ORACLE[name]).df()) is None


def test_chosen_partition_counts_are_left_alone(restored):
    restored.conf.unset(INITIAL_PARTITIONS)
    restored.conf.set("spark.sql.shuffle.partitions", "7")
    m.configure(restored)
    assert restored.conf.get(INITIAL_PARTITIONS, None) is None


def test_state_takes_four_partitions_a_core(restored):
    restored.conf.unset(INITIAL_PARTITIONS)
    restored.conf.set("spark.sql.shuffle.partitions", "200")
    use_rocksdb(restored)
    wanted = 4 * restored.sparkContext.defaultParallelism
    assert int(restored.conf.get("spark.sql.shuffle.partitions")) == wanted
    assert int(restored.conf.get(INITIAL_PARTITIONS)) == max(wanted, 200)


def test_state_takes_the_partitions_chosen(restored):
    restored.conf.set("spark.sql.shuffle.partitions", "7")
    use_rocksdb(restored)
    assert restored.conf.get("spark.sql.shuffle.partitions") == "7"


def test_streaming_state_in_rocksdb(restored):
    m.configure(restored, streaming=True)
    got = QUERIES["stream_buckets"](restored, SF_SMALL).toPandas()
    want = connect(SF_SMALL).execute(ORACLE["stream_buckets"]).df()
    assert difference(got, want) is None


def test_scratch_folders_are_fresh_and_shared(spark):
    one, two = m.scratch_dir(spark, "x"), m.scratch_dir(spark, "x")
    assert one != two
    shared = spark.conf.get("spark.checkpoint.dir")
    assert one.startswith(f"{shared}/x-")
