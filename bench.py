"""Wall seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables and BENCH_CPUS the number of local cores.  Each
query is written to a sink that discards its rows, so that all of them are
computed; the better of two runs counts.  Two more are timed on tables stored
beforehand: decoding stored messages, and the hourly series of a raw table of twenty
times the events.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

import millrace as m  # noqa: E402
from checks import adapter as A  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from millrace.session import ensure_shared_folder  # noqa: E402

HEADLINE = (
    "conform_records",
    "enriched_events",
    "kpi_minute",
    "kpi_hour",
    "session_funnel",
    "cart_abandonment_sessions",
    "history_upsert",
    "zscore_status",
    "zscore_backfill",
    "zscore_backfill_minute",
    "import_payload",
    "stream_kpi_hour",
)
TIMES = 20


def stored_tables(spark: SparkSession, sf_dir: str) -> dict:
    """Queries over tables written here, which their times don't include."""
    wire, raw = m.scratch_dir(spark, "wire"), m.scratch_dir(spark, "raw")
    A.messages(spark, sf_dir).write.parquet(wire)
    copies = spark.range(TIMES).withColumnRenamed("id", "copy")
    events = A.raw_events(spark, sf_dir).join(copies).selectExpr(
        "* except (copy, session_id)", "concat(session_id, '-', copy) as session_id"
    )
    m.write_raw_events(events, raw)
    return {
        "conform_stored_messages": lambda: m.conform_records(
            m.read_events(spark, fmt="parquet", streaming=False, path=wire)
        )[0],
        f"kpi_hour_x{TIMES}": lambda: m.kpi_metrics(
            m.enrich(m.read_raw_events(spark, raw)), "hour"
        ),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Call sites in error messages cost several round trips per column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_folder(spark)
    spark.range(1000).write.format("noop").mode("overwrite").save()
    seconds = {}
    chosen = sys.argv[1:] or HEADLINE
    timed = {n: (lambda n=n: QUERIES[n](spark, sf_dir)) for n in chosen}
    if not sys.argv[1:]:
        timed |= stored_tables(spark, sf_dir)
    for name, query in timed.items():
        runs = []
        for _ in range(2):
            begun = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begun)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
