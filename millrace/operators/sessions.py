"""All-time totals kept as one mergeable row per session.

A session's state is which services it touched and what it ordered: bits that are
OR-ed and a sum.  The state is a stored table in hash buckets.  A run reads only the
loads that came since the last one and rewrites only the buckets they touch.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.enrich import enrich
from millrace.operators.history import write_history
from millrace.operators.reports import sessions_of, total_metrics
from millrace.sources.files import Folder
from millrace.sources.tables import raw_loads, read_loads

SESSION_STATE_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("touched", T.IntegerType()),
        T.StructField("session_gmv", T.DecimalType(28, 2)),
    ]
)
# Buckets of a new state.  A run rewrites whole buckets, each by a task or more.
BUCKETS = 64
_COMMITS = "_commits"
_BUCKET = "bucket"


def merge_sessions(*states: DataFrame) -> DataFrame:
    """One row per session: the services touched in any of the states, values added."""
    names = SESSION_STATE_SCHEMA.fieldNames()
    rows = states[0].select(*names)
    for state in states[1:]:
        rows = rows.unionByName(state.select(*names))
    return rows.groupBy("session_id").agg(
        F.bit_or("touched").alias("touched"),
        F.sum("session_gmv").cast(SESSION_STATE_SCHEMA["session_gmv"].dataType).alias("session_gmv"),
    )


def _commit(folder: Folder) -> dict:
    """The last commit: its number, the loads merged, and the folder of each bucket."""
    numbers = [n for n in folder.names(_COMMITS) if n.isdigit()]
    if not numbers:
        return {"number": 0, "loads": [], "buckets": {}, "count": 0}
    return json.loads(folder.read_text(f"{_COMMITS}/{max(numbers)}"))


def read_session_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The state as of the last commit."""
    buckets = _commit(Folder(spark, state_path))["buckets"]
    return _read(spark, state_path, list(buckets.values()))


def _read(spark: SparkSession, state_path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], SESSION_STATE_SCHEMA)
    paths = [f"{state_path}/{name}" for name in folders]
    return spark.read.schema(SESSION_STATE_SCHEMA).parquet(*paths)


def new_loads(spark: SparkSession, raw_path: str, merged: list[str]) -> list[str]:
    """Loads of the raw table that aren't among ``merged``, compacted ones included."""
    known = set(merged)
    fresh = []
    for name, parts in raw_loads(spark, raw_path).items():
        if name in known or (parts and known.issuperset(parts)):
            continue
        if known.intersection(parts):
            raise ValueError(
                f"load {name} holds loads read before and others: compact with the new"
                " loads kept, or build the state again in another folder"
            )
        fresh.append(name)
    return sorted(fresh)


def update_session_state(
    spark: SparkSession, raw_path: str, state_path: str, buckets: int = BUCKETS
) -> list[str]:
    """Merge the raw table's new loads into the state; returns their names.

    A commit is one file that names the merged loads and the folder of each bucket, so
    that a run counts wholly or not at all, and a load once however often it is
    repeated or the job is.  One job at a time.  ``buckets`` counts for a new state.
    """
    folder = Folder(spark, state_path)
    last = _commit(folder)
    fresh = new_loads(spark, raw_path, last["loads"])
    if not fresh:
        return []
    count = last["count"] or buckets
    number = last["number"] + 1
    name = f"run-{number:09d}"
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(count)).cast("int")
    found = sessions_of(enrich(read_loads(spark, raw_path, fresh))).persist()
    try:
        # As many as there are buckets, at most.
        touched = found.agg(F.collect_set(bucket)).first()[0]
        before = [last["buckets"][str(b)] for b in touched if str(b) in last["buckets"]]
        merged = merge_sessions(found, _read(spark, state_path, before))
        merged.withColumn(_BUCKET, bucket).hint("rebalance", _BUCKET).write.mode(
            "overwrite"
        ).partitionBy(_BUCKET).parquet(f"{state_path}/{name}")
    finally:
        found.unpersist()
    now = last["buckets"] | {str(b): f"{name}/{_BUCKET}={b}" for b in touched}
    # A merged load counts for its parts as well: both may be merged on.
    parts = raw_loads(spark, raw_path)
    known = sorted({*last["loads"], *fresh, *(p for x in fresh for p in parts.get(x, []))})
    commit = {"number": number, "loads": known, "buckets": now, "count": count}
    folder.commit_text(f"{_COMMITS}/{number:09d}", json.dumps(commit))
    for old in set(last["buckets"].values()) - set(now.values()):
        folder.delete(old)
    return fresh


def totals_job(
    spark: SparkSession,
    raw_path: str,
    state_path: str,
    product_path: str,
    as_of: str | datetime,
    buckets: int = BUCKETS,
) -> list[str]:
    """Store the all-time totals of all loads, reading only those that are new."""
    fresh = update_session_state(spark, raw_path, state_path, buckets)
    state = read_session_state(spark, state_path)
    write_history(total_metrics(state, as_of), product_path)
    return fresh
