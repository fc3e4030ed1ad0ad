"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import scratch_dir


# Bytes of texts that a Python worker gets at once, instead of Spark's own 64 MB.
BATCH_BYTES = 4 << 20
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = "67108864b"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    Cuts the lineage: what follows survives the loss of any executor without
    computing the rows once more, and is computed once however often it is read.
    """
    path = scratch_dir(df.sparkSession, purpose)
    _bound_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of two longs that may be broadcast: 8 MB.
BROADCAST_ROWS = 500_000


def _bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BYTES_PER_BATCH) == _SPARKS_OWN:
        spark.conf.set(_BYTES_PER_BATCH, BATCH_BYTES)


# What this Python worker remembers between tasks, by the module that does.
_remembered: dict[str, functools._lru_cache_wrapper] = {}


def remembered(make: Callable) -> Callable:
    """What ``make`` gives, kept by a Python worker between tasks of the same operator.

    A worker outlives an operator: the first task of another one forgets it.
    """
    kept = functools.lru_cache(maxsize=1)(make)
    _remembered[make.__module__] = kept
    return kept


def _forget_others(operator: str) -> None:
    for name, kept in _remembered.items():
        if name != operator:
            kept.cache_clear()


def _give_back() -> None:
    """Hand memory that is free, but held by the allocators, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of a bounded size, unless the user chose one.

    Workers stay and are used again, by other operators too: a task begins and ends
    without what tasks before it or itself have left behind.
    """
    _bound_batches(df.sparkSession)
    operator = run.__module__

    def in_room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_others(operator)
        _give_back()
        yield from run(batches)
        _give_back()

    return df.mapInArrow(in_room, schema)


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and text hash aren't in ``gone`` (doc_id, text_hash).

    A null id equals a null id.  ``gone`` is broadcast if it is counted to be small;
    else both sides are shuffled.
    """
    return _matched_rows(df, gone, id_col, text_col, "left_anti")


def only_rows(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and text hash are in ``kept``, as in ``without_rows``."""
    return _matched_rows(df, kept, id_col, text_col, "left_semi")


def _matched_rows(
    df: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str
) -> DataFrame:
    rows = stored(
        rows.select(F.col("doc_id").alias("_row_id"), F.col("text_hash").alias("_row_text"))
        .distinct(),
        "rows",
    )
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    matched = df[id_col].cast("long").eqNullSafe(rows["_row_id"]) & (
        F.xxhash64(df[text_col].cast("string")) == rows["_row_text"]
    )
    return df.join(rows, matched, how)


def drawn(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """About ``limit`` of the rows, chosen by a hash of their id; all if there are fewer.

    Each row is kept or not by itself, so that nothing is sorted or gathered: the
    number kept is ``limit`` up to chance, a few of its square root.  Rows without an
    id are left out.
    """
    total = df.count()
    kept = df.where(F.col(id_col).isNotNull())
    return kept if total <= limit else kept.where(
        F.pmod(F.xxhash64(id_col), F.lit(total)) < limit
    )


# Rows that one window of ``numbered`` sorts.
PART_ROWS = 1_000_000


def placed(df: DataFrame, name: str, purpose: str) -> DataFrame:
    """The rows stored with a number each, unlike any other's but not without gaps.

    The numbers follow how the rows lie in tasks; being stored, they stay what they
    are whatever is computed again.
    """
    return stored(df.withColumn(name, F.monotonically_increasing_id()), purpose)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, with no task holding a key.

    Rows are dealt by a hash of ``order`` into parts; each part numbers its own rows
    of a key, and the counts of the parts before it are added.  The order within a
    key is by part, then by ``order``.  No two rows may be equal in ``order``: they
    would share a part, however many there are (see ``placed``).  ``df`` is stored, as
    it is counted first; there are parts enough for the session's shuffle partitions,
    and for all rows at about ``PART_ROWS`` each.
    """
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(4 * shuffled, -(-df.count() // PART_ROWS))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_k_part"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = dealt.withColumn("_row", F.row_number().over(within) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    matched = ranked.join(offsets, [*on, F.col("_part") == F.col("_k_part")])
    return matched.select(
        *[F.col(c) for c in df.columns],
        (F.col("_before") + F.col("_row")).cast("long").alias(name),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
