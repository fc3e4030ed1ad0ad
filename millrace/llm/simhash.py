"""Near duplicates by SimHash fingerprints, found through pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import mapped, stored
from millrace.llm.components import connected_components

BITS = 64
SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
# Members of a bucket compared in one step; larger buckets are compared part by part.
PART = 1024
# More buckets than fingerprints by this factor keep chance meetings rare.
SPREAD = 4
_BITS_OF_BYTE = np.unpackbits(
    np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"
).astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as a signed long.

    A-Z become lower case; words are runs without ASCII white space.  Fewer words
    than a shingle make one shingle; no words make fingerprint zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = [0, *ends[: len(parts) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)),
        dtype=np.uint64,
        count=len(starts),
    )
    columns = hashes.view(np.uint8).reshape(-1, 8)
    value = 0
    for k in range(8):
        ones = np.bincount(columns[:, k], minlength=256) @ _BITS_OF_BYTE
        for bit in np.flatnonzero(2 * ones > len(hashes)).tolist():
            value |= 1 << (8 * k + bit)
    return int(np.uint64(value).astype(np.int64))


def with_fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = SHINGLE_WORDS,
) -> DataFrame:
    """doc_id, text_hash, fp (signed long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64())],
                ["doc_id", "text_hash", "fp"],
            )

    text = F.col(text_col).cast("string")
    picked = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    return mapped(picked, run, "doc_id long, text_hash long, fp long")


def block_edges(n_blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks, as even as they can be."""
    cuts = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks_for(count: int, distance: int) -> int:
    """Blocks such that the shared ones tell ``count`` fingerprints apart.

    With ``m`` blocks, a pair within the distance agrees in at least ``m - distance``
    of them, whichever these are: each choice of that many blocks is one table.  More
    blocks make longer keys and more tables; every choice finds all pairs.
    """
    for m in range(distance + 1, BITS):
        if 2 ** (BITS * (m - distance) // m) >= SPREAD * count or m >= distance + 5:
            return m
    raise ValueError("the distance is too large")


def near_links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``distance`` bits apart.

    ``prints`` has one column fp without repeats or nulls.  Pairs meet in a table for
    each choice of shared blocks.  The members of a bucket are dealt into parts of
    bounded size and every two parts meet in a task of their own, so that no task
    holds a bucket; what is emitted of two parts is a spanning forest of their links,
    which connects the same fingerprints as all pairs would.
    """
    total = prints.count()
    blocks = block_edges(blocks_for(max(total, 1), distance))
    keys = []
    for number, chosen in enumerate(combinations(range(len(blocks)), len(blocks) - distance)):
        mask = sum(((1 << w) - 1) << a for a, w in (blocks[i] for i in chosen))
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("t"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("k")))
    members = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select(
        "key.t", "key.k", "fp"
    )
    # Stored, so that the join can split a bucket that has most of the members.
    sizes = stored(
        members.groupBy("t", "k")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("t").alias("t2"), F.col("k").alias("k2"), "n"),
        "simhash-buckets",
    )
    shared = members.join(
        sizes, (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2"))
    ).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A member of part p takes part in the meetings (p, q) and (q, p), all q.
    meetings = shared.withColumn("p", own).select(
        "t", "k", "fp", "p",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"),
    )
    meetings = meetings.select(
        "t", "k", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "fp"
    )
    dealt = meetings.repartition("t", "k", "lo", "hi").sortWithinPartitions(
        "t", "k", "lo", "hi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            fps = batch.column(4).to_numpy()
            new = np.zeros(len(fps), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(fps)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(int(c[a]) for c in cols)
                if key != last and held:
                    yield _forest(np.concatenate(held), distance)
                    held = []
                held.append(fps[a:b])
                last = key
        if held:
            yield _forest(np.concatenate(held), distance)

    return mapped(dealt, run, "a long, b long").distinct()


def _forest(fps: np.ndarray, distance: int) -> pa.RecordBatch:
    """A spanning forest of the links among some fingerprints."""
    free = np.sort(fps)
    left: list[int] = []
    right: list[int] = []
    while len(free) > 1:
        # Grow one component by whole layers; each member is compared with those not
        # yet reached only.
        layer, free = free[:1], free[1:]
        while len(layer) and len(free):
            reached = []
            for at in layer:
                near = np.bitwise_count((free ^ at).view(np.uint64)) <= distance
                if near.any():
                    found = free[near]
                    left += [int(at)] * len(found)
                    right += found.tolist()
                    reached.append(found)
                    free = free[~near]
                    if not len(free):
                        break
            layer = np.concatenate(reached) if reached else free[:0]
    return pa.RecordBatch.from_arrays(
        [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"]
    )


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE,
) -> DataFrame:
    """Group the documents whose fingerprints are linked, directly or through others.

    Result, one row per row of ``df``: doc_id, text_hash, fp (signed long),
    fingerprint (hex), component_id (the smallest doc_id that can be reached; null only if no member has
    an id).  Null and empty texts have fingerprint zero and link like any other.
    Repeated rows stay.  Other columns of ``df`` are ignored, whatever their names.
    An empty table gives an empty result.
    """
    docs = stored(with_fingerprints(df, id_col, text_col, words), "simhash-prints")
    prints = stored(
        docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct"
    )
    found = connected_components(near_links(prints.select("fp"), distance))
    joined = prints.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    # Stored, so that the join can split a component that has most of the rows.
    least = stored(
        joined.groupBy(F.col("component").alias("c")).agg(
            F.min("first_id").alias("component_id")
        ),
        "simhash-components",
    )
    named = joined.join(least, F.col("component") == F.col("c")).select(
        F.col("fp").alias("fp2"), "component_id"
    )
    return docs.join(named, F.col("fp") == F.col("fp2")).select(
        "doc_id",
        "text_hash",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
