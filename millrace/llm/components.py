"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """Each node of ``edges`` (a long, b long) with the least node it reaches.

    Alternates two steps until no edge changes, each a grouped minimum and a join:
    every node links its larger neighbours, then its smaller ones, to the least of
    its neighbourhood.  The edges of a component become a star around its least
    node in a logarithmic number of rounds.  Every round is a table in the shared
    folder; only a count and a checksum come to the driver.  Loops and nulls are
    ignored; a node without an edge isn't returned.
    Result: node, component (long).
    """
    now = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "components",
    )
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = stored(_small_star(_large_star(now)), "components")
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(members.select("component", "component").distinct())


def _state(edges: DataFrame) -> tuple:
    # Sums of 31-bit hashes: exact, in no order, and far from overflow.
    row = edges.agg(
        F.count("*"),
        F.sum(F.hash("u", "v").cast("long")),
        F.sum(F.hash("v", "u", F.lit(1)).cast("long")),
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    # Stored, here and below, so that the join can split a hub's edges.
    least = stored(least.select("c", F.least("c", "m").alias("m")), "components-least")
    # (c, larger neighbour u) becomes (u, least of c's neighbourhood)
    return (
        edges.join(least, F.col("v") == F.col("c"))
        .select("u", F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(
        edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), "components-least"
    )
    linked = edges.join(least, F.col("u") == F.col("c"))
    rest = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("c", "m")).distinct()
