"""Shards of equal numbers of rows that keep linked documents together."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import numbered, placed, stored

SHARDS = 40
ROUNDS = 8
# A row's size besides its text.
OVERHEAD = 16


def with_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, and the group of equal texts a row belongs to.

    The group is named by two hashes of the text, 192 bits in all, so that unequal
    texts share none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.encode(text, "UTF-8"))
    half = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g0"),
        half(1).alias("g1"),
        half(16).alias("g2"),
    )


_GROUP = ["g0", "g1", "g2"]
_GROUP_AS = [f"{c}_" for c in _GROUP]


def plan_moves(
    wanted: dict[tuple[int, int], int], free: dict[int, int]
) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many rows may move between shards so that each keeps its number of rows.

    ``wanted``: rows that gain by a move, by (from, to).  ``free``: rows of a shard
    that no link binds.  Returns the granted moves, and the moves of free rows that
    make up for them.  What a shard takes in beyond what leaves it, free rows must
    make room for; where there are too few, fewer moves into it are granted.
    """
    granted = dict(wanted)

    def surplus() -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        for (a, b), n in granted.items():
            out[a] -= n
            out[b] += n
        return out

    while True:
        # Granting less into one shard leaves more in another, so look again each time.
        over = {s: n - free.get(s, 0) for s, n in surplus().items()}
        worst = max(over, key=lambda s: (over[s], s), default=None)
        if worst is None or over[worst] <= 0:
            break
        n, a = max((n, a) for (a, b), n in granted.items() if b == worst)
        granted[a, worst] = n - min(n, over[worst])
    fill: dict[tuple[int, int], int] = defaultdict(int)
    balance = sorted(surplus().items())
    takers = [[s, -n] for s, n in balance if n < 0]
    for giver, left in ((s, n) for s, n in balance if n > 0):
        for taker in takers:
            n = min(left, taker[1])
            if n:
                fill[giver, taker[0]] += n
                taker[1] -= n
                left -= n
    return {k: n for k, n in granted.items() if n}, dict(fill)


def _homes(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """For each group of several rows, the shards that its rows move towards.

    A group moves to the shard that has most of it; one too large for a shard, to as
    many of the shards that have most of it as can hold it.  Counts combine before the
    shuffle: there is a row for each group and shard, however large the group.
    Result: the group, homes (array of shards, no longer than there are shards).
    """
    counts = rows.groupBy(*_GROUP, "shard").agg(F.count("*").alias("n"))
    # Ties are broken differently for each group, or all would move to a few shards, and
    # in each round, as the shard of the round before may have had no room.
    tie = F.xxhash64(*_GROUP, "shard", F.lit(turn))
    key = F.struct((-F.col("n")).alias("n"), tie.alias("tie"), "shard")
    return (
        counts.groupBy(*_GROUP)
        .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(key)).alias("best"))
        .where("n > 1")
        .select(
            *[F.col(c).alias(d) for c, d in zip(_GROUP, _GROUP_AS, strict=True)],
            F.slice(
                F.transform("best", lambda x: x["shard"]),
                1,
                F.ceil(F.col("n") / capacity).cast("int"),
            ).alias("homes"),
        )
    )


def _proposals(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Each row with the shard it would move to: -1 if it may go anywhere, else null
    if it is to stay.
    """
    # Stored, so that the join can split a group that has most of the rows.
    homes = stored(_homes(rows, capacity, turn), "shard-homes")
    same = [F.col(c) == F.col(d) for c, d in zip(_GROUP, _GROUP_AS, strict=True)]
    joined = rows.join(homes, same, "left")
    pick = F.pmod(F.xxhash64("row"), F.size("homes")).cast("int") + 1
    to = (
        F.when(F.col("homes").isNull(), -1)
        .when(~F.array_contains("homes", F.col("shard")), F.element_at("homes", pick))
        .alias("to")
    )
    return joined.select(*rows.columns, to)


def propagate(rows: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Balanced label propagation over rows that have a shard and a group.

    In each round, a join with the counts of its group tells every row which shard has
    most of its neighbours.  The wishes are counted by (from, to), at most shards
    squared numbers, and the driver grants as many as the quotas allow; rows without
    links fill the gaps.  Which rows go is decided by their number among equal wishes,
    which no task counts alone.  Every round leaves each shard with as many rows as it
    had.  It ends when no wish is left.
    """
    capacity = max(1, rows.count() // shards)
    for turn in range(rounds):
        proposed = stored(_proposals(rows, capacity, turn), "shard-proposals")
        able = proposed.where("to is not null")
        counted = able.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()
        granted, fill = plan_moves(
            {(r.shard, r.to): r.n for r in counted if r.to >= 0},
            {r.shard: r.n for r in counted if r.to < 0},
        )
        if not any(r.to >= 0 for r in counted):
            break
        if not granted:
            continue  # ties may fall better in the next round
        moves = [(a, b, 0, n, b) for (a, b), n in granted.items()]
        start: dict[int, int] = defaultdict(int)
        for (a, b), n in sorted(fill.items()):
            moves.append((a, -1, start[a], start[a] + n, b))
            start[a] += n
        # At most two rows for each pair of shards.
        plan = F.broadcast(
            rows.sparkSession.createDataFrame(
                moves, "from int, wish int, low long, high long, target int"
            )
        )
        turns = numbered(able, ["shard", "to"], ["row"], "place")
        chosen = (
            (F.col("shard") == F.col("from")) & (F.col("to") == F.col("wish"))
            & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
        )
        rest = [c for c in rows.columns if c != "shard"]
        moved = turns.join(plan, chosen, "left").select(
            *rest, F.coalesce("target", "shard").alias("shard")
        )
        stay = proposed.where("to is null").select(*rest, "shard")
        rows = stored(moved.union(stay), "shard-rows")
    return rows


def balanced_shards(
    df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """Put all rows into shards whose numbers of rows differ by at most one.

    Rows begin in shards by their number in a hashed order.  Then linked rows, those
    of equal texts, move together by balanced label propagation.  A group that fits a
    shard ends in one unless the quotas stand against it.  Where the same files are read
    in the same splits the result is the same.

    Result, one row per row of ``df``: doc_id, size (UTF-8 bytes plus 16), text_crc32
    (unsigned), law ("rows"), shard, slot (gapless from 0 in each shard), grown_shard
    (null under this law).  Null and empty texts are equal.  Repeated rows and rows
    without an id each get a slot of their own.  Other columns of ``df`` are ignored.
    An empty table gives an empty result.
    """
    everything = with_links(df, id_col, text_col).withColumn("all", F.lit(0))
    # Rows may be equal in all but their place, a third of the table and more.
    everything = placed(everything, "place", "shard-links")
    rows = numbered(everything, ["all"], ["doc_id", *_GROUP, "place"], "row").drop("all", "place")
    rows = stored(
        rows.withColumn("shard", F.pmod("row", F.lit(shards)).cast("int")), "shard-rows"
    )
    slots = numbered(propagate(rows, shards, rounds), ["shard"], ["row"], "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
