"""Prefix trie of conversations, its nodes in tables addressed by minimal perfect hashes.

A node is a distinct sequence of first turns, known by a digest of it.  Digests of all
prefixes are running exclusive-ors of position-salted hashes, so that a conversation can
be cut between tasks.  Counts of a node come from grouping equal digests.  Sums over
subtrees are accumulated in shards: the nodes of some subtrees get slots by a minimal
perfect hash, their counts are scattered into flat arrays, and each depth, deepest
first, is added to the slots of its parents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import mapped, stored

DONOR_EVERY = 20
DONOR_TURNS = 4
# Nodes that one task holds in its arrays, about.
TASK_NODES = 500_000
# Members from which on a node's subtree may be cut between tasks, and what the limit
# is multiplied by for each further level.
LIGHT = 4096
LIGHTER = 4096
# Ids of a node's conversations that are joined in one row: a range of this many bits.
CHUNK_BITS = 12
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_ODD = np.random.default_rng(13).integers(1, 1 << 62, 16, dtype=np.uint64) * 2 + 1
_NODE = ["p1", "p2"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


class SlotTable:
    """Slots 0 to n - 1 for n distinct 128-bit digests, by a minimal perfect hash.

    In each level the digests that hash alone to a bit keep it; the others go on to the
    next level.  A digest's slot is the number of bits set before its own.  The digests
    are kept by slot, so that a lookup of one that isn't in the table is found out.
    """

    SPREAD = 1.5

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest = np.arange(len(a))
        used = 0
        while len(rest):
            size = int(len(rest) * self.SPREAD) + 1
            at = self._at(a[rest], b[rest], len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            ranks = used + np.cumsum(bits) - 1
            self.levels.append((bits, ranks))
            used += int(bits.sum())
            rest = rest[~bits[at]]
        self.a = np.zeros(len(a), np.uint64)
        self.b = np.zeros(len(a), np.uint64)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.full(1, 2 * level + 1, np.uint64) * _ODD[3]
        return (_mixed(a * _ODD[2] + _mixed(b + salt)) % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slots = np.full(len(a), -1)
        rest = np.arange(len(a))
        for level, (bits, ranks) in enumerate(self.levels):
            at = self._at(a[rest], b[rest], level, len(bits))
            hit = bits[at]
            slots[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return slots

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that aren't in the table."""
        found = self._slots(a, b)
        known = found >= 0
        known[known] = (self.a[found[known]] == a[known]) & (self.b[found[known]] == b[known])
        return np.where(known, found, -1)


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _run_starts(keys: np.ndarray, last: int | None) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if len(keys) and last is not None:
        new[0] = keys[0] != last
    return new


def _number_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, conv, at (from 0 in this part of the conversation), h1, h2, words."""
    last, count = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column(1).to_numpy()
        starts = np.flatnonzero(_run_starts(conv, last))
        at = np.arange(n)
        begin = np.zeros(n, np.int64)
        begin[starts] = starts
        begin = np.maximum.accumulate(begin)
        at = at - begin
        first = starts[0] if len(starts) else n
        at[:first] = np.arange(first) + count
        last, count = int(conv[-1]), int(at[-1]) + 1
        digests, words = bytearray(), []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            role, text = (x.encode("utf-8", "surrogatepass") for x in (role, text))
            made = hashlib.blake2b(b"%d:" % len(role), digest_size=16)
            made.update(role)
            made.update(text)
            digests += made.digest()
            words.append(len(text.split()))
        hashes = np.frombuffer(bytes(digests), np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(at, pa.int64()),
             _signed(hashes[:, 0].copy()), _signed(hashes[:, 1].copy()), pa.array(words, pa.int64())],
            ["part", "conv", "at", "h1", "h2", "words"],
        )


def _digest_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, conv, depth, x1, x2 (the prefix in this part), e1, e2 (the turn), words."""
    last = None
    carry = [np.uint64(0), np.uint64(0)]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, pos = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        starts = _run_starts(conv, last)
        of_run = np.cumsum(starts)
        begin = np.concatenate(([0], np.flatnonzero(starts)))
        prefixes, turns = [], []
        for k in (0, 1):
            own = _unsigned(batch.column(3 + k))
            turn = _mixed(own * _ODD[4 + k] + _mixed(pos.astype(np.uint64) * _ODD[6 + k] + np.uint64(1)))
            so_far = np.bitwise_xor.accumulate(turn)
            # What stands before a run: for the first one, undo the carry.
            before = np.where(begin > 0, so_far[begin - 1], np.uint64(0))
            before[0] = carry[k]
            prefix = so_far ^ before[of_run]
            prefixes.append(prefix)
            turns.append(turn)
            carry[k] = prefix[-1]
        last = int(conv[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(pos + 1, pa.int64()),
             *map(_signed, prefixes), *map(_signed, turns), batch.column(5)],
            ["part", "conv", "depth", "x1", "x2", "e1", "e2", "words"],
        )


def _in_parts(df: DataFrame, keys: list[str], *picked: str) -> DataFrame:
    """Rows dealt by ranges of ``keys`` and sorted, with the number of their part.

    Ranges cut a conversation that has most of the rows like any other.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return dealt.select(F.spark_partition_id().alias("part"), *picked)


def _at_edges(rows: DataFrame, totals: list) -> DataFrame:
    """Totals of the conversations that a part begins or ends with: two rows a part."""
    edges = rows.groupBy(F.col("part").alias("of_part")).agg(
        F.min("conv").alias("lo"), F.max("conv").alias("hi")
    )
    held = rows.join(
        F.broadcast(edges),
        (F.col("part") == F.col("of_part")) & F.col("conv").isin(F.col("lo"), F.col("hi")),
    )
    return held.groupBy("part", "conv").agg(*totals)


def _before() -> Window:
    return Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, pos (from 0, by turn, null first, then role, text), h1, h2, words."""
    rows = stored(
        mapped(
            _in_parts(turns, ["conv", "turn", "role", "text"], "conv", "role", "text"),
            _number_turns, "part int, conv long, at long, h1 long, h2 long, words long",
        ),
        "trie-turns",
    )
    carried = _at_edges(rows, [F.count("*").alias("n")]).select(
        F.col("part").alias("c_part"), F.col("conv").alias("c_conv"),
        F.sum("n").over(_before()).alias("before"),
    ).where("before is not null")
    matched = (F.col("part") == F.col("c_part")) & (F.col("conv") == F.col("c_conv"))
    return rows.join(F.broadcast(carried), matched, "left").select(
        "conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "h1", "h2", "words"
    )


def rebuilt_turns(own: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and all conversations.

    The first h turns of each come from the donor, the conversation with its number
    less what that leaves over when divided by ``every``.
    """
    lengths = own.groupBy("conv").agg(F.count("*").alias("n"))
    convs = lengths.select(
        "conv", "n",
        F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).alias("h"),
        (F.col("conv") - F.col("conv") % every).alias("donor"),
    )
    donors = lengths.where(F.col("conv") % every == 0).select(
        F.col("conv").alias("d_conv"), F.col("n").alias("d_n")
    )
    convs = stored(
        convs.join(donors, F.col("donor") == F.col("d_conv"), "left").select(
            "conv", "n", "h", "donor",
            F.least("h", F.coalesce("d_n", F.lit(0))).cast("long").alias("given"),
        ),
        "trie-conversations",
    )
    heads = own.where((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed(
        "conv", "d_conv"
    )
    given = convs.join(
        heads, (F.col("donor") == F.col("d_conv")) & (F.col("pos") < F.col("given"))
    ).select("conv", "pos", "h1", "h2", "words")
    moves = convs.select(F.col("conv").alias("m_conv"), "h", "given")
    rest = own.join(
        moves, (F.col("conv") == F.col("m_conv")) & (F.col("pos") >= F.col("h"))
    ).select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "h1", "h2", "words")
    return given.union(rest), convs


def prefix_digests(turns: DataFrame) -> DataFrame:
    """conv, depth, p1, p2 (the prefix), q1, q2 (the one before), words of the last turn."""
    rows = stored(
        mapped(
            _in_parts(turns, ["conv", "pos"], "conv", "pos", "h1", "h2", "words"),
            _digest_prefixes,
            "part int, conv long, depth long, x1 long, x2 long, e1 long, e2 long, words long",
        ),
        "trie-prefixes",
    )
    ends = _at_edges(
        rows, [F.max_by("x1", "depth").alias("x1"), F.max_by("x2", "depth").alias("x2")]
    )
    carried = ends.select(
        F.col("part").alias("c_part"), F.col("conv").alias("c_conv"),
        F.bit_xor("x1").over(_before()).alias("c1"), F.bit_xor("x2").over(_before()).alias("c2"),
    ).where("c1 is not null")
    matched = (F.col("part") == F.col("c_part")) & (F.col("conv") == F.col("c_conv"))
    whole = rows.join(F.broadcast(carried), matched, "left").select(
        "conv", "depth", "words", "e1", "e2",
        F.col("x1").bitwiseXOR(F.coalesce("c1", F.lit(0))).alias("p1"),
        F.col("x2").bitwiseXOR(F.coalesce("c2", F.lit(0))).alias("p2"),
    )
    return whole.select(
        "conv", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("e1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("e2")).alias("q2"), "words",
    )


def accumulated(nodes: pa.Table) -> pa.Table:
    """The nodes of a shard with ``leaves`` and ``saved`` summed over their subtrees."""
    a, b = _unsigned(nodes.column("p1")), _unsigned(nodes.column("p2"))
    table = SlotTable(a, b)
    slot = table.slots(a, b)
    parent = np.full(len(a), -1)
    depth = np.zeros(len(a), np.int64)
    leaves = np.zeros(len(a), np.int64)
    saved = np.zeros(len(a), np.int64)
    parent[slot] = table.slots(_unsigned(nodes.column("q1")), _unsigned(nodes.column("q2")))
    depth[slot] = nodes.column("depth").to_numpy()
    leaves[slot] = nodes.column("leaves").to_numpy()
    saved[slot] = nodes.column("saved").to_numpy()
    # The root is its own parent by digest.
    parent[depth == 0] = -1
    by_depth = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, cuts):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    made = {"leaves": leaves[slot], "saved": saved[slot]}
    for name, values in made.items():
        nodes = nodes.set_column(nodes.column_names.index(name), name, pa.array(values))
    return nodes.append_column("top", pa.array(parent[slot] < 0))


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from accumulated(pa.Table.from_batches(held)).to_batches()


_SUMS = ["p1", "p2", "q1", "q2", "depth", "leaves", "saved"]


def subtree_sums(
    nodes: DataFrame, prefixes: DataFrame, light: int, task_nodes: int
) -> DataFrame:
    """p1, p2, leaves, saved over the subtrees of the nodes with several members.

    ``nodes`` (stored) has p1, p2, q1, q2, depth, n_convs, first (a member) and their
    own leaves and saved.  Nodes of ``light`` members or fewer are accumulated in shards,
    whole subtrees together; what their tops sum up to is added to their parents, and
    these, far fewer, are taken in the same way with a higher limit, until they fit in
    one task.  A shard's arrays follow ``task_nodes``, or a subtree of ``light`` members
    with the longest prefix that two of them share.
    """
    kind = "p1 long, p2 long, q1 long, q2 long, depth long, leaves long, saved long, top boolean"
    done = []
    rest = nodes
    while (count := rest.count()) > task_nodes:
        heavy = rest.where(F.col("n_convs") > light)
        # The last prefix of each conversation that many share.
        last = (
            prefixes.join(heavy.select(F.col("p1").alias("h1"), F.col("p2").alias("h2")),
                          (F.col("p1") == F.col("h1")) & (F.col("p2") == F.col("h2")))
            .groupBy(F.col("conv").alias("l_conv")).agg(F.max("depth").alias("deepest"))
        )
        tops = prefixes.join(last, F.col("conv") == F.col("l_conv"), "left").where(
            F.col("depth") == F.coalesce("deepest", F.lit(0)) + 1
        ).select(F.col("conv").alias("t_conv"), F.col("p1").alias("t1"), F.col("p2").alias("t2"))
        parts = max(
            int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")),
            -(-count // task_nodes),
        )
        shards = (
            rest.where((F.col("n_convs") <= light) & (F.col("depth") > 0))
            .join(tops, F.col("first") == F.col("t_conv"))
            .repartition(parts, "t1", "t2")
            .select(*_SUMS)
        )
        summed = stored(shards.mapInArrow(_accumulate, kind), "trie-sums")
        done.append(summed)
        up = summed.where("top").groupBy(F.col("q1").alias("u1"), F.col("q2").alias("u2")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        above = rest.where((F.col("n_convs") > light) | (F.col("depth") == 0)).join(
            up, (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")), "left"
        )
        rest = stored(
            above.withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
            .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
            .select(*nodes.columns),
            "trie-above",
        )
        light *= LIGHTER
    # Counted: at most task_nodes rows.
    done.append(rest.select(*_SUMS).repartition(1).mapInArrow(_accumulate, kind))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select("p1", "p2", "leaves", "saved")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node's chunks of ids, read in order."""
    last, made = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for p1, p2, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (p1, p2) == last:
                made.update(b",")
            else:
                if last:
                    out.append((*last, made.hexdigest()))
                last, made = (p1, p2), hashlib.sha256()
            made.update(ids.encode())
        yield _ends(out)
    if last:
        yield _ends([(*last, made.hexdigest())])


def _ends(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["s1", "s2", "ends_sha256"]
    )


def conversation_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", every: int = DONOR_EVERY, most: int = DONOR_TURNS,
    light: int = LIGHT, task_nodes: int = TASK_NODES,
) -> DataFrame:
    """The prefix trie of the rebuilt conversations, a row per node.

    Turns are ordered by turn (null first), then role and text; null role and text are
    empty; equal rows are turns of their own; rows without a conv_id belong to none.  A
    conversation's first h turns, h = crc32 of its decimal id modulo ``most``, are
    replaced by the first h of conversation ``conv_id - conv_id % every`` (all, if it has
    fewer; none, if there is none).  Nodes are told apart by 128-bit digests.

    Result, longs: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves and saved_tokens (over the subtree: members less one,
    times the words of the last text), and ends_sha256 of the ids, comma-joined, of the
    conversations that end here.  The root is a row as soon as there is a conversation;
    an empty table gives an empty result.  Other columns are ignored.  A task holds the
    ids that end in one node as a stream, the sums of about ``task_nodes`` nodes.
    """
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null")
    rebuilt, convs = rebuilt_turns(numbered_turns(turns), every, most)
    prefixes = stored(prefix_digests(rebuilt), "trie-digests")
    grown = prefixes.groupBy(*_NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("first"),
        F.min("depth").alias("depth"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
        F.min("words").alias("words"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("first")).where(
        "n_convs > 0"
    ).select(
        zero.alias("p1"), zero.alias("p2"), "n_convs", "first", zero.alias("depth"),
        zero.alias("q1"), zero.alias("q2"), zero.alias("words"),
    )
    distinct = stored(grown.unionByName(root), "trie-distinct")
    kids = distinct.where("depth > 0").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.count("*").alias("kids"), F.count_if(F.col("n_convs") == 1).alias("lone")
    )
    nodes = stored(
        distinct.join(kids, (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2")), "left")
        .select(
            *distinct.columns, F.coalesce("kids", zero).alias("n_children"),
            # A child with one member has one leaf and saves nothing.
            F.coalesce("lone", F.lit(1)).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ),
        "trie-nodes",
    )
    several = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    sums = subtree_sums(stored(nodes.where(several), "trie-several"), prefixes, light, task_nodes)
    sums = sums.select(
        F.col("p1").alias("m1"), F.col("p2").alias("m2"), F.col("leaves").alias("all_leaves"),
        F.col("saved").alias("all_saved"),
    )
    last = prefixes.groupBy("conv").agg(F.max_by(F.struct(*_NODE), "depth").alias("node"))
    none = convs.join(last.select(F.col("conv").alias("l_conv")), F.col("conv") == F.col("l_conv"), "left_anti")
    ends = last.select("node.p1", "node.p2", "conv").union(
        none.select(zero.alias("p1"), zero.alias("p2"), "conv")
    )
    chunks = ends.groupBy(*_NODE, F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    hashed = mapped(
        chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "chunk").select(*_NODE, "ids"),
        _hash_ends, "s1 long, s2 long, ends_sha256 string",
    )
    # Stored, so that the join can split a parent that has most of the children.
    parents = distinct.select(
        F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.col("first").alias("parent_conv_id")
    )
    same = lambda a, b: (F.col("p1") == F.col(a)) & (F.col("p2") == F.col(b))
    of_parent = (
        (F.col("q1") == F.col("r1")) & (F.col("q2") == F.col("r2")) & (F.col("depth") > 0)
    )
    return (
        nodes.join(sums, same("m1", "m2"), "left")
        .join(hashed, same("s1", "s2"), "left")
        .join(parents, of_parent, "left")
        .select(
            F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
            F.coalesce("all_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("all_saved", zero).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )
