"""Jaccard join of word shingles by partitioning their universe.

The shingles of a document are hashed into segments, as many as its band of sizes
wants.  Two sets that are similar enough differ in at most ``H`` shingles, ``H``
following from the band, and so can't differ in many segments.  Each segment has a
weight: 1, if it tells pairs that are equal in it, or 2, if it also tells pairs that
differ in it by one shingle.  For that the hashes of its one-deletion neighbourhood are
indexed beside its own.  With weights that sum up to more than ``H``, every similar pair
meets in a segment.  What they exceed by is what each set may give up: it drops the
segments that would cost it most, those whose hashes most sets share.

Sets that meet are first held against each other by a sketch, the parities of a few
hundred bins: it differs in no more bits than the sets differ in shingles.  What passes
is grouped, and the groups are verified by the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import mapped, only_rows, stored, without_rows
from millrace.llm.components import connected_components
from millrace.llm.filters import hash_bitmap, may_hold
from millrace.llm.words import byte_kinds, lowered_words

SHINGLE_WORDS = 4
PERCENT = 85
SEED = 42
# Weight-2 segments of a set of average size and above; small sets have nothing else.
DOUBLES = 4
SMALL_SET = 48
# Sizes of sketches in bytes, and the largest set that each is meant for.
SKETCHES = {16: 64, 32: 256, 64: 768, 128: 1 << 62}
# Entries of one key that are compared in one step; more are compared part by part.
PART = 1024
# Entries of one key that are compared pair by pair, for all keys at once.
FEW = 12
# Shingles of the sets that a task verifies against one another.
PART_SHINGLES = 3 << 19
# Bits of a filter for each of its hashes, and its largest size.
BITS_EACH = 16
MOST_BITS = 28
_KINDS = byte_kinds(b" \t\n\x0b\x0c\r")
_ODD = np.random.default_rng(12).integers(1, 1 << 62, 8, dtype=np.uint64) * 2 + 1
_SHIFT = np.uint64(29)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _ODD[0]
    return x ^ (x >> np.uint64(31))


@dataclass
class Sets:
    """The shingle sets of a batch: hashes in rising order, set after set."""

    hashes: np.ndarray
    edges: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.edges)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), self.sizes)


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> Sets:
    """Each text's distinct shingles of ``width`` words as 64-bit hashes.

    A text of fewer words is one shingle; a text without words has none.
    """
    words = lowered_words(texts, _KINDS)
    n = len(texts)
    digest = xxhash.xxh64_intdigest
    forms = np.fromiter(
        (digest(w, SEED) for w in words.forms.to_pylist()), np.uint64, len(words.forms)
    )
    of_word = forms[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    whole = max(0, len(of_word) - width + 1)
    # At every word the shingle that begins there, even where the text ends before.
    value = np.zeros(whole, np.uint64)
    for k in range(width):
        value = value * _ODD[1] + of_word[k : k + whole]
    value = mixed(value)
    ends = np.cumsum(np.bincount(words.texts, minlength=n)[:n]).tolist()
    parts = []
    begin = 0
    for end in ends:
        if end - begin >= width:
            parts.append(np.unique(value[begin : end - width + 1]))
        elif end > begin:
            # Of fewer words: told apart from a whole shingle by their number.
            short = np.full(1, end - begin, np.uint64) * _ODD[5]
            for k in range(begin, end):
                short = short * _ODD[1] + of_word[k : k + 1]
            parts.append(mixed(short))
        else:
            parts.append(value[:0])
        begin = end
    edges = np.cumsum([0, *map(len, parts)])
    return Sets(np.concatenate(parts) if parts else value, edges)


def set_nodes(sets: Sets, seed: int) -> np.ndarray:
    """A 64-bit name of each set, from its hashes."""
    data = memoryview(sets.hashes.view(np.uint8))
    cuts = (8 * sets.edges).tolist()
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(data[a:b], seed) for a, b in zip(cuts, cuts[1:], strict=False)),
        np.uint64,
        len(cuts) - 1,
    )


@dataclass(frozen=True)
class Scheme:
    """How the sets of a band are partitioned."""

    segments: int
    doubles: int
    spare: int


class Schemes:
    """Bands of set sizes and their schemes.

    Band ``k`` holds the sizes from ``edges[k]`` up to the next one.  The edges grow by
    the ratio that similar sets differ by at most, so that the larger set of a pair is
    in the band of the smaller one or in the next.  A pair meets in the scheme of its
    smaller set: each set is indexed in its own band's and in the one below.
    """

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        edges = [1]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent + 1))
        self.edges = np.array(edges)
        self.schemes = [self._scheme(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]

    def most_apart(self, size: int) -> int:
        """What a set of at most this size and a larger similar one differ by, at most.

        Of sizes a <= b with 100 * common >= percent * union, b is at most
        100 * a / percent, and the difference grows with both.
        """
        return (100 - self.percent) * (size + 100 * size // self.percent) // (100 + self.percent)

    def _scheme(self, least: int, most: int) -> Scheme:
        apart = self.most_apart(most)
        if most <= SMALL_SET:
            # Whole neighbourhoods cost no more rows than the set has elements.
            segments = max(1, -(-(apart + 1) // 2))
            return Scheme(segments, segments, 2 * segments - apart - 1)
        segments = max(apart + 1 - DOUBLES, DOUBLES)
        # Segments that have no element, or one to delete, look alike in many sets.
        mean = least / segments
        common = segments * math.exp(-mean) + DOUBLES * (1 + mean) * math.exp(-mean)
        spare = 1 + math.ceil(common + 4 * math.sqrt(common))
        doubles = DOUBLES + spare // 2
        segments = max(apart + 1 + spare - doubles, -(-(apart + 1 + spare) // 2))
        doubles = min(doubles, segments)
        return Scheme(segments, doubles, segments + doubles - apart - 1)


def signatures(sets: Sets, schemes: Schemes) -> dict[str, np.ndarray]:
    """The index entries of some sets.

    key: hash of a segment's elements, or of all but one; owner: the set; place: band
    and segment; weight of the segment; deleted: whether one element is left out;
    spare: weight that the set may give up in that band.
    """
    sizes, owners = sets.sizes, sets.owners
    band = np.searchsorted(schemes.edges, sizes, "right") - 1
    found: dict[str, list[np.ndarray]] = {
        c: [] for c in ("key", "owner", "place", "weight", "deleted", "spare")
    }
    n_segments = np.array([s.segments for s in schemes.schemes] + [0])
    n_doubles = np.array([s.doubles for s in schemes.schemes] + [0])
    n_spare = np.array([s.spare for s in schemes.schemes] + [0])
    for below in (0, 1):
        of = np.where((sizes > 0) & (band >= below), band - below, -1)
        count = n_segments[of]
        base = np.cumsum(count) - count
        total = int(count.sum())
        picked = of[owners] >= 0
        own, h = owners[picked], sets.hashes[picked]
        place = (mixed(h * _ODD[2] + np.uint64(7)) % count[own].astype(np.uint64)).astype(np.int64)
        at = base[own] + place
        sums = np.zeros(total, np.uint64)
        element = mixed(h * _ODD[3])
        np.add.at(sums, at, element)
        owner = np.repeat(np.arange(len(sizes)), count)
        segment = np.arange(total) - base[owner]
        where = (of[owner].astype(np.uint64) << np.uint64(32)) | segment.astype(np.uint64)
        salt = mixed(where * _ODD[4] + np.uint64(1))
        double = segment < n_doubles[of][owner]
        out = {
            "key": mixed(sums + salt), "owner": owner, "place": where.astype(np.int64),
            "weight": 1 + double.astype(np.int8), "deleted": np.zeros(total, np.int8),
            "spare": n_spare[of][owner],
        }
        less = place < n_doubles[of][own]
        to = at[less]
        without = {
            "key": mixed(sums[to] - element[less] + salt[to]), "owner": own[less],
            "place": out["place"][to], "weight": np.full(len(to), 2, np.int8),
            "deleted": np.ones(len(to), np.int8), "spare": out["spare"][to],
        }
        for name in found:
            found[name] += [out[name], without[name]]
    return {name: np.concatenate(parts) for name, parts in found.items()}


def _as_longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def parities(sets: Sets, size: int) -> list[bytes]:
    """For each set, which of 8 * ``size`` bins have an odd number of its elements.

    Half of a sketch folded onto the other half is the sketch of half the size.
    """
    bins = 8 * size
    counts = np.zeros((len(sets.edges) - 1, bins), np.uint8)
    slot = mixed(sets.hashes * _ODD[6] + np.uint64(3)) & np.uint64(bins - 1)
    np.add.at(counts, (sets.owners, slot.astype(np.int64)), 1)
    return [row.tobytes() for row in np.packbits(counts & 1, axis=1)]


def described(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (a name of the set), proof (another), sketches."""
    names = [f"sketch{size}" for size in SKETCHES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets.sizes, pa.int64()),
                 _as_longs(set_nodes(sets, seed)), _as_longs(set_nodes(sets, ~seed % 2**64)),
                 *[pa.array(parities(sets, size), pa.binary()) for size in SKETCHES]],
                ["doc_id", "text_hash", "n_shingles", "node", "proof", *names],
            )

    return mapped(
        docs.select("doc_id", "text_hash", "text"), run,
        "doc_id long, text_hash long, n_shingles long, node long, proof long, "
        + ", ".join(f"{name} binary" for name in names),
    )


def index_entries(
    texts: DataFrame, schemes: Schemes, width: int, seed: int, wanted: np.ndarray | None = None
) -> DataFrame:
    """The signatures of all texts; with ``wanted``, those whose key is in that bitmap."""
    held = texts.sparkSession.sparkContext.broadcast((schemes, wanted))
    full = wanted is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size, bits = held.value
        for batch in batches:
            sets = shingle_sets(batch.column(0), width)
            found = signatures(sets, by_size)
            if not full:
                yield pa.RecordBatch.from_arrays([_as_longs(found["key"])], ["key"])
                continue
            found = {c: x[may_hold(bits, found["key"])] for c, x in found.items()}
            nodes = set_nodes(sets, seed)
            yield pa.RecordBatch.from_arrays(
                [_as_longs(found["key"]), _as_longs(nodes[found["owner"]]),
                 pa.array(found["place"], pa.int64()), pa.array(found["weight"], pa.int8()),
                 pa.array(found["deleted"], pa.int8()),
                 pa.array(found["spare"].astype(np.int32))],
                ["key", "node", "place", "weight", "deleted", "spare"],
            )

    more = ", node long, place long, weight byte, deleted byte, spare int" if full else ""
    return mapped(texts.select("text"), run, "key long" + more)


def _filter_bits(count: int) -> int:
    return min(MOST_BITS, max(16, math.ceil(math.log2(max(1, count * BITS_EACH)))))


def candidate_groups(
    texts: DataFrame, distinct: DataFrame, schemes: Schemes, width: int, seed: int, part: int
) -> DataFrame:
    """Sets that may be similar: node, and the group of sets of its band it is linked to.

    The first pass over the texts counts the keys; the second emits only entries whose
    key two entries share.  Each set then drops its costliest segments as far as its
    spare weight goes.  Entries of a key are linked if one of them wasn't dropped and
    their sketches are close enough.  A set may be in the groups of two bands.
    Result: node, cc (long), without repeats.
    """
    counts = stored(
        index_entries(texts, schemes, width, seed)
        .groupBy(F.col("key").alias("shared"))
        .agg(F.count("*").alias("n"))
        .where("n > 1"),
        "jaccard-keys",
    )
    bitmap = hash_bitmap(counts, F.col("shared"), _filter_bits(counts.count()))
    entries = index_entries(texts, schemes, width, seed, bitmap)
    met = entries.join(counts, F.col("key") == F.col("shared")).drop("shared")
    sketched = distinct.select(
        F.col("node").alias("of_node"), F.col("n_shingles").cast("int").alias("size"),
        *[f"sketch{size}" for size in SKETCHES],
    )
    # One shuffle by set serves its sketch and the choice of what it drops.
    place = Window.partitionBy("node", "band", "place")
    dearest = Window.partitionBy("node", "band").orderBy(
        F.desc("cost"), "place", "row"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = (
        met.join(sketched, F.col("node") == F.col("of_node"))
        .withColumn("band", F.shiftright("place", 32).cast("int"))
        .withColumn("cost", F.sum(F.col("n") - 1).over(place) / F.col("weight"))
        .withColumn("row", F.row_number().over(place.orderBy("deleted", "key")))
        .withColumn("given", F.sum(F.when(F.col("row") == 1, F.col("weight")).otherwise(0)).over(dearest))
        .withColumn("active", F.col("given") > F.col("spare"))
    )
    limits = [int(schemes.edges[b + 1]) for b in range(len(schemes.schemes))]
    sizes = F.array(*[F.lit(_sketch_size(x)) for x in limits] or [F.lit(0)])
    sketch = F.lit(None)
    for size in SKETCHES:
        sketch = F.when(F.get(sizes, F.col("band")) == size, F.col(f"sketch{size}")).otherwise(sketch)
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    meetings = chosen.select(
        "key", "node", "band", "size",
        (F.col("deleted") + 2 * F.col("active").cast("int")).cast("int").alias("flags"),
        sketch.alias("sketch"), own.alias("p"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("q"),
    ).select(
        "key", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"),
        "node", "band", "size", "flags", "sketch",
    )
    dealt = meetings.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    percent = schemes.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ready = pa.Table.from_batches(held).combine_chunks()
            # The last key of a batch may go on in the next one.
            last = [ready.column(c)[-1].as_py() for c in range(3)]
            keys = [ready.column(c).to_numpy() for c in range(3)]
            open_from = ready.num_rows - int(
                np.argmin(np.append(np.all([k[::-1] == x for k, x in zip(keys, last, strict=True)], axis=0), False))
            )
            if open_from:
                yield _close_entries(ready.slice(0, open_from), percent)
            rest = ready.slice(open_from).to_batches()
            held = rest
        if held:
            yield _close_entries(pa.Table.from_batches(held), percent)

    links = stored(
        mapped(dealt, run, "a_node long, b_node long, band int")
        .distinct()
        # A set is a node of its own in each band, so that bands don't hang together.
        .select("a_node", "b_node", F.xxhash64("a_node", "band").alias("a"),
                F.xxhash64("b_node", "band").alias("b")),
        "jaccard-links",
    )
    found = connected_components(links.select("a", "b"))
    names = links.select(F.col("a_node").alias("node"), F.col("a").alias("member")).union(
        links.select("b_node", "b")
    ).distinct()
    found = found.withColumnRenamed("node", "of_member")
    return names.join(found, F.col("member") == F.col("of_member")).select(
        "node", F.col("component").alias("cc")
    ).distinct()


def _sketch_size(largest: int) -> int:
    return next(size for size, most in SKETCHES.items() if largest <= most)


def _apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many elements similar sets of such sizes differ by, at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def _close_entries(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Links between the entries of each key whose sketches allow it, without repeats.

    For a few entries all pairs, for more a spanning forest of them.
    """
    keys = [rows.column(c).to_numpy() for c in range(3)]
    node, band, size, flags = (rows.column(c).to_numpy() for c in range(3, 7))
    size = size.astype(np.int64)
    data = rows.column(7).combine_chunks()
    lengths = np.diff(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1])
    new = np.ones(len(node), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(node)))
    group = np.repeat(np.arange(len(starts)), counts)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for length in np.unique(lengths).tolist():
        here = np.flatnonzero(lengths == length)
        held = b"".join(data.take(pa.array(here)).to_pylist())
        sketch = np.frombuffer(held, np.uint64).reshape(len(here), length // 8)
        few = counts[group[here]] <= FEW
        for step in range(1, FEW):
            i = np.flatnonzero(few[: len(here) - step] & (group[here[step:]] == group[here[: len(here) - step]]))
            if not len(i):
                break
            close = _close(sketch, size[here], flags[here], i, i + step, percent)
            left.append(here[i[close]])
            right.append(here[i[close] + step])
        begin = np.flatnonzero(~few & np.append(True, group[here[1:]] != group[here[:-1]]))
        for at in begin.tolist():
            free = np.arange(at, at + counts[group[here[at]]])
            while len(free) > 1:
                layer, free = free[:1], free[1:]
                while len(layer) and len(free):
                    reached = []
                    for now in layer.tolist():
                        close = _close(sketch, size[here], flags[here], now, free, percent)
                        if close.any():
                            left.append(np.full(close.sum(), here[now]))
                            right.append(here[free[close]])
                            reached.append(free[close])
                            free = free[~close]
                            if not len(free):
                                break
                    layer = np.concatenate(reached) if reached else free[:0]
    i = np.concatenate(left) if left else np.zeros(0, np.int64)
    j = np.concatenate(right) if right else np.zeros(0, np.int64)
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    order = np.lexsort((b, a, band[i]))
    a, b, of = a[order], b[order], band[i][order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])
    once &= a != b
    return pa.RecordBatch.from_arrays(
        [pa.array(a[once], pa.int64()), pa.array(b[once], pa.int64()), pa.array(of[once], pa.int32())],
        ["a_node", "b_node", "band"],
    )


def _close(sketch, size, flags, i, j, percent) -> np.ndarray:  # noqa: ANN001
    """Whether entries i and j may be of similar sets: by flags, sizes and sketches."""
    either, both = flags[i] | flags[j], flags[i] & flags[j]
    apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
    return (
        ((either & 2) > 0)
        & ((both & 1) == 0)
        & (apart <= _apart(size[i], size[j], percent))
        & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
    )


def shingles_of(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """set_node, hashes (binary) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0), width)
            cuts = sets.edges.tolist()
            held = [
                sets.hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [_as_longs(set_nodes(sets, seed)), pa.array(held, pa.binary())],
                ["set_node", "hashes"],
            )

    return mapped(texts.select("text"), run, "set_node long, hashes binary")


def similar_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (by number) that are similar enough.

    Grows one component after another.  A set's partners are looked up by its rarest
    hashes only: one that shares none of these can't share enough of the others.
    Each pair looked up is verified by the whole sets.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Ids by rarity, so that a sorted set begins with its rarest.
    rank = np.empty(len(count), np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    ids = rank[ids]
    alone = int((count == 1).sum())
    shared = ids >= alone
    ids, owner = ids[shared] - alone, owner[shared]
    order = np.lexsort((ids, owner))
    ids = ids[order]
    cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sets)))))
    by_id = np.argsort(ids, kind="stable")
    having = owner[order][by_id]
    heads = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(count) - alone))))
    free = np.ones(len(sets), bool)
    mark = np.zeros(len(count) - alone, bool)
    links: list[tuple[int, int]] = []
    for root in np.argsort(-np.diff(cuts), kind="stable").tolist():
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            now = queue.pop()
            own = ids[cuts[now] : cuts[now + 1]]
            size = int(sizes[now])
            probes = size - -(-percent * size // 100) + 1 - (size - len(own))
            if probes <= 0:
                continue
            near = [having[heads[i] : heads[i + 1]] for i in own[:probes].tolist()]
            if not near:
                continue
            others = np.unique(np.concatenate(near))
            others = others[free[others]]
            fits = (100 * sizes[others] >= percent * size) & (100 * size >= percent * sizes[others])
            others = others[fits]
            if not len(others):
                continue
            mark[own] = True
            lengths = cuts[others + 1] - cuts[others]
            at = np.arange(lengths.sum()) + np.repeat(
                cuts[others] - (np.cumsum(lengths) - lengths), lengths
            )
            common = np.bincount(
                np.repeat(np.arange(len(others)), lengths), mark[ids[at]], len(others)
            ).astype(np.int64)
            mark[own] = False
            similar = (100 + percent) * common >= percent * (size + sizes[others])
            reached = others[similar].tolist()
            free[reached] = False
            links += [(now, other) for other in reached]
            queue += reached
    return links


def verified_links(
    sets: DataFrame, groups: DataFrame, percent: int, part_shingles: int = PART_SHINGLES
) -> DataFrame:
    """Links (a, b) between the similar sets of each group.

    ``sets`` has set_node, hashes; ``groups`` node, cc.  A group is dealt into parts of
    about ``part_shingles``; every two parts meet in a task of their own, which emits a
    spanning forest of the links it finds.
    """
    weighed = stored(
        sets.join(groups, F.col("set_node") == F.col("node")).select("cc", "node", "hashes"),
        "jaccard-sets",
    )
    # Stored, so that the join can split a group that has most of the sets.
    weight = stored(
        weighed.groupBy(F.col("cc").alias("of_cc")).agg(
            F.ceil(F.sum(F.octet_length("hashes") / 8) / part_shingles).cast("int").alias("parts")
        ),
        "jaccard-groups",
    )
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # Two parts that meet also compare what is within each: no part meets itself.
    meetings = (
        weighed.join(weight, F.col("cc") == F.col("of_cc"))
        .withColumn("p", own)
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("parts = 1 or p <> q")
        .select("cc", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"),
                "node", "hashes")
    )
    dealt = meetings.repartition("cc", "lo", "hi").sortWithinPartitions("cc", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        last = None
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            rows = zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            for key, node, hashes in rows:
                if key != last:
                    yield _linked(held, percent)
                    held = {}
                    last = key
                held[node] = np.frombuffer(hashes, np.uint64)
        yield _linked(held, percent)

    return mapped(dealt, run, "a long, b long").distinct()


def _linked(sets: dict[int, np.ndarray], percent: int) -> pa.RecordBatch:
    nodes = list(sets)
    found = similar_forest(list(sets.values()), percent) if len(nodes) > 1 else []
    return pa.RecordBatch.from_arrays(
        [pa.array([nodes[i] for i, _ in found], pa.int64()),
         pa.array([nodes[j] for _, j in found], pa.int64())],
        ["a", "b"],
    )


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    width: int = SHINGLE_WORDS, percent: int = PERCENT, part: int = PART,
    part_shingles: int = PART_SHINGLES,
) -> DataFrame:
    """Group the documents whose shingle sets are linked, directly or through others.

    Two sets are linked if 100 * common >= ``percent`` * union.  Equal sets are one
    node from the start; one document of each is indexed.  Sets are compared by 64-bit
    hashes of their shingles.

    Result, one row per row of ``df``: doc_id, n_shingles, component_id (the smallest
    doc_id that can be reached, itself included; null only if no member has an id).
    Null and empty texts, and those without words, have no shingle and are linked with
    nothing.  Repeated rows stay, other columns are ignored, an empty table gives an
    empty result.
    """
    text = F.col(text_col).cast("string")
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    for seed in range(SEED, SEED + 8):
        rows = stored(described(docs, width, seed), "jaccard-docs")
        distinct = stored(
            rows.where("n_shingles > 0").groupBy("node").agg(
                F.min("doc_id").alias("first_id"),
                F.min(F.struct("doc_id", "text_hash")).alias("kept"),
                F.max("n_shingles").alias("n_shingles"),
                (F.min("proof") != F.max("proof")).alias("clash"),
                *[F.first(f"sketch{size}").alias(f"sketch{size}") for size in SKETCHES],
            ),
            "jaccard-sets",
        )
        # Two sets of one name: other names.  None at a few billion sets, as a rule.
        if not distinct.where("clash").take(1):
            break
    else:
        raise RuntimeError("no seed names all sets apart")
    largest = distinct.agg(F.max("n_shingles")).first()[0] or 0
    schemes = Schemes(percent, largest)
    copies = (
        rows.join(
            distinct.select(F.col("node").alias("of_node"), "kept"),
            F.col("node") == F.col("of_node"),
        )
        .where("not (doc_id <=> kept.doc_id and text_hash <=> kept.text_hash)")
        .select("doc_id", "text_hash")
    )
    texts = without_rows(docs, copies, "doc_id", "text")
    groups = stored(
        candidate_groups(texts, distinct, schemes, width, seed, part), "jaccard-members"
    )
    grouped = groups.select(F.col("node").alias("of_node")).distinct()
    others = distinct.join(grouped, F.col("node") == F.col("of_node"), "left_semi")
    sets = shingles_of(
        only_rows(texts, others.select("kept.doc_id", "kept.text_hash"), "doc_id", "text"),
        width, seed,
    )
    found = connected_components(verified_links(sets, groups, percent, part_shingles))
    found = found.withColumnRenamed("node", "of_node")
    joined = distinct.join(found, F.col("node") == F.col("of_node"), "left").select(
        "node", "first_id", F.coalesce("component", "node").alias("component")
    )
    # Stored, so that the join can split a component that has most of the rows.
    least = stored(
        joined.groupBy(F.col("component").alias("c")).agg(
            F.min("first_id").alias("component_id")
        ),
        "jaccard-components",
    )
    named = joined.join(least, F.col("component") == F.col("c")).select(
        F.col("node").alias("of_node"), "component_id"
    )
    linked = (F.col("node") == F.col("of_node")) & (F.col("n_shingles") > 0)
    return rows.join(named, linked, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id"))
        .otherwise(F.col("doc_id")).alias("component_id"),
    )
