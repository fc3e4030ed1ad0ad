"""Exact repeated substrings by refining buckets of positions.

Positions are told apart as in a suffix sort by bucket pointers: a position's bucket
of twice the length is the pair of its own bucket and the bucket of the position that
one length further on, so every round reuses the identifiers of the round before.
Identifiers here are derived from the bytes and not from ranks.  That way the rounds
up to the full length run inside a document, without a table of all positions, and
only the meeting of equal identifiers is a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import BROADCAST_ROWS, mapped, stored

LENGTH = 400
# Length of the q-grams whose least identifier in a window stands for the window.
GRAM = 64
# Gaps that are refined together before they are refined one by one.
BLOCK_GAPS = 24
# Bytes whose buckets are computed at once, and the share of them kept for positions
# when a window's least identifier is sought.
UNIT_BYTES = 1 << 20
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
# Odd multipliers of the rounds; any odd numbers without pattern do.
_ROUNDS = np.random.default_rng(20).integers(1, 1 << 63, (64, 2), dtype=np.uint64) * 2 + 1
_LETTERS = np.random.default_rng(25).integers(0, 1 << 63, 256, dtype=np.uint64)
_HALF = np.uint64(32)
_ROWS_AT_ONCE = 50_000
# What identifies a document's row, nulls included.
_KEY = ["doc_id", "text_hash"]


def _pair(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    made = left * _ROUNDS[k, 0]
    made += right * _ROUNDS[k, 1]
    made ^= made >> _HALF
    return made


def buckets(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the identifiers of all strings of that length, by start.

    Lengths double from single bytes on; a length between two powers joins two
    overlapping strings of the lower one.
    """
    found: dict[int, np.ndarray] = {}
    now, size, k = _LETTERS[data], 1, 0
    while True:
        for length in lengths:
            if size <= length < 2 * size:
                shift = length - size
                found[length] = (
                    _pair(now[: len(now) - shift], now[shift:], 32 + k) if shift else now
                )
        if 2 * size > max(lengths) or len(now) <= size:
            break
        now = _pair(now[:-size], now[size:], k)
        size, k = 2 * size, k + 1
    return [found.get(n, np.zeros(0, np.uint64)) for n in lengths]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by start."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def anchors(pieces: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of some byte strings of at least ``length`` bytes.

    The anchor of a window is the q-gram of least identifier in it, the leftmost of
    equal ones: equal windows have equal anchors at equal distances.  The windows of
    an anchor are consecutive.  Per anchor: its piece, its place, the first of its
    windows, their number, the q-gram's bucket, and the buckets of the first and last
    window, which overlap and so tell the whole context of the anchor.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    grams, windows = buckets(data, (gram, length))
    marked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_least(marked, length - gram + 1) & _PLACE).astype(np.int64)
    inside = np.ones(len(place), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(inside)
    place = place[starts]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    at, low, high = place[first], starts[first], starts[last]
    piece = np.searchsorted(ends, at, side="right")
    base = (ends - [len(p) for p in pieces])[piece]
    return {
        "piece": piece,
        "at": at - base,
        "low": low - base,
        "n": high - low + 1,
        "bucket": grams[at].view(np.int64),
        "head": windows[low].view(np.int64),
        "tail": windows[high].view(np.int64),
    }


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, offset, bytes): texts, the long ones cut so that each window is in one."""
    step = UNIT_BYTES
    for row, value in enumerate(batch.column(batch.schema.get_field_index("text"))):
        data = value.as_py()
        for offset in range(0, max(1, len(data) - length + 1), step):
            piece = data[offset : offset + step + length - 1] if len(data) > step else data
            if len(piece) >= length:
                yield row, offset, piece
            if len(data) <= step:
                break


def _with_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All anchors: their place, the gaps to their windows, and their buckets.

    A window is named by its gap, the distance from its start to the anchor: windows
    that are equal have equal gaps.  ``head`` and ``tail`` are the buckets of the
    windows of the longest and of the shortest gap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, bytes]] = []
            size = 0
            for piece in _pieces(batch, length):
                held.append(piece)
                size += len(piece[2])
                if size >= UNIT_BYTES:
                    yield described(batch, held)
                    held, size = [], 0
            if held:
                yield described(batch, held)

    def described(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        found = anchors([p for _, _, p in held], length, gram)
        rows = np.array([r for r, _, _ in held])[found["piece"]]
        offset = np.array([o for _, o, _ in held])[found["piece"]]
        picked = pa.array(rows, pa.int64())
        longest = found["at"] - found["low"]
        columns = {
            "doc_id": batch.column(0).take(picked),
            "text_hash": batch.column(1).take(picked),
            "at": pa.array(found["at"] + offset, pa.int64()),
            "lo": pa.array((longest - found["n"] + 1).astype(np.int32)),
            "hi": pa.array(longest.astype(np.int32)),
            "bucket": pa.array(found["bucket"]),
            "head": pa.array(found["head"]),
            "tail": pa.array(found["tail"]),
        }
        return pa.RecordBatch.from_pydict(columns)

    return mapped(
        docs,
        run,
        "doc_id long, text_hash long, at long, lo int, hi int, bucket long, head long,"
        " tail long",
    )


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    # A null id equals a null id.
    return left["doc_id"].eqNullSafe(right["doc_id2"]) & (
        left["text_hash"] == right["text_hash2"]
    )


def _key_as(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}2" for k in (*_KEY, *more)})


def _semi(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``df`` whose columns, none of them null, are among ``other``'s."""
    named = other.select(*[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(named, [F.col(c) == F.col(f"_{c}") for c in columns], "left_semi")


def _shared(df: DataFrame, columns: list[str], count: str = "count(*)") -> DataFrame:
    """Values of the columns that occur twice or more.

    Stored: a join with counts fresh from their own shuffle would have to follow that
    shuffle's partitions, and could not split one that holds most of the rows.
    """
    counted = df.groupBy(*columns).agg(F.expr(count).alias("n")).where("n > 1")
    return stored(counted.select(*columns), "suffix-several")


def _refined(members: DataFrame, core: list[str]) -> tuple[DataFrame, DataFrame]:
    """Refine ranges of windows that share a core by all that they cover.

    ``members``: _KEY, at, low, weight, the columns of ``core``, lo, hi, head, tail.
    Returns the members whose whole range occurs twice or more, as spans, and one
    member of each range that differs from another one of the same core: their
    windows may be shared in part.  Its weight is 1 if it stands for itself alone.
    """
    whole = [*core, "lo", "hi", "head", "tail"]
    kinds = stored(
        members.groupBy(*whole).agg(
            F.sum("weight").alias("copies"),
            # Any member serves: its bytes are those of all.
            *[F.first(c).alias(c) for c in (*_KEY, "at", "low")],
        ),
        "suffix-kinds",
    )
    twice = _semi(members.where("weight = 1"), kinds.where("copies > 1"), whole)
    mixed = _shared(kinds, core)
    weight = F.least("copies", F.lit(2)).cast("int").alias("weight")
    return twice, _semi(kinds, mixed, core).select(*kinds.columns, weight)


def _split(docs: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents that ``keyed`` names, and the others.

    If they are counted to be few, their keys are broadcast, so that only the texts
    that a join needs are shuffled for it; else the first part is all documents and
    the second is none.
    """
    keys = keyed.select(*_KEY).distinct()
    if keys.count() > BROADCAST_ROWS:
        return docs, None
    keys = F.broadcast(_key_as(keys))
    same = _same_key(docs, keys)
    return docs.join(keys, same, "left_semi"), docs.join(keys, same, "left_anti")


def _slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted ranges with the bytes that they cover."""
    names = ["at", "low", "lo", "hi", "bucket", "weight"]
    docs = _split(docs, wanted)[0]
    lists = _key_as(
        wanted.groupBy(*_KEY).agg(F.collect_list(F.struct(*names)).alias("ranges"))
    )
    joined = docs.join(lists, _same_key(docs, lists))

    def with_bytes(r: Column) -> Column:
        size = r["hi"] - r["lo"] + length
        # Positions count from 1.
        part = F.substring("text", (r["low"] + 1).cast("int"), size)
        return F.struct(*[r[n].alias(n) for n in names], part.alias("bytes"))

    # The array is made before it is unfolded: a row of it holds no text.
    cut = joined.select(*_KEY, F.transform("ranges", with_bytes).alias("cut"))
    return cut.select(*_KEY, F.explode("cut").alias("r")).select(*_KEY, "r.*")


def _grouped(parts: Iterator[dict[str, np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns of many small parts as batches of a useful size."""
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part["at"])
        if size >= _ROWS_AT_ONCE:
            yield _joined(held, schema)
            held, size = [], 0
    if held:
        yield _joined(held, schema)


def _joined(held: list[dict[str, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for name in schema.names:
        if name == "doc_id":  # may be null, so not a numpy column
            sizes = [len(p["at"]) for p in held]
            ids = pa.array([p["doc_id"] for p in held], pa.int64())
            columns.append(ids.take(pa.array(np.repeat(np.arange(len(held)), sizes))))
        else:
            values = [np.broadcast_to(p[name], p["at"].shape) for p in held]
            columns.append(pa.array(np.concatenate(values), schema.field(name).type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_BLOCK_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()),
     ("low", pa.int64()), ("weight", pa.int32()), ("bucket", pa.int64()),
     ("block", pa.int32()), ("core", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()),
     ("head", pa.int64()), ("tail", pa.int64())]
)
_BLOCK_DDL = (
    "doc_id long, text_hash long, at long, low long, weight int, bucket long, block int,"
    " core long, lo int, hi int, head long, tail long"
)


def blocks_of(data: bytes, lo: int, hi: int, length: int, size: int) -> dict[str, np.ndarray]:
    """The blocks of ``size`` gaps that a range from ``lo`` to ``hi`` takes part in.

    ``core`` is the bucket of the bytes that all windows of the full block have in
    common: two ranges can only share a window of the block if they agree in it.
    """
    cores, windows = buckets(np.frombuffer(data, np.uint8), (length - size + 1, length))
    block = np.arange(lo // size, hi // size + 1)
    low = np.maximum(block * size, lo)
    high = np.minimum(block * size + size - 1, hi)
    return {
        "block": block, "lo": low, "hi": high,
        "core": cores[hi - block * size].view(np.int64),
        "head": windows[hi - high].view(np.int64),
        "tail": windows[hi - low].view(np.int64),
    }


def _blocks(slices: DataFrame, length: int, size: int) -> DataFrame:
    names = [*_KEY, "at", "low", "weight", "bucket", "lo", "hi", "bytes"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for doc, text, at, low, weight, bucket, lo, hi, data in zip(
                *(batch.column(k).to_pylist() for k in range(len(names))), strict=True
            ):
                found = blocks_of(data, lo, hi, length, size)
                start = np.full(len(found["block"]), at)
                yield found | {"doc_id": doc, "text_hash": text, "at": start, "low": low,
                               "weight": weight, "bucket": bucket}

    return mapped(
        slices.select(*names),
        lambda batches: _grouped(parts(batches), _BLOCK_SCHEMA),
        _BLOCK_DDL,
    )


_WINDOW_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int64()),
     ("weight", pa.int32()), ("bucket", pa.int64()), ("lo", pa.int32()),
     ("window", pa.int64())]
)


def _windows(slices: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The windows of the wanted ranges one by one; ``lo`` is the gap."""
    place = [*_KEY, "at", "low"]
    lists = _key_as(
        wanted.groupBy(*place).agg(
            F.collect_list(F.struct("lo", "hi", "weight")).alias("ranges")
        ),
        "at", "low",
    )
    same = _same_key(slices, lists) & (slices["at"] == lists["at2"]) & (
        slices["low"] == lists["low2"]
    )
    joined = slices.join(lists, same).select(*_KEY, "at", "bucket", "hi", "bytes", "ranges")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for doc, text, at, bucket, top, data, ranges in zip(
                *(batch.column(k).to_pylist() for k in range(7)), strict=True
            ):
                bytes_ = np.frombuffer(data, np.uint8)
                for r in ranges:
                    part = bytes_[top - r["hi"] : top - r["lo"] + length]
                    ids = buckets(part, (length,))[0].view(np.int64)
                    yield {"doc_id": doc, "text_hash": text, "at": np.full(len(ids), at),
                           "weight": r["weight"], "bucket": bucket,
                           "lo": np.arange(r["hi"], r["lo"] - 1, -1), "window": ids}

    return mapped(
        joined,
        lambda batches: _grouped(parts(batches), _WINDOW_SCHEMA),
        "doc_id long, text_hash long, at long, weight int, bucket long, lo int, window long",
    )


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, size: int = BLOCK_GAPS
) -> DataFrame:
    """Spans of bytes that strings of ``length`` bytes starting elsewhere also cover.

    ``docs``: doc_id, text_hash, text (binary, no nulls).  Result: doc_id, text_hash,
    spans (array of start and end), one row per document that has any.

    1. Every window of ``length`` bytes is represented by an anchor, so that one
       position in about half a window is enough.  Anchors meet by the bucket of their
       q-gram; those alone in their bucket are unique.
    2. Anchors of a bucket are refined by all that their windows cover: where two
       agree in that, all their windows are repeated.
    3. One anchor of each kind, where a bucket has several, is refined again by blocks
       of windows: first by what the windows of a block have in common, then by all
       that they cover.  A block whose common part is unique has no repeated window.
    4. The windows of the blocks still undecided are refined one by one.

    Each step only has what the one before left open, and everything meets by grouped
    counts, which combine before the shuffle.
    """
    found = stored(_with_anchors(docs, length, gram), "suffix-anchors")
    several = _shared(found, ["bucket"])
    meeting = stored(_semi(found, several, ["bucket"]), "suffix-shared").select(
        "*", F.lit(1).alias("weight"), (F.col("at") - F.col("hi")).alias("low")
    )
    anchors_twice, mixed = _refined(meeting, ["bucket"])
    slices = stored(_slices(docs, mixed, length), "suffix-slices")
    blocks = stored(_blocks(slices, length, size), "suffix-blocks")
    cores = ["bucket", "block", "core"]
    blocks_twice, undecided = _refined(_semi(blocks, _shared(blocks, cores), cores), cores)
    windows = stored(_windows(slices, undecided, length), "suffix-windows")
    whole = ["bucket", "lo", "window"]
    equal = _shared(windows, whole, "sum(weight)")
    windows_twice = _semi(windows.where("weight = 1"), equal, whole)
    spans = [
        df.select(
            *_KEY,
            (F.col("at") - F.col(hi)).alias("s"),
            (F.col("at") - F.col("lo") + length).alias("e"),
        )
        for df, hi in ((anchors_twice, "hi"), (blocks_twice, "hi"), (windows_twice, "lo"))
    ]
    return (
        spans[0].union(spans[1]).union(spans[2]).groupBy(*_KEY)
        .agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    )


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of overlapping or touching spans."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def without_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, gram: int = GRAM, size: int = BLOCK_GAPS, carry: bool = False,
) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers.

    Texts are taken as UTF-8 bytes; a string is repeated if it also starts anywhere
    else in any text, the same one included, overlapping itself or not, and never
    crosses texts.  All its occurrences go.

    Result, one row per row of ``df``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept (binary), kept_sha256.  Null texts count as empty; rows
    repeated in full are copies of each other.  Other columns of ``df`` are ignored;
    with ``carry=True`` a struct column ``row`` has all of them but the text, and
    kept_text is the kept bytes as a string, without the characters of which only some
    bytes are left.  An empty table gives an empty result.
    """
    if length < 2 * gram or length < 2 * size:
        raise ValueError("gram and size must be at most half of length")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.encode(text, "UTF-8").alias("text"),
    )
    found = stored(repeated_spans(docs, length, gram, size), "suffix-spans")
    if carry:
        rest = [F.col(c) for c in df.columns if c != text_col]
        docs = df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.xxhash64(text).alias("text_hash"),
            F.encode(text, "UTF-8").alias("text"),
            F.struct(*rest).alias("row"),
        )
    carried = ["row"] if carry else []
    touched, others = _split(docs, found)
    spans = _key_as(found)
    joined = touched.join(spans, _same_key(touched, spans), "left").select(
        "doc_id", "text", "spans", *carried
    )
    if others is not None:
        none = F.lit(None).cast(found.schema["spans"].dataType)
        joined = joined.union(others.select("doc_id", "text", none.alias("spans"), *carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield cut(batch.slice(at, 500))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("bytes", "removed", "spans", "kept", "sha")}
        for value, found in zip(batch.column(1), batch.column(2), strict=True):
            data = value.as_py()
            runs = merged([(x["s"], x["e"]) for x in found.as_py() or ()])
            edges = [0, *(x for r in runs for x in r), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out["bytes"].append(len(data))
            out["removed"].append(len(data) - len(kept))
            out["spans"].append(len(runs))
            out["kept"].append(kept)
            out["sha"].append(hashlib.sha256(kept).hexdigest())
        columns = {
            "doc_id": batch.column(0),
            "n_bytes": pa.array(out["bytes"], pa.int64()),
            "n_removed": pa.array(out["removed"], pa.int64()),
            "n_spans": pa.array(out["spans"], pa.int64()),
            "kept": pa.array(out["kept"], pa.binary()),
            "kept_sha256": pa.array(out["sha"], pa.string()),
        }
        if carry:
            texts = [kept.decode("utf-8", "ignore") for kept in out["kept"]]
            columns |= {"kept_text": pa.array(texts, pa.string()), "row": batch.column(3)}
        return pa.RecordBatch.from_pydict(columns)

    schema = StructType()
    for name in ("doc_id", "n_bytes", "n_removed", "n_spans"):
        schema.add(name, "long")
    schema.add("kept", "binary").add("kept_sha256", "string")
    if carry:
        schema.add("kept_text", "string").add(joined.schema["row"])
    return mapped(joined, run, schema)
