"""Byte-level BPE: the merges of a rank file replayed over the words of a corpus."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import mapped, remembered

# Words tokenized together: their distinct ones share one inverted index.
UNIT_WORDS = 200_000
# Encoded words that a Python worker remembers from earlier units.
KEPT_WORDS = 300_000
# Entries of the index of at least this size are merged by whole columns.
BULK = 64
# Token ids fit this many bits; the two largest numbers mark ends of words, and tokens
# that a merge has used up.
_BITS = 20
END = (1 << _BITS) - 1
GONE = END - 1


def joining_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """For two neighbours, as one number, the token they merge to.

    As many pairs as there are ways to cut the tokens in two tokens: they follow the
    vocabulary, not the corpus.
    """
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found[left << _BITS | right] = rank
    return found


class Vocabulary:
    """Tokens by rank, and which pairs of neighbours join to a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        if len(self.tokens) > GONE:
            raise ValueError(f"more than {GONE} tokens")
        for token, rank in ranks.items():
            self.tokens[rank] = token
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.joins = joining_pairs(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.of_bytes = np.array(
            [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        )

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a rank file: a token in base64 and its rank on each line."""
        return cls.parse(Path(path).read_bytes())

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        pairs = (line.split() for line in data.splitlines() if line.strip())
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def replay_merges(
    words: list[bytes], vocabulary: Vocabulary, bulk: int = BULK
) -> list[list[int]]:
    """Encode distinct words together, merge by merge in rank order.

    The words stand one after another in a doubly linked list of tokens.  An index
    names, for each token that a pair of neighbours would make, the positions where
    such a pair begins (pairs with equal joined bytes merge at the same rank and so
    share an entry).  The entry of lowest rank is taken from the index, its pairs are
    merged, and only the pairs that a merge touches, with the token before and the
    token after, enter the index.  Stale positions are skipped when their turn comes.

    Every word sees its merges in the same order as if it were encoded alone: lowest
    rank first, then from left to right.  Pairs of an entry that neither overlap nor
    touch don't depend on their order, so those of a large entry are merged at once.
    A merge may make a pair of lower rank than its own; the positions left then wait
    until that one is done.
    """
    if not words:
        return []
    state = _Tokens(words, vocabulary)
    while (entry := state.lowest()) is not None:
        rank, places = entry
        if len(places) < bulk:
            state.merge_in_order(rank, sorted(places.tolist()))
        else:
            state.merge_at_once(rank, np.unique(places))
    return state.words()


class _Tokens:
    """The tokens of some words, which neighbours follow, and the index of pairs."""

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        self.ends = np.cumsum([len(w) + 1 for w in words]) - 1
        self.token = vocabulary.of_byte[data]
        self.token[self.ends] = END
        n = len(data)
        self.after = np.arange(1, n + 1)
        self.before = np.arange(-1, n - 1)
        # What the pair that begins at a position would make.
        self.made = np.full(n, -1)
        self.made[:-1] = vocabulary.of_bytes[data[:-1], data[1:]]
        self.made[self.ends] = self.made[self.ends - 1] = -1
        self.joins = vocabulary.joins
        self.views = [memoryview(x) for x in (self.token, self.after, self.before, self.made)]
        self.single: dict[int, list[int]] = {}
        self.groups: dict[int, list[np.ndarray]] = {}
        self.waiting: list[int] = []
        self.add(np.arange(n), self.made)

    def add(self, places: np.ndarray, made: np.ndarray) -> None:
        """Enter pairs into the index by what they make."""
        known = made >= 0
        places, made = places[known], made[known]
        order = np.argsort(made, kind="stable")
        kinds, cuts = np.unique(made[order], return_index=True)
        parts = np.split(places[order], cuts[1:]) if len(kinds) else []
        for kind, part in zip(kinds.tolist(), parts, strict=True):
            if kind in self.groups:
                self.groups[kind].append(part)
            else:
                self.groups[kind] = [part]
                heapq.heappush(self.waiting, kind)

    def lowest(self) -> tuple[int, np.ndarray] | None:
        """Take the entry of lowest rank out of the index."""
        while self.waiting:
            rank = heapq.heappop(self.waiting)
            parts = self.groups.pop(rank, [])
            if alone := self.single.pop(rank, None):
                parts.append(np.array(alone))
            if parts:
                return rank, np.concatenate(parts) if len(parts) > 1 else parts[0]
        return None

    def merge_in_order(self, rank: int, places: list[int]) -> bool:
        """Merge one by one; true if a pair of lower rank made the others wait."""
        token, after, before, made = self.views
        made_by, single, waiting = self.joins.get, self.single, self.waiting
        for done, at in enumerate(places):
            if made[at] != rank:
                continue
            following = after[at]
            beyond = after[following]
            token[at] = rank
            token[following] = GONE
            made[following] = -1
            after[at] = beyond
            before[beyond] = at
            # Before the first token of all stands the last one, an end.
            previous = before[at]
            left = made[previous] = made_by(token[previous] << _BITS | rank, -1)
            if left >= 0:
                if left in single:
                    single[left].append(previous)
                else:
                    single[left] = [previous]
                    heapq.heappush(waiting, left)
            right = made[at] = made_by(rank << _BITS | token[beyond], -1)
            if right >= 0:
                if right in single:
                    single[right].append(at)
                else:
                    single[right] = [at]
                    heapq.heappush(waiting, right)
            if 0 <= left < rank or 0 <= right < rank:
                self.add(np.array(places[done + 1 :], int), np.full(len(places) - done - 1, rank))
                return True
        return False

    def merge_at_once(self, rank: int, places: np.ndarray) -> None:
        """Merge the pairs that neither overlap nor touch together, the others before.

        If any of the merges may make a pair of lower rank, all go in order: that pair
        comes before the merges to the right of it, and only before these.
        """
        after, made = self.after, self.made
        places = places[made[places] == rank]
        following = after[places]
        beyond = after[following]
        clash = (made[following] == rank) | (made[beyond] == rank)
        new = self._joined(places, beyond, rank)
        if ((new >= 0) & (new < rank)).any() or (
            clash.any() and 0 <= self.joins.get(rank << _BITS | rank, -1) < rank
        ):
            self.merge_in_order(rank, places.tolist())
            return
        if clash.any():
            partners = np.concatenate((following[clash], beyond[clash]))
            clash |= np.isin(places, partners)
            self.merge_in_order(rank, places[clash].tolist())
            places, following, beyond = places[~clash], following[~clash], beyond[~clash]
            new = self._joined(places, beyond, rank)
        previous = self.before[places]
        self.token[places] = rank
        self.token[following] = GONE
        made[following] = -1
        after[places] = beyond
        self.before[beyond] = places
        made[previous] = new[: len(places)]
        made[places] = new[len(places) :]
        self.add(np.concatenate((previous, places)), new)

    def _joined(self, places: np.ndarray, beyond: np.ndarray, rank: int) -> np.ndarray:
        """What the token before and the one after would make with a merged pair."""
        pairs = np.concatenate(
            (self.token[self.before[places]] << _BITS | rank, rank << _BITS | self.token[beyond])
        )
        kinds, which = np.unique(pairs, return_inverse=True)
        made_by = self.joins.get
        return np.array([made_by(k, -1) for k in kinds.tolist()], int)[which]

    def words(self) -> list[list[int]]:
        left = np.flatnonzero(self.token != GONE)
        ids = self.token[left].tolist()
        stops = np.searchsorted(left, self.ends).tolist()
        begins = [0, *(s + 1 for s in stops[:-1])]
        return [ids[a:b] for a, b in zip(begins, stops, strict=True)]


class Encoder:
    """Encodes words by corpus-level replay; remembers a bounded number of them."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT_WORDS):
        self.vocabulary = vocabulary
        self.kept = kept
        self.ids: dict[str, tuple[int, ...]] = {}
        self.digits = [str(i) for i in range(len(vocabulary.tokens))]

    def learn(self, words: set[str]) -> None:
        """Encode the words not met yet; a word that is a token needs no merge."""
        if len(self.ids) > self.kept:
            self.ids = {w: self.ids[w] for w in words if w in self.ids}
        new = [w for w in words if w not in self.ids]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        ranks = self.vocabulary.ranks
        split = [i for i, b in enumerate(raw) if b not in ranks]
        parts = replay_merges([raw[i] for i in split], self.vocabulary)
        for i, ids in zip(split, parts, strict=True):
            self.ids[new[i]] = tuple(ids)
        for word, b in zip(new, raw, strict=True):
            if b in ranks:
                self.ids[word] = (ranks[b],)


@remembered
def _encoder(rank_data: bytes) -> Encoder:
    """One per Python worker: the words it remembers serve all its tasks in a row."""
    return Encoder(Vocabulary.parse(rank_data))


def _units(
    texts: Iterable[str | None], pattern: str, size: int
) -> Iterator[list[tuple[int, list[str]]]]:
    """Lists of (row, words) of about ``size`` words; a long text spans several."""
    finder = regex.compile(pattern)
    unit: list[tuple[int, list[str]]] = []
    held = 0
    for row, text in enumerate(texts):
        found = (m.group() for m in finder.finditer(text or ""))
        if text is None or len(text) < size:
            found = iter(finder.findall(text or ""))
        while words := list(islice(found, size)):
            unit.append((row, words))
            held += len(words)
            if held >= size:
                yield unit
                unit, held = [], 0
    if unit:
        yield unit


def encode_texts(
    texts: list[str | None], encoder: Encoder, pattern: str, size: int = UNIT_WORDS
) -> Iterator[tuple[int, list[int]]]:
    """(row, token ids) in order; the ids of a long text come in several pieces."""
    for unit in _units(texts, pattern, size):
        encoder.learn(set(chain.from_iterable(words for _, words in unit)))
        ids_of = encoder.ids.__getitem__
        for row, words in unit:
            yield row, list(chain.from_iterable(map(ids_of, words)))


def with_tokens(
    df: DataFrame, rank_file: str, pattern: str,
    id_col: str = "doc_id", text_col: str = "text", ids: bool = False,
) -> DataFrame:
    """Encode every text, decode it again, and describe both.

    Each match of ``pattern`` is encoded separately, without special tokens.  The rank
    file is read once, on the driver, and sent to the executors: its size is that of
    the vocabulary, whatever the corpus.  The inverted index spans the distinct words
    of a unit of texts (``UNIT_WORDS``), which bounds a task's memory.

    Result, one row per row of ``df``: doc_id, n_tokens, ids_sha256 (of the decimal
    ids joined by one space), decoded_sha256 (of the decoded bytes), and with
    ``ids=True`` also the ids.  Null and empty texts have no tokens.  Repeated rows
    stay, other columns are ignored, an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield _described(batch.slice(at, 500), encoder, pattern, ids)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    picked = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    return mapped(picked, run, kind + (", ids array<int>" if ids else ""))


def _described(
    batch: pa.RecordBatch, encoder: Encoder, pattern: str, ids: bool
) -> pa.RecordBatch:
    n, digits = batch.num_rows, encoder.digits
    counts = [0] * n
    of_ids = [hashlib.sha256() for _ in range(n)]
    of_bytes = [hashlib.sha256() for _ in range(n)]
    kept: list[list[int]] = [[] for _ in range(n)] if ids else []
    texts = [t.as_py() for t in batch.column(1)]
    for row, found in encode_texts(texts, encoder, pattern):
        gap = " " if counts[row] else ""
        counts[row] += len(found)
        joined = gap + " ".join(map(digits.__getitem__, found))
        of_ids[row].update(joined.encode())
        of_bytes[row].update(encoder.vocabulary.decode(found))
        if ids:
            kept[row].extend(found)
    columns = [
        batch.column(0),
        pa.array(counts, pa.int64()),
        pa.array([h.hexdigest() for h in of_ids], pa.string()),
        pa.array([h.hexdigest() for h in of_bytes], pa.string()),
    ]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if ids:
        columns.append(pa.array(kept, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def decode_column(df: DataFrame, rank_file: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) from a column of token ids; null ids stay null."""
    shared = df.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary.parse(shared.value)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else vocabulary.decode(x))

    return df.withColumn("decoded", decoded(F.col(ids_col)))
