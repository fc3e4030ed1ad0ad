"""Test items found in training text: BM25 retrieval with block-max WAND, then overlap."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from millrace.llm.common import mapped, stored

K1 = 1.2
B = 0.75
# Score of a passage for an item as a share of the item's score for itself.
MIN_SCORE = 0.5
SHINGLE = 5
MIN_OVERLAP = 0.8
# Share of an item's words, at its end, that is told as its answer if none is marked.
ANSWER_SHARE = 1 / 3
_ANSWER_MARK = re.compile(r"\banswer\s*:", re.IGNORECASE)
_WORD = re.compile(r"\w+")
# Items that share one upper bound for each term.
BLOCK = 2
# A term in more than this share of the blocks is common: its bound over all items,
# which is small, stands for all blocks.
COMMON_SHARE = 0.5
# A passage is two of these, and passages begin at each: a run of words of this length
# lies within one of them.  Longer items make longer passages.
HALF_PASSAGE = 64
# Characters of test items in one index.  More items make more indexes, each of which
# meets all passages; the size of what is broadcast doesn't grow.
INDEX_CHARS = 8_000_000
# Words searched at once, and bounds of passages and blocks held at once.
UNIT_WORDS = 50_000
CELLS = 2_000_000
_SLACK = 1e-9


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts_of(text: str | None) -> tuple[list[str], list[str], bool]:
    """(question, answer) words: split at a marked answer, else before the last third;
    whether the answer is marked.
    """
    mark = _ANSWER_MARK.search(text or "")
    if mark:
        question, answer = words_of(text[: mark.start()]), words_of(text[mark.end() :])
        if question and answer:
            return question, answer, True
    words = words_of(text)
    cut = len(words) - max(1, round(len(words) * ANSWER_SHARE))
    return words[:cut], words[cut:], False


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


@dataclass
class Index:
    """Postings of test items: for each term, items and impacts, and bounds by block.

    An impact is a BM25 weight divided by the item's score for itself, so that scores
    of all items are shares of 1 and one threshold fits short and long items.  Items
    stand in the order of their lengths, and a block is a run of items: its bounds are
    those of items alike.  ``block_from[t]`` to ``block_from[t + 1]`` are a term's
    entries in ``block_of`` and ``block_max``.
    """

    item_ids: list[int | None]
    questions: list[set]
    answers: list[set]
    # Shingles of an item that are in neither part; None if its answer is marked.
    across: list[set | None]
    half: int
    term_of: dict[str, int]
    items: list[list[int]] = field(default_factory=list)
    impacts: list[list[float]] = field(default_factory=list)
    term_max: np.ndarray = field(default_factory=lambda: np.zeros(0))
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    block_from: np.ndarray = field(default_factory=lambda: np.zeros(1, int))
    block_of: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def n_blocks(self) -> int:
        return -(-len(self.item_ids) // BLOCK)


def build_index(
    rows: list[tuple[int | None, str | None]], total: int, mean_words: float, df: dict[str, int]
) -> Index:
    """Index some items by the statistics of all: their number, mean length, term counts."""
    rows = sorted(rows, key=lambda r: len(words_of(r[1])))
    split = [parts_of(text) for _, text in rows]
    counted = [Counter(words_of(text)) for _, text in rows]
    longest = max((c.total() for c in counted), default=0)
    index = Index(
        [i for i, _ in rows],
        [shingles(q) for q, _, _ in split],
        [shingles(a) for _, a, _ in split],
        [None if m else shingles(q + a) - shingles(q) - shingles(a) for q, a, m in split],
        max(HALF_PASSAGE, longest),
        {},
    )
    for item, counts in enumerate(counted):
        size = counts.total()
        weights = {}
        for term, tf in counts.items():
            idf = math.log(1 + (total - df[term] + 0.5) / (df[term] + 0.5))
            weights[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_words))
        own = sum(weights.values())
        for term, weight in weights.items():
            at = index.term_of.setdefault(term, len(index.items))
            if at == len(index.items):
                index.items.append([])
                index.impacts.append([])
            index.items[at].append(item)
            index.impacts[at].append(weight / own)
    starts, blocks, bounds = [0], [], []
    for items, impacts in zip(index.items, index.impacts, strict=True):
        best: dict[int, float] = {}
        for item, impact in zip(items, impacts, strict=True):
            best[item // BLOCK] = max(best.get(item // BLOCK, 0.0), impact)
        blocks += best.keys()
        bounds += best.values()
        starts.append(len(blocks))
    index.term_max = np.array([max(i) for i in index.impacts])
    index.block_from = np.array(starts)
    index.block_of = np.array(blocks, int)
    index.block_max = np.array(bounds)
    index.common = np.diff(index.block_from) > COMMON_SHARE * max(index.n_blocks, 8)
    return index


def block_max_wand(
    index: Index, terms: list[int], threshold: float, block: int
) -> list[tuple[int, float]]:
    """The items of a block whose impacts over distinct ``terms`` reach the threshold.

    Cursors stand on the next item of each term, in item order, each with the term's
    bound in the block.  The pivot is the first item that the terms up to it could
    lift over the threshold; an item is only scored when all that could contribute
    stand on it, and the items before the pivot are never looked at.
    """
    least = threshold - _SLACK
    first, end = block * BLOCK, min((block + 1) * BLOCK, len(index.item_ids))
    cursors = []
    for term in terms:
        items = index.items[term]
        at = bisect_left(items, first)
        stop = bisect_left(items, end, at)
        if at < stop:
            bound = max(index.impacts[term][at:stop])
            cursors.append((items[at], at, stop, bound, term))
    found: list[tuple[int, float]] = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, None
        for k, cursor in enumerate(cursors):
            bound += cursor[3]
            if bound >= least:
                pivot = k
                break
        if pivot is None:
            break
        item = cursors[pivot][0]
        target = item
        if cursors[0][0] == item:
            score = sum(index.impacts[c[4]][c[1]] for c in cursors if c[0] == item)
            if score >= least:
                found.append((item, score))
            target = item + 1
        moved = []
        for cursor in cursors:
            if cursor[0] < target:
                _, at, stop, most, term = cursor
                at = bisect_left(index.items[term], target, at, stop)
                if at == stop:
                    continue
                cursor = (index.items[term][at], at, stop, most, term)
            moved.append(cursor)
        cursors = moved
    return found


def open_blocks(
    passage: np.ndarray, terms: np.ndarray, n: int, index: Index, threshold: float
) -> Iterator[tuple[int, int]]:
    """(passage, block) where the bounds of the passage's terms reach the threshold.

    ``passage`` and ``terms``: pairs without repeats, ordered by passage.
    """
    common = index.common[terms]
    base = np.bincount(passage[common], index.term_max[terms[common]], minlength=n)
    passage, terms = passage[~common], terms[~common]
    blocks = index.n_blocks
    step = max(1, CELLS // blocks)
    for low in range(0, n, step):
        high = min(n, low + step)
        a, b = np.searchsorted(passage, (low, high))
        begins = index.block_from[terms[a:b]]
        sizes = index.block_from[terms[a:b] + 1] - begins
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        entry = np.arange(total) + np.repeat(begins - ends + sizes, sizes)
        cell = np.repeat(passage[a:b] - low, sizes) * blocks + index.block_of[entry]
        if base[low:high].max(initial=0.0) >= threshold - _SLACK:
            # Blocks without any other term can do.
            some = np.arange((high - low) * blocks)
            bounds = np.bincount(cell, index.block_max[entry], minlength=len(some))
        elif len(cell) * 16 > (high - low) * blocks:
            bounds = np.bincount(cell, index.block_max[entry])
            some = np.flatnonzero(bounds)
            bounds = bounds[some]
        else:
            some, which = np.unique(cell, return_inverse=True)
            bounds = np.bincount(which, index.block_max[entry], minlength=len(some))
        bounds = bounds + base[low + some // blocks]
        for found in some[bounds >= threshold - _SLACK].tolist():
            yield low + found // blocks, found % blocks


def distinct_terms(
    sizes: list[int], terms: np.ndarray, half: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of all passages of some texts: (passage, term), first passages.

    ``sizes``: words of each text; ``terms``: the number of each word's term, -1 for
    words in no item.  A text's passage p begins at its word p * half and has two
    halves; passages are numbered through all texts.
    """
    lengths = np.array(sizes)
    text = np.repeat(np.arange(len(sizes)), lengths)
    place = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passages = np.maximum(1, -(-lengths // half))
    firsts = np.cumsum(passages) - passages
    known = np.flatnonzero(terms >= 0)
    text, place, term = text[known], place[known], terms[known]
    order = np.lexsort((place, term, text)) if len(known) else known
    same = (term[order[1:]] == term[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    before = np.full(len(known), -1)
    before[order[1:][same]] = place[order[:-1][same]]
    half_no = place // half
    own = before < half_no * half
    earlier = (half_no > 0) & (before < (half_no - 1) * half)
    number = firsts[text] + half_no
    passage = np.concatenate((number[own], number[earlier] - 1))
    term = np.concatenate((term[own], term[earlier]))
    order = np.argsort(passage, kind="stable")
    return passage[order], term[order], firsts


def search(
    texts: list[str | None], index: Index, threshold: float
) -> list[dict[int, tuple]]:
    """Verified items of each text: item -> (score, question and answer overlap, -word)."""
    best: list[dict[int, tuple]] = [{} for _ in texts]
    get = index.term_of.get
    held: list[int] = []
    words: list[list[str]] = []
    size = 0
    for row, text in enumerate(texts):
        found = words_of(text)
        if found:
            held.append(row)
            words.append(found)
            size += len(found)
        if size >= UNIT_WORDS or (row == len(texts) - 1 and held):
            sizes = [len(w) for w in words]
            terms = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, size)
            _search_unit(held, words, sizes, terms, index, threshold, best)
            held, words, size = [], [], 0
    return best


def _search_unit(
    rows: list[int], words: list[list[str]], sizes: list[int], terms: np.ndarray,
    index: Index, threshold: float, best: list[dict[int, tuple]],
) -> None:
    passage, term, firsts = distinct_terms(sizes, terms, index.half)
    n = int(firsts[-1]) + max(1, -(-sizes[-1] // index.half))
    for p, block in open_blocks(passage, term, n, index, threshold):
        a, b = np.searchsorted(passage, (p, p + 1))
        retrieved = block_max_wand(index, term[a:b].tolist(), threshold, block)
        if not retrieved:
            continue
        at = int(np.searchsorted(firsts, p, side="right")) - 1
        start = (p - int(firsts[at])) * index.half
        there = words[at][start : start + 2 * index.half]
        whole = shingles(there)
        short = {k: _runs(there, k) for k in range(1, SHINGLE)}
        for item, score in retrieved:
            question, answer, across = (
                index.questions[item], index.answers[item], index.across[item]
            )
            q, a_ = _overlap(question, whole, short), _overlap(answer, whole, short)
            found = q >= MIN_OVERLAP and a_ >= MIN_OVERLAP
            if not found and across is not None:
                # Runs of a part that is shorter than a shingle are no shingles of the item.
                mine = {s for s in question | answer if len(s) == SHINGLE} | across
                found = _overlap(mine, whole, short) >= MIN_OVERLAP
            if found:
                match = (score, q, a_, -start)
                best[rows[at]][item] = max(best[rows[at]].get(item, (0.0,)), match)


def _runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _overlap(part: set, there: set, short: dict[int, set]) -> float:
    """Share of a part's shingles that a passage has; a part of fewer words is one run."""
    if not part:
        return 1.0
    hits = sum(s in there or s in short.get(len(s), ()) for s in part)
    return hits / len(part)


def indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of bounded size that together hold every item with a word."""
    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words, pa.list_(pa.string()))],
                ["item_id", "text", "words"],
            )

    split = items.select(
        F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")
    )
    split = mapped(split, tokenised, "item_id long, text string, words array<string>")
    split = stored(split.where(F.size("words") > 0), "benchmark-words")
    total, chars, mean = split.agg(
        F.count("*"), F.sum(F.length("text")), F.avg(F.size("words"))
    ).first()
    if not total:
        return
    terms = split.select(F.explode(F.array_distinct("words")).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    n = -(-chars // INDEX_CHARS)
    share = split.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for part in range(n):
        mine = share.where(F.col("part") == part)
        rows: list[Row] = mine.select("item_id", "text").orderBy("item_id", "text").collect()
        used = mine.select(F.explode("words").alias("term")).distinct()
        counts = {r.term: r.df for r in df.join(used, "term", "left_semi").collect()}
        if rows:
            yield build_index([tuple(r) for r in rows], total, mean, counts)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", threshold: float = MIN_SCORE,
) -> DataFrame:
    """The test items that documents contain.

    Every passage of every document queries the items: those whose BM25 score reaches
    ``threshold`` times their score for themselves are all retrieved (block-max WAND),
    and a retrieved item counts if the passage has four fifths of the five-word
    shingles of its question and of its answer.  An item without a marked answer also
    counts if the passage has four fifths of the shingles of the whole item; the
    overlaps told are those of its first two thirds and its last.  The test set is cut
    into indexes of bounded size; each is broadcast and meets all documents, without a
    shuffle.

    Result, one row per pair of document and item: doc_id, text_hash, item_id, score,
    question_overlap, answer_overlap, first_word (of the best passage).  Repeated
    documents and items give repeated pairs.  Null, empty and wordless texts match
    nothing; null ids are kept; other columns are ignored; an empty table on either
    side gives an empty result.
    """
    text = F.col(text_col).cast("string")
    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    schema = (
        "doc_id long, text_hash long, item_id long, score double, question_overlap double,"
        " answer_overlap double, first_word long"
    )
    found = docs.sparkSession.createDataFrame([], schema)
    context = docs.sparkSession.sparkContext
    for index in indexes(items, item_col, item_text_col):
        found = found.union(
            mapped(picked, _searcher(context.broadcast(index), threshold), schema)
        )
    return found


def _searcher(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, found = [], []
            texts = batch.column(2).to_pylist()
            for row, matched in enumerate(search(texts, index, threshold)):
                for item, match in matched.items():
                    rows.append(row)
                    found.append((index.item_ids[item], *match))
            picked = pa.array(rows, pa.int64())
            ids, scores, questions, answers, starts = zip(*found) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(1).take(picked),
                 pa.array(ids, pa.int64()), pa.array(scores, pa.float64()),
                 pa.array(questions, pa.float64()), pa.array(answers, pa.float64()),
                 pa.array([-s for s in starts], pa.int64())],
                ["doc_id", "text_hash", "item_id", "score", "question_overlap",
                 "answer_overlap", "first_word"],
            )

    return run
