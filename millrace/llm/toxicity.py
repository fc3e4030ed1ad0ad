"""Toxicity scores: a learned lexicon matched through Levenshtein automata, in context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drawn, stored

# Fixed values of the query's contract.
FOLDS = 4
HELD_OUT_FOLD = 2
THRESHOLD = 0.3

# The classifier is fitted on about so many labelled rows, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
# Stems and words of the lexicon, so many of each, and what makes one.
MAX_TERMS = 2_000
MIN_TOXIC_DOCS = 4
MIN_TOXIC_SHARE = 0.01
MIN_LOG_ODDS = 1.2
MIN_STEM, MAX_STEM = 4, 8
# Edits allowed in whole words of at least this length.
EDITS = 1
MIN_FUZZY_LENGTH = 5
# Words on either side that make a term's context.
CONTEXT = 8
QUOTE_MARKS = "\"“”„«»‹›"
QUOTING = frozenset(
    "said says wrote writes called calls quote quoted quotes told according claimed".split()
)
_TOKEN = re.compile(rf"\w+|[{QUOTE_MARKS}]")
_DEAD = 0


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # matches every word that begins with it
    weight: float


class Automaton:
    """The lexicon's trie intersected with Levenshtein automata, made deterministic as
    words need it.

    A state is a set of (trie node, edits so far), with the greatest weight of the
    stems read in full.  A letter moves along the trie; with an edit left it may also
    be an extra one (the node stays), stand for another one (to any child), follow a
    missing one (through any child), or begin two that changed places: that waits for the
    other one.  Transitions are kept, so most words cost a few
    look-ups until no node is left.
    """

    MAX_STATES = 50_000

    def __init__(self, terms: Iterable[Term], edits: int = EDITS):
        self.edits = edits
        self.children: list[dict[str, int]] = [{}]
        self.words: list[float] = [0.0]
        self.fuzzy: list[bool] = [False]
        self.stems: list[float] = [0.0]
        for term in terms:
            node = 0
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.words.append(0.0)
                    self.fuzzy.append(False)
                    self.stems.append(0.0)
                node = self.children[node][letter]
            if term.stem:
                self.stems[node] = max(self.stems[node], term.weight)
            else:
                self.words[node] = max(self.words[node], term.weight)
                self.fuzzy[node] = len(term.text) >= MIN_FUZZY_LENGTH
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.results: list[tuple[float, float]] = []
        self._number((frozenset(), frozenset(), 0.0))
        self.start = self._number((self._closed({(0, 0)}), frozenset(), 0.0))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            nodes, _, stem = state
            exact = max([stem, *(self.words[n] for n, e in nodes if e == 0)])
            near = [self.words[n] for n, e in nodes if e and self.fuzzy[n]]
            self.results.append((exact, 0.0 if exact else max(near, default=0.0)))
        return self.numbers[state]

    def _closed(self, nodes: set[tuple[int, int]]) -> frozenset:
        """With what follows by leaving out letters; the fewest edits of each node."""
        least: dict[int, int] = {}
        todo = sorted(nodes, key=lambda x: x[1])
        while todo:
            node, edits = todo.pop(0)
            if least.get(node, self.edits + 1) > edits:
                least[node] = edits
                if edits < self.edits:
                    todo += [(child, edits + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def _move(self, number: int, letter: str) -> int:
        nodes, swaps, stem = self.states[number]
        reached = {(node, edits) for node, wanted, edits in swaps if wanted == letter}
        begun: set[tuple[int, str, int]] = set()
        for node, edits in nodes:
            child = self.children[node].get(letter)
            if child is not None:
                reached.add((child, edits))
                if edits == 0:
                    stem = max(stem, self.stems[child])
            if edits < self.edits:
                reached.add((node, edits + 1))
                for other, c in self.children[node].items():
                    reached.add((c, edits + 1))
                    # The trie has this letter and the next one the other way round.
                    swapped = self.children[c].get(letter)
                    if other != letter and swapped is not None:
                        begun.add((swapped, other, edits + 1))
        return self._number((self._closed(reached), frozenset(begun), stem))

    def match(self, word: str) -> tuple[float, float]:
        """(weight of a word or stem read exactly, else weight of a word near it)."""
        if len(self.states) > self.MAX_STATES:
            self._reset()
        moves, state = self.moves, self.start
        for letter in word:
            to = moves[state].get(letter)
            if to is None:
                to = moves[state][letter] = self._move(state, letter)
            state = to
            if not self.states[state][0] and not self.states[state][1]:
                break
        return self.results[state]


class _Matches(dict):
    """word -> match, filled on demand; bounded."""

    def __init__(self, automaton: Automaton, limit: int = 500_000):
        super().__init__()
        self.automaton = automaton
        self.limit = limit

    def __missing__(self, word: str) -> tuple[float, float] | None:
        if len(self) >= self.limit:
            self.clear()
        found = self.automaton.match(word)
        value = found if found != (0.0, 0.0) else None
        self[word] = value
        return value


# Where a quotation of each mark may end; the straight mark opens and closes.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹"}
# Tokens that a quotation has at most; a mark without its other end opens none.
QUOTE_SPAN = 60


def quotations(tokens: list[str]) -> np.ndarray:
    """Which tokens stand within a pair of quote marks.

    Read from left to right: a mark opens a quotation if one that closes it follows
    within ``QUOTE_SPAN`` tokens, and reading goes on behind that; else it opens none.
    What stands between two quotations is in neither.
    """
    inside = np.zeros(len(tokens), bool)
    marks = [i for i, t in enumerate(tokens) if t in QUOTE_MARKS]
    k = 0
    while k < len(marks):
        begin = marks[k]
        ends = CLOSING.get(tokens[begin], "")
        close = next(
            (j for j in range(k + 1, len(marks))
             if tokens[marks[j]] in ends or marks[j] - begin > QUOTE_SPAN), None
        )
        if close is not None and marks[close] - begin <= QUOTE_SPAN:
            inside[begin + 1 : marks[close]] = True
            k = close
        k += 1
    return inside


FEATURES = ("bias", "exact", "near", "quoted", "density", "window", "distinct", "length")


def features(text: str | None, matches: _Matches) -> list[float]:
    """What the classifier sees of a text.

    Sums of the weights of terms read exactly, of terms one edit away, and of terms in
    a quotation (between a pair of marks, or a quoting word just before); all weights by
    the root of the length; the greatest sum within a context window; the number of
    distinct terms; the length.
    """
    tokens = _TOKEN.findall((text or "").lower())
    hits = [(i, m) for i, m in enumerate(map(matches.__getitem__, tokens)) if m is not None]
    if not hits:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(len(tokens))]
    exact = near = quoted = window = 0.0
    inside: np.ndarray | None = None
    recent: list[tuple[int, float]] = []
    for i, (strict, loose) in hits:
        weight = strict + loose
        if inside is None:
            inside = quotations(tokens)
        if inside[i] or not QUOTING.isdisjoint(tokens[max(0, i - 3) : i]):
            quoted += weight
            continue
        exact += strict
        near += loose
        recent = [(j, w) for j, w in recent if i - j <= 2 * CONTEXT] + [(i, weight)]
        window = max(window, sum(w for _, w in recent))
    total = exact + near
    return [
        1.0, math.log1p(exact), math.log1p(near), math.log1p(quoted),
        total / math.sqrt(len(tokens) + 20), math.log1p(window),
        math.log1p(len({tokens[i] for i, _ in hits})), math.log1p(len(tokens)),
    ]


def fit(rows: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, with a ridge penalty."""
    weights = np.zeros(rows.shape[1])
    ridge = np.full(rows.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        gradient = rows.T @ (p - labels) + ridge * weights
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in range(MIN_STEM, min(MAX_STEM, len(word) - 1) + 1)]


def choose_terms(
    counts: Iterable[tuple[str, bool, int, int]], toxic_docs: int, clean_docs: int
) -> list[Term]:
    """The words and stems that tell toxic documents, by log odds of their presence.

    A stem within a stem stays only if it is clearly the better evidence.  A word that
    tells toxic documents stays beside its stems, which are read without edits: it is
    what a misspelling is near to.  ``MAX_TERMS`` holds for stems and for words.
    """
    def odds(toxic: int, clean: int) -> float:
        return math.log((toxic + 0.5) / (toxic_docs + 1)) - math.log(
            (clean + 2) / (clean_docs + 2)
        )

    least = max(MIN_TOXIC_DOCS, MIN_TOXIC_SHARE * toxic_docs)

    able = {
        (text, stem): (odds(toxic, clean), toxic)
        for text, stem, toxic, clean in counts
        if toxic >= least and odds(toxic, clean) >= MIN_LOG_ODDS
        # Chance: the excess over what clean documents suggest, in standard deviations.
        and toxic - toxic_docs * clean / max(1, clean_docs)
        > 4 * math.sqrt(max(1.0, toxic_docs * (clean + 1) / max(1, clean_docs)))
    }
    kept: dict[tuple[str, bool], tuple[float, int]] = {}
    for (text, stem), (weight, toxic) in sorted(able.items(), key=lambda x: (len(x[0][0]), not x[0][1])):
        shorter = [kept[s, True] for s in stems_of(text) if (s, True) in kept] if stem else []
        if not shorter or weight > max(w for w, _ in shorter) + 0.3:
            kept[text, stem] = (weight, toxic)
    best = sorted(kept.items(), key=lambda x: (-x[1][0] * math.sqrt(x[1][1]), x[0]))
    stems, words = ([t for t in best if t[0][1] == stem] for stem in (True, False))
    return [
        Term(text, stem, weight)
        for (text, stem), (weight, _) in stems[:MAX_TERMS] + words[:MAX_TERMS]
    ]


def count_terms(texts: Iterable[tuple[str | None, int]]) -> Counter:
    """(term, is stem, label) -> documents with it."""
    found: Counter = Counter()
    for text, label in texts:
        words = {w for w in _TOKEN.findall((text or "").lower()) if len(w) > 2}
        for word in words:
            found[word, False, label] += 1
        for stem in {s for w in words for s in stems_of(w)}:
            found[stem, True, label] += 1
    return found


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    weights: tuple[float, ...]

    def score(self, seen: list[float]) -> float:
        value = sum(a * b for a, b in zip(seen, self.weights, strict=True))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, value))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label must not be learned; false for a null id."""
    fold = F.crc32(F.col(id_col).cast("string")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "toxic", limit: int = SAMPLE_ROWS,
) -> DataFrame:
    """Distinct labelled texts outside the held-out fold: text, label.

    About ``limit`` labelled rows are drawn by a hash of the id: the fit needs no more,
    and its cost doesn't grow with the corpus.  A text with both labels counts as toxic.
    """
    label = F.col(label_col).cast("int")
    known = (
        labels.select(F.col(label_id_col).cast("long").alias("doc_id"), label.alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    some = drawn(known, "doc_id", limit)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    # The sample's size is bounded by its limit.
    joined = texts.join(F.broadcast(some), F.col("id") == F.col("doc_id"))
    return joined.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(
        F.max("label").alias("label")
    )


def learn(train: DataFrame) -> Model:
    """Fit the lexicon and the classifier on rows of text and label (0 or 1)."""
    train = stored(train, "toxicity-train")
    sizes = dict(train.groupBy("label").count().collect())
    toxic_docs, clean_docs = sizes.get(1, 0), sizes.get(0, 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_terms(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()),
                 pa.array([k[1] for k in keys], pa.bool_()),
                 pa.array([n if k[2] else 0 for k, n in found.items()], pa.int64()),
                 pa.array([0 if k[2] else n for k, n in found.items()], pa.int64())],
                ["term", "stem", "toxic", "clean"],
            )

    counts = (
        train.select("text", "label")
        .mapInArrow(counted, "term string, stem boolean, toxic long, clean long")
        .groupBy("term", "stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= MIN_TOXIC_DOCS)
        # Roughly MIN_LOG_ODDS; exactly so in choose_terms.
        .where(F.col("toxic") * (clean_docs + 1) > 2 * F.col("clean") * (toxic_docs + 1))
    )
    terms = tuple(
        choose_terms([tuple(r) for r in counts.collect()], toxic_docs, clean_docs)
    )

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(Automaton(terms))
        for batch in batches:
            rows = [features(t.as_py(), matches) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "label"]
            )

    rows = train.select("text", "label").mapInArrow(seen, "x array<double>, label int").collect()
    rows.sort()
    if not rows:
        # Nothing is known: rarely toxic.
        return Model(terms, (-3.0, *[0.0] * (len(FEATURES) - 1)))
    weights = fit(np.array([r.x for r in rows]), np.array([r.label for r in rows], float))
    return Model(terms, tuple(weights.tolist()))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "toxic", threshold: float = THRESHOLD,
) -> DataFrame:
    """Score every text by a model learned outside the held-out fold.

    The lexicon and the weights come from the labelled rows; the score of a text
    depends on nothing but the text.

    Result, one row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted
    (1 from ``threshold`` on).  Null and empty texts have the score of a text without
    words.  A null id is never held out and never learned from; labels other than 0
    and 1 are ignored; without labels every text has one low score.  Repeated rows
    stay; other columns are ignored; an empty table gives an empty result.
    """
    model = learn(training_rows(docs, labels, id_col, text_col, label_id_col, label_col))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(Automaton(model.terms))
        for batch in batches:
            scores = [model.score(features(t.as_py(), matches)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.select("doc_id", held_out().alias("held_out"), "text")
    return picked.mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int"
    )
