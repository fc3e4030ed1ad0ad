"""The Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import jaccard as J
from millrace.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def plain_set(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_groups(sets, percent=85):
    """The least number reached, by comparing all pairs."""
    component = list(range(len(sets)))

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if not a or not b or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                continue
            if 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                component[high] = low
    return [root(i) for i in range(len(sets))]


def checked(spark, rows, **more):
    """Compare with all pairs; returns how many rows are linked to a smaller id."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = J.jaccard_components(frame.repartition(3), **more).collect()
    sets = [plain_set(t) for _, t, _ in rows]
    groups = plain_groups(sets, more.get("percent", 85))
    least = {}
    for (doc, _, _), g in zip(rows, groups):
        ids = [x for x in (least.get(g), doc) if x is not None]
        least[g] = min(ids, default=None)
    want = [
        (d, len(s), least[g] if s else d) for (d, _, _), s, g in zip(rows, sets, groups)
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return sum(d != c for d, _, c in want)


def test_query_equals_brute_force(spark):
    got = QUERIES["op12_jaccard_join"](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    sets = [plain_set(d.text) for d in docs]
    groups = plain_groups(sets)
    least = {}
    for d, g in zip(docs, groups):
        least[g] = min(least.get(g, d.doc_id), d.doc_id)
    want = {d.doc_id: (len(s), least[g]) for d, s, g in zip(docs, sets, groups)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert sum(d != c for d, (_, c) in want.items()) > 10


def changed(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            words.insert(at, f"n{rng.randrange(10**6)}")
        elif at < len(words):
            words[at : at + 1] = [] if kind == 1 else [f"c{rng.randrange(10**6)}"]
    return words


@pytest.mark.parametrize(
    "seed, percent, part, shingles", [(1, 85, 1024, 1 << 19), (2, 60, 7, 500), (3, 95, 1024, 40)]
)
def test_copies_at_the_limit(spark, seed, percent, part, shingles):
    rng = random.Random(seed)
    rows = []
    for size in (4, 5, 7, 9, 12, 20, 33, 50, 51, 80, 130, 250, 400):
        base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
        for _ in range(14):
            changes = rng.randrange(0, 1 + max(1, size // 18))
            rows.append((len(rows), " ".join(changed(rng, base, changes)), "x"))
    # A passage that many short texts share, and repeated words.
    line = " ".join(f"p{i}" for i in range(12))
    rows += [(1000 + i, f"{line} own{i} {i} " + "ha " * (i % 9), "x") for i in range(60)]
    assert checked(spark, rows, percent=percent, part=part, part_shingles=shingles) > 30


def test_edge_rows(spark):
    rows = [
        (5, "a b c d e", None), (5, "a b c d e", "x"), (None, "A b\x0bc  d e", "x"), (3, None, "x"),
        (4, "", "x"), (2, " \t\n", "x"), (2, "a b", "x"), (1, "A  B", "x"), (9, "b a", "x"),
        (None, "no one else has these words", "x"), (8, "a b c", "x"), (7, "a b c c", "x"),
        (None, None, "x"), (11, "long " * 200_000, "x"), (10, "long " * 9, "x"),
    ]
    assert checked(spark, rows) > 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(empty).collect() == []


def texts_of(sizes, rng):
    return pa.array([" ".join(rng.choice("abcdefg") + str(rng.randrange(9)) for _ in range(n)) for n in sizes])


def test_sets_equal_plain_ones():
    rng = random.Random(4)
    texts = texts_of([0, 1, 2, 3, 4, 5, 9, 60, 300, 0, 4], rng).slice(1)
    found = J.shingle_sets(texts)
    assert found.sizes.tolist() == [len(plain_set(t.as_py())) for t in texts]
    again = J.shingle_sets(pa.array(["b a", None, "a b", "a b c d", "a b c"]))
    assert len(set(again.hashes.tolist())) == 4


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([70, 85, 95]))
def test_weights_tell_all_similar_pairs(size, seed, percent):
    """Whatever a set drops within its spare weight, a similar one shares a key."""
    rng = np.random.default_rng(seed)
    schemes = J.Schemes(percent, 1000)
    base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    gone = rng.integers(0, size // 4 + 1)
    new = rng.integers(0, 1 << 63, rng.integers(0, size // 4 + 1), dtype=np.uint64)
    one, two = np.unique(base), np.unique(np.concatenate((base[gone:], new)))
    common = len(np.intersect1d(one, two))
    if not len(two) or 100 * common < percent * (len(one) + len(two) - common):
        return
    sets = J.Sets(np.concatenate((one, two)), np.cumsum([0, len(one), len(two)]))
    found = J.signatures(sets, schemes)
    smaller = schemes.edges.searchsorted(min(len(one), len(two)), "right") - 1
    for prober in (0, 1):
        own = (found["owner"] == prober) & (found["place"] >> 32 == smaller)
        others = set(found["key"][(found["owner"] != prober)].tolist())
        met = {
            p for k, p in zip(found["key"][own].tolist(), found["place"][own].tolist())
            if k in others
        }
        # Even with its costliest segments gone, one that both share is left.
        weights = dict(zip(found["place"][own].tolist(), found["weight"][own].tolist()))
        spare = found["spare"][own][0]
        assert sum(weights[p] for p in met) > spare


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (3, 100, 900):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        two = [np.unique(base), np.unique(base[size // 5 :])]
        sets = J.Sets(np.concatenate(two), np.cumsum([0, *map(len, two)]))
        for width in J.SKETCHES:
            a, b = (np.frombuffer(x, np.uint8) for x in J.parities(sets, width))
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(*two))


def test_forest_of_a_chain():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(base[i * 10 : i * 10 + 200]) for i in range(20)]
    sets += [np.unique(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(5)]
    links = J.similar_forest(sets, 85)
    assert sorted((min(x), max(x)) for x in links) == [(i, i + 1) for i in range(19)]
