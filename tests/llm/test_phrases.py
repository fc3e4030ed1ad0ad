"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import phrases as P
from millrace.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def plain(rows, least=30, keep=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        seen = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    seen[tuple(words[i : i + m])] += 1
    out = []
    for lang, seen in counts.items():
        candidates = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner = p[i : i + m]
                    if 100 * a >= 80 * candidates[inner]:
                        covered.add(inner)
        found = []
        for p, a in candidates.items():
            if p in covered:
                continue
            cuts = []
            for k in range(1, len(p)):
                left, right = seen[p[:k]], seen[p[k:]]
                cuts.append((2000000 * a // (left + right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_query_equals_brute_force(spark):
    got = QUERIES["op11_collocations"](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = plain([(d.lang, d.text) for d in docs])
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) >= 50


@pytest.mark.parametrize("seed, hot_share, tasks", [(1, 1000, 10**6), (2, 8, 300), (3, 3, 50)])
def test_hot_words_and_small_tasks(spark, seed, hot_share, tasks):
    rng = random.Random(seed)
    words = ["the", "of", "The", "a", "é", "x\x00", "ß", "\U0001f600", "b", "c", "d"]
    rows = []
    for _ in range(300):
        text = ""
        for _ in range(rng.randrange(40)):
            text += rng.choices(words, [30, 20, 5, 9, 3, 2, 2, 2, 1, 1, 1])[0]
            text += rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "\x0b", "!"])
        rows.append((rng.choice(["en", "de", None, "", "und"]), text, "z"))
    rows += [("en", "click here now please " * 50, "z")] * 3
    rows += [("en", "One line that all share. " + c, "z") for c in "abc" * 20]
    rows += [("fr", None, None), (None, None, None), ("fr", "", "z"), ("fr", " . ", "z")]
    frame = spark.createDataFrame(rows, "lang string, text string, phrase string").repartition(5)
    got = P.collocations(frame, least=4, keep=50, hot_share=hot_share, task_suffixes=tasks)
    want = plain([r[:2] for r in rows], 4, 50)
    assert sorted(map(tuple, got.collect())) == want


def test_empty_table_and_long_text(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(frame).collect() == []
    text = "Aa bb. " * 200_000
    got = P.collocations(spark.createDataFrame([("en", text)], "lang string, text string"))
    assert [tuple(r) for r in got.collect()] == [
        ("en", 1, "aa bb", 200_000, 200_000, 200_000, 400_000, 1_000_000)
    ]


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 1), st.lists(st.integers(1, 3), min_size=2, max_size=4),
                       st.integers(1, 3)), max_size=60),
    st.integers(1, 8), st.sampled_from([1, 4, 1000]), st.booleans(),
)
def test_sizes_of_equal_partitions(rows, least, small, hot):
    keys = [np.array([r[0] for r in rows], np.int32)]
    keys += [
        np.array([r[1][d] if d < len(r[1]) else 0 for r in rows], np.int32) for d in range(4)
    ]
    weights = np.array([r[2] for r in rows], np.int64)
    route = np.array([3 if hot and r[1][0] == 1 else 2 for r in rows], np.int32)
    at, depth, count = P.quicksort_counts(keys, weights, route, least, small)
    got = {}
    for i, d, c in zip(at.tolist(), depth.tolist(), count.tolist()):
        key = (rows[i][0], *rows[i][1][:d])
        assert key not in got
        got[key] = c
    want = Counter()
    for lang, words, n in rows:
        for d in range(2, len(words) + 1):
            want[(lang, *words[:d])] += n
    hot_ones = {k for k in want if hot and len(k) == 3 and k[1] == 1}
    assert got == {k: v for k, v in want.items() if v >= least or k in hot_ones}


def test_hot_leading_words_are_few(spark):
    rows = [("en", "hot pair " + str(i)) for i in range(400)]
    rows += [("en", f"a{i} b{i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = P.word_counts(frame, 10).where("depth > 1").collect()
    assert {(r.gram, r.n) for r in found} == {("hot pair", 400)}
