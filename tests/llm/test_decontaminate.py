"""Decontamination against exhaustive scoring and plain search."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import decontaminate as D
from millrace.llm.queries import QUERIES
from tests.conftest import SF


def index_of(items):
    counted = [Counter(D.words_of(t)) for _, t in items]
    df = Counter(t for c in counted for t in c)
    mean = sum(c.total() for c in counted) / max(1, len(items))
    return D.build_index(items, len(items), mean, df), df, mean


def plain_scores(items, terms):
    """item -> share of its own BM25 score that the terms give."""
    counted = [Counter(D.words_of(t)) for _, t in items]
    df = Counter(t for c in counted for t in c)
    mean = sum(c.total() for c in counted) / len(items)
    out = {}
    for i, c in enumerate(counted):
        weights = {
            t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5))
            * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * c.total() / mean))
            for t, tf in c.items()
        }
        out[i] = sum(w for t, w in weights.items() if t in terms) / sum(weights.values())
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.9])
def test_wand_retrieves_all_above_the_threshold(threshold):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 30)))) for i in range(300)]
    index, _, _ = index_of(items)
    for _ in range(60):
        query = set(rng.sample(words, 25)) | set(rng.choice(items)[1].split()[:9])
        terms = sorted(index.term_of[t] for t in query if t in index.term_of)
        got = {}
        for block in range(index.n_blocks):
            got |= {
                index.item_ids[i]: x
                for i, x in D.block_max_wand(index, terms, threshold, block)
            }
        opened = D.open_blocks(
            np.zeros(len(terms), int), np.array(terms), 1, index, threshold
        )
        at = {i: k // D.BLOCK for k, i in enumerate(index.item_ids)}
        assert {at[i] for i in got} <= {b for _, b in opened}
        want = {i: s for i, s in plain_scores(items, query).items() if s >= threshold - 1e-9}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i]) for i in got)


def test_passages_have_their_distinct_terms():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.choice([1, 7, 63, 64, 65, 128, 300]) for _ in range(rng.randrange(1, 6))]
        texts = [[rng.randrange(-1, 12) for _ in range(n)] for n in sizes]
        flat = np.array([t for ts in texts for t in ts])
        passage, term, firsts = D.distinct_terms(sizes, flat, 64)
        want = []
        for k, ts in enumerate(texts):
            for p in range(max(1, -(-len(ts) // 64))):
                inside = {t for t in ts[p * 64 : (p + 2) * 64] if t >= 0}
                want += [(int(firsts[k]) + p, t) for t in inside]
        assert passage.tolist() == sorted(passage.tolist())
        assert sorted(zip(passage.tolist(), term.tolist())) == sorted(want)


def test_query_finds_the_items_in_the_documents(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_bm25_decontamination"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    flat = [(d.doc_id, " " + " ".join(D.words_of(d.text)) + " ") for d in docs]
    whole = {
        (d, i.item_id)
        for i in items
        for d, text in flat
        if " " + " ".join(D.words_of(i.text)) + " " in text
    }
    assert whole and whole <= got
    # What is found besides has most of the item's shingles.
    texts, sought = dict(flat), {i.item_id: D.words_of(i.text) for i in items}
    for d, i in got - whole:
        there = D.shingles(texts[d].split())
        mine = D.shingles(sought[i])
        assert sum(s in there for s in mine) >= 0.7 * len(mine)


def test_places_lengths_and_indexes(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 7, 40, 300])))) for i in range(30)]
    docs = []
    for i, text in items:
        filler = [word() for _ in range(rng.randrange(700))]
        cut = rng.randrange(len(filler) + 1)
        docs.append((i, " ".join(filler[:cut] + [text.upper().replace(" ", "\n ")] + filler[cut:])))
        docs.append((100 + i, " ".join(rng.sample(text.split(), len(text.split())) + filler)))
    docs += [(None, None), (500, ""), (501, items[0][1]), (501, items[0][1]), (None, items[1][1])]
    items += [(None, None), (77, " .,"), (78, "Who wrote it? Answer: ada lovelace of london")]
    docs += [(600, "so who wrote it they ask ... ada lovelace of london said nobody")]
    docs += [(601, "who wrote it is unknown")]
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    want = Counter((d, i) for d, t in docs for i, x in items
                   if D.words_of(x) and " " + " ".join(D.words_of(x)) + " "
                   in " " + " ".join(D.words_of(t)) + " ")
    want[600, 78] += 1
    for size in (D.INDEX_CHARS, 4000):
        monkeypatch.setattr(D, "INDEX_CHARS", size)
        monkeypatch.setattr(D, "UNIT_WORDS", size // 10)
        monkeypatch.setattr(D, "CELLS", size // 100)
        got = Counter((r.doc_id, r.item_id) for r in D.contaminated(left, right).collect())
        shuffled = {(100 + i, i) for i, t in items[:30] if len(t.split()) < 4}
        assert {k: n for k, n in got.items() if k not in shuffled} == {
            k: n for k, n in want.items() if k not in shuffled}
    assert D.contaminated(left.limit(0), right).collect() == []
    assert D.contaminated(left, right.limit(0)).collect() == []


def test_near_copies_of_items_without_a_marked_answer(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    run = lambda n: [word() for _ in range(n)]
    items = [run(40), run(40), run(15), run(40)]
    asked, answer = run(20), run(4)
    table = [(i, " ".join(x)) for i, x in enumerate(items)]
    table += [(9, " ".join([*asked, "Answer:", *answer]))]
    changed = [list(x) for x in items]
    changed[0][33] = "changed"  # in the middle of the last third: 31 of 36 shingles
    changed[1] = changed[1][:36]  # the last tenth is cut off: 32 of 36
    changed[2][14] = "changed"  # the last word: 10 of 11
    changed[3] = changed[3][:30]  # 26 of 36: too little
    docs = [(i, " ".join(run(50) + x + run(50))) for i, x in enumerate(changed)]
    docs += [(9, " ".join([*run(50), *asked, *run(50)]))]  # a marked answer isn't there
    got = D.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(table, "item_id long, text string"),
    ).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (2, 2)]
