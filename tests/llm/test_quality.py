"""Quality rules against plain Python, and against the labels."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import quality as Q
from millrace.llm.queries import QUERIES
from tests.conftest import SF, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return [
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    ]


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n\t#É\x0b\x1c\u2003|", max_size=120))
def test_base_counts(text):
    assert Q.describe(text, {})[0] == plain_base(text)


@pytest.mark.parametrize("text", [None, "", " \n", "a b " * 40, "x " * 100_000])
def test_base_counts_of_special_texts(text):
    assert Q.describe(text, {})[0] == plain_base(text)


def test_query_equals_brute_force(spark):
    got = QUERIES["op6_quality_rules"](spark, SF_SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    tables = {k: {w: i for i, w in enumerate(dict.fromkeys(v.split()))}
              for k, v in Q.COMMON_WORDS.items()}
    failed, histograms, references = {}, {}, {}
    for i, doc in docs.items():
        base, chars, words = Q.describe(doc.text, tables[doc.lang])
        assert base == plain_base(doc.text)
        failed[i] = base[0] < 20 or 100 * base[4] > 30 * base[0]
        histograms[i] = chars, words
    once = {(d.lang, d.text): i for i, d in docs.items() if not failed[i]}
    for lang in tables:
        members = [i for (at, _), i in once.items() if at == lang]
        if len(members) >= Q.MIN_REFERENCE:
            references[lang] = [
                [sum(col) for col in zip(*(histograms[i][k] for i in members))] for k in (0, 1)
            ]
    assert len(got) == len(docs) and references

    def distance(p, q):
        p, q = ([x / sum(v) for x in v] for v in (p, q))
        m = [(x + y) / 2 for x, y in zip(p, q)]
        half = [sum(x * math.log2(x / z) for x, z in zip(v, m) if x) for v in (p, q)]
        return math.sqrt(sum(half) / 2)

    for row in got:
        doc = docs[row.doc_id]
        n = row.n_words
        assert list(row)[1:6] == plain_base(doc.text)
        assert row.base_failed == failed[row.doc_id]
        kept = not row.base_failed
        if kept and n >= Q.MIN_JUDGED_WORDS and doc.lang in references:
            char, word = map(distance, histograms[row.doc_id], references[doc.lang])
            kept = not (char > 0.06 + 0.6 / math.sqrt(n) and word > 0.25)
        assert row.kept == kept
    assert {r.kept for r in got} == {True, False}


def test_verdict_against_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = QUERIES["op6_quality_rules"](spark, SF).join(labels, "doc_id")
    judged = judged.where("not base_failed")
    row = judged.agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"),
        F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad"),
    ).first()
    assert row.good > 0.99 and row.bad < 0.25


def test_edge_rows(spark):
    text = "the cat and the dog went to a house by the sea and it was good for them all x"
    rows = [(1, text, "en", 1), (1, text, "en", 1), (None, None, None, 2), (3, "", "xx", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    got = Q.quality_rules(frame).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=repr) == sorted(
        [(1, 20, True), (1, 20, True), (None, 0, False), (3, 0, False)], key=repr
    )
    assert all(r.char_distance is None for r in got)
    many = [(i, text + f" {i}", "en", 0) for i in range(30)] + [(99, "", "en", 0)]
    judged = Q.quality_rules(spark.createDataFrame(many, frame.schema)).collect()
    assert {r.doc_id for r in judged if r.char_distance is None} == {99}
    assert Q.quality_rules(frame.limit(0)).collect() == []


def test_languages_beside_the_given_ones_are_judged(spark):
    rng = random.Random(5)
    common = "och att det som en på är av för med till den har de inte om ett han men var".split()
    rare = ["".join(rng.choices("abdefgiklmnorstu", k=rng.randrange(4, 9))) for _ in range(2000)]
    prose = lambda: ". ".join(
        " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(12))
        for _ in range(10)
    )
    junk = lambda: " ".join(
        "".join(rng.choices("#*$%&|<>XQZ", k=rng.randrange(1, 7))) for _ in range(120)
    )
    texts = [(prose(), 1) for _ in range(120)] + [(junk(), 0) for _ in range(2)]
    for tags in (["sv"], [None, "und", ""], ["SV", "sv-SE", "sv_FI"]):
        rows = [(i, text, rng.choice(tags)) for i, (text, _) in enumerate(texts)]
        rows += [(1000, junk(), tags[0]), (1000, junk(), tags[0])]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = Q.quality_rules(frame).collect()
        assert len(got) == len(rows) and not any(r.base_failed for r in got)
        assert {r.doc_id for r in got if r.kept} == {i for i, (_, good) in enumerate(texts) if good}
        assert {r.word_distance is None for r in got} == {None in tags}
        assert {r.lang for r in got} <= set(tags)
    words = Q.common_words(spark.createDataFrame(texts * 2, "text string, n int").selectExpr("*", "'sv-SE' as lang"))
    assert set(words) == {"sv"} and set(words["sv"][:20]) == set(common)
    english = spark.createDataFrame([(i, junk() if i < 3 else
        " ".join(rng.choice("the of and to in a is that it was".split() if rng.random() < 0.5 else rare) for _ in range(120)),
        rng.choice(["EN", "en-US"])) for i in range(60)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in Q.quality_rules(english).collect() if not r.kept} == {0, 1, 2}
