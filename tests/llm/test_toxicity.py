"""The automaton against edit distances; the scores against held-out labels."""

import random
import zlib

import numpy as np
import pytest

from millrace.llm import toxicity as T
from millrace.llm.queries import QUERIES
from tests.conftest import SF


def edits(a, b):
    """Levenshtein distance in which two neighbours that changed places are one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            least = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, rows[-2][j - 2] + 1)
            row.append(least)
        rows.append(row)
    return rows[-1][-1]


@pytest.mark.parametrize("limit", [1, 2])
def test_automaton(limit):
    rng = random.Random(limit)
    make = lambda: "".join(rng.choices("abc", k=rng.randrange(1, 9)))
    terms = [T.Term(make(), rng.random() < 0.2, rng.uniform(1, 5)) for _ in range(25)]
    automaton = T.Automaton(terms, limit)
    words = [make() for _ in range(1500)] + ["", "abcabcabcabcabcabc"]
    words += [t.text + "x" for t in terms] + [t.text[1:] for t in terms]
    for small in (50_000, 3):
        automaton.MAX_STATES = small
        for word in words:
            exact = max(
                [t.weight for t in terms
                 if (word.startswith(t.text) if t.stem else word == t.text)],
                default=0.0,
            )
            near = max(
                [t.weight for t in terms if not t.stem and len(t.text) >= 5
                 and 0 < edits(word, t.text) <= limit],
                default=0.0,
            )
            assert automaton.match(word) == (exact, 0.0 if exact else near)


def test_quotations_are_told_from_abuse():
    terms = [T.Term("idiot", False, 4.0)]
    seen = lambda t: dict(zip(T.FEATURES, T.features(t, T._Matches(T.Automaton(terms)))))
    abuse, quote, told = seen("you idiot !"), seen('he wrote: "you idiot" there'), seen("he said idiot")
    assert abuse["exact"] > 0 and abuse["quoted"] == 0
    assert quote["exact"] == told["exact"] == 0 and quote["quoted"] > 0 and told["quoted"] > 0
    assert seen("you idi0t")["near"] > 0 and seen("you idi0t")["exact"] == 0
    assert seen(None) == seen("") and seen("")["bias"] == 1.0


def test_misspelled_toxic_words_are_near_the_learned_lexicon(spark):
    rng = random.Random(3)
    abuse = ["trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown"]
    plain = "table river window garden letter market summer winter bridge station".split()
    text = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=12), *more], 12 + len(more)))
    rows = [(text(word, "you"), 1) for word in abuse for _ in range(20)]
    rows += [(text(word[0] + "#" + word[2:]).replace("#", "q"), 1) for word in abuse for _ in range(8)]
    rows += [(text("you"), 0) for _ in range(500)]
    model = T.learn(spark.createDataFrame(rows, "text string, label int"))
    matches = T._Matches(T.Automaton(model.terms))
    score = lambda t: model.score(T.features(t, matches))
    assert {t.text for t in model.terms if not t.stem} >= set(abuse)
    for word in abuse:
        # A letter too few, another one, two and one too many, all within the first four.
        for bad in (word[:2] + word[3:], word[0] + "x" + word[2:], word[:3] + "x" + word[3:]):
            assert matches[bad] is not None and matches[bad][1] > 0, bad
            assert score(text(bad, "you")) >= T.THRESHOLD, bad
    assert score(text("you")) < T.THRESHOLD


def plain_quotations(text):
    """Words within quote marks, character by character."""
    pairs = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹"}
    pieces = T._TOKEN.findall(text)
    quoted, i = [], 0
    while i < len(pieces):
        if pieces[i] in pairs:
            for j in range(i + 1, min(len(pieces), i + 61)):
                if pieces[j] in pairs[pieces[i]]:
                    quoted += pieces[i + 1 : j]
                    i = j
                    break
        i += 1
    return quoted


def test_quotations_equal_a_plain_reader():
    rng = random.Random(3)
    for _ in range(3000):
        marks = rng.choice(['"', "“”", "„“", "«»", '"“”', "»«"])
        text = " ".join(
            rng.choice(marks) if rng.random() < 0.25 else f"w{i}" for i in range(rng.randrange(90))
        )
        tokens = T._TOKEN.findall(text)
        inside = T.quotations(tokens)
        assert [t for t, q in zip(tokens, inside) if q] == plain_quotations(text), text


@pytest.mark.parametrize("text, quoted", [
    ('"you idiot"', True), ('x "you idiot"', True), ('"a b" you idiot "c d"', False),
    ("“you idiot” x", True), ('6" idiot', False), ("idiot", False), ("he said idiot", True),
    ('"a" "b" idiot', False), ("„du idiot“", True),
])
def test_quoted_abuse_is_told_from_abuse(text, quoted):
    matches = T._Matches(T.Automaton([T.Term("idiot", False, 3.0)]))
    row = dict(zip(T.FEATURES, T.features(text, matches)))
    assert (row["quoted"] > 0, row["exact"] > 0) == (quoted, not quoted)


def test_two_letters_that_changed_places_are_one_edit():
    automaton = T.Automaton([T.Term("idiot", False, 3.0), T.Term("moron", False, 2.0)])
    for bad in ("idoit", "diiot", "idito", "ditio"[:0] or "iidot"):
        assert automaton.match(bad)[1] == 3.0, bad
    assert automaton.match("omron") == (0.0, 2.0)
    for far in ("ditoi", "dioti", "omorn", "idoits"):
        assert automaton.match(far) == (0.0, 0.0), far


# The smaller tables have too few toxic rows in each language to learn from.
SF_LABELS = "/root/testdata/sf0.1"


def test_query_on_the_held_out_fold(spark):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF_LABELS).collect()}
    docs = spark.read.parquet(f"{SF_LABELS}/documents.parquet")
    rows = spark.read.parquet(f"{SF_LABELS}/labels.parquet").collect()
    labels = {r.doc_id: r.toxic for r in rows}
    assert len(got) == docs.count()
    for row in got.values():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.3)
    test = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    toxic = [s for s, y in test if y]
    clean = [s for s, y in test if not y]
    above = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert above > 0.95
    assert np.mean([s >= 0.3 for s in toxic]) >= 0.9
    assert np.mean([s >= 0.3 for s in clean]) <= 0.02


def test_held_out_labels_are_never_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr(
        "doc_id", "if(crc32(string(doc_id)) % 4 = 2, 1 - toxic, toxic) as toxic"
    )
    a, b = T.toxicity(docs, labels), T.toxicity(docs, turned)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_the_score_depends_on_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = T.learn(T.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    matches = T._Matches(T.Automaton(model.terms))
    text = docs.first().text
    assert model.score(T.features(text, matches)) == model.score(T.features(text, matches))


def test_the_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert 0 < T.training_rows(docs, labels, limit=20).count() <= 45


def test_edge_rows(spark):
    rows = [(1, "you scum", "x"), (1, "you scum", "x"), (None, None, None), (2, "", "y"),
            (3, "scum " * 50_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    kinds = "doc_id long, quality int, toxic int, text string"
    none = spark.createDataFrame([], kinds)
    some = spark.createDataFrame(
        [(i, 1, t, "clash") for i, t in ((1, 1), (1, 0), (2, 0), (None, 1), (3, None), (9, 7))], kinds
    )
    for labels in (none, some):
        labels = labels.withColumnRenamed("quality", "score")
        got = T.toxicity(frame, labels).collect()
        assert sorted((r.doc_id for r in got), key=repr) == [1, 1, 2, 3, None]
        assert all(0 <= r.score <= 1 for r in got)
        by_id = {r.doc_id: r for r in got}
        assert by_id[None].held_out is False and by_id[None].score == by_id[2].score
    assert T.toxicity(frame.limit(0), some).collect() == []
