"""SimHash near duplicates against plain Python."""

import random

import pytest
import xxhash

from millrace.llm import simhash as S
from millrace.llm.components import connected_components
from millrace.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def plain_fingerprint(text, words=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    parts = [w for w in lowered.split(" ") if w]
    if not parts:
        return 0
    shingles = [parts[i : i + words] for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    bits = [sum(h >> b & 1 for h in hashes) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(hashes))


def plain_components(prints, distance=4):
    """doc_id -> least doc_id reached, by comparing all pairs."""
    component = {d: d for d, _ in prints}

    def root(d):
        while component[d] != d:
            d = component[d]
        return d

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= distance:
                low, high = sorted((root(a), root(b)))
                component[high] = low
    return {d: root(d) for d, _ in prints}


TEXTS = [None, "", " \t ", "One", "one", "a b c", "a b c d", "A B C D e", "É é b c d",
         "x\x1cy z w v", "long " * 30000, "a  b\nc\x0bd"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    got = QUERIES["op9_simhash_near_dedup"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = plain_components(prints)
    assert len(got) == len(docs)
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in prints}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("part", [3, 1024])
def test_links_of_chains_and_large_groups(spark, monkeypatch, part):
    monkeypatch.setattr(S, "PART", part)
    rng = random.Random(1)
    prints = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randrange(12)):  # a chain: each within reach of the last
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                base ^= 1 << bit
            prints.add(base)
    rows = [(i, f - 2**64 if f >> 63 else f) for i, f in enumerate(sorted(prints))]
    frame = spark.createDataFrame(rows, "id long, fp long")
    links = S.near_links(frame.select("fp"))
    found = {r.node: r.component for r in connected_components(links).collect()}
    want = plain_components([(f, f % 2**64) for _, f in rows])
    groups = {}
    for f, c in want.items():
        groups.setdefault(c, set()).add(f)
    got = {}
    for _, f in rows:
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_edge_rows(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", None),
            (5, None, "y"), (4, "", "y"), (None, "quite different words in here", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = S.simhash_components(frame.withColumnRenamed("fp", "component_id")).collect()
    ids = sorted(((r.doc_id, r.component_id) for r in got), key=repr)
    assert ids == sorted(
        [(1, 1), (1, 1), (None, 1), (5, 4), (4, 4), (None, None)], key=repr
    )
    assert S.simhash_components(frame.limit(0)).collect() == []


@pytest.mark.parametrize("distance", [0, 4, 8])
def test_blocks_cover_all_bits(distance):
    for count in (1, 10**5, 10**12):
        blocks = S.block_edges(S.blocks_for(count, distance))
        assert sum(w for _, w in blocks) == 64
        assert len(blocks) > distance
