"""Shards: the law, the slots, and how many links are cut."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm import sharding as S
from millrace.llm.common import numbered, placed
from millrace.llm.queries import QUERIES
from tests.conftest import SF


def check_law(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards))
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_balanced_shards"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    check_law(got, 40)
    groups = defaultdict(set)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        groups[docs[r.doc_id]].add(r.shard)
    # Every group is smaller than a shard here, so none needs to be cut.
    assert max(map(len, groups.values())) == 1
    assert QUERIES["op8_balanced_shards"](spark, SF).subtract(
        spark.createDataFrame(got, QUERIES["op8_balanced_shards"](spark, SF).schema)).count() == 0


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_groups_of_all_sizes(spark, shards):
    rng = random.Random(shards)
    texts = ["hot"] * 170 + ["warm"] * 60 + ["a", "a", "b", "b", "b"] * 9 + [None, "", ""]
    texts += [f"pair{i // 2}" for i in range(80)] + [f"single{i}" for i in range(101)]
    rng.shuffle(texts)
    rows = [(i if i % 50 else None, t, i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    got = S.balanced_shards(frame, shards).collect()
    assert len(got) == len(rows)
    check_law(got, shards)
    capacity = len(rows) // shards
    crc = lambda t: zlib.crc32((t or "").encode())
    homes = defaultdict(Counter)
    for r in got:
        homes[r.text_crc32][r.shard] += 1
    together = 0
    for text, n in Counter(t or "" for _, t, _ in rows).items():
        if text.startswith("pair"):
            together += len(homes[crc(text)]) == 1
        if text == "hot":
            # So crowded, too few rows can make room for all of it.
            best = homes[crc(text)].most_common(-(-n // capacity))
            assert sum(k for _, k in best) >= 0.7 * n


    assert together >= 38


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string")
    got = S.balanced_shards(frame).collect()
    check_law(got, 40)
    assert len(got) == 3
    assert S.balanced_shards(frame.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(
    st.dictionaries(
        st.tuples(st.integers(0, 5), st.integers(0, 5)).filter(lambda x: x[0] != x[1]),
        st.integers(1, 50), max_size=20),
    st.dictionaries(st.integers(0, 5), st.integers(0, 60)),
)
def test_moves_keep_the_quotas(wanted, free):
    granted, fill = S.plan_moves(wanted, free)
    net, left = Counter(), Counter()
    for (a, b), n in [*granted.items(), *fill.items()]:
        assert n > 0
        net[a] -= n
        net[b] += n
    for (a, _), n in fill.items():
        left[a] += n
    assert not any(net.values())
    assert all(n <= free.get(a, 0) for a, n in left.items())
    assert all(n <= wanted[k] for k, n in granted.items())
    # With room enough every wish is granted.
    plenty = {s: 10_000 for s in range(6)}
    assert S.plan_moves(wanted, plenty)[0] == wanted


def test_numbers_are_gapless(spark):
    rows = [(i % 3, i // 2, None if i % 7 else "x") for i in range(500)]
    frame = spark.createDataFrame(rows, "k int, o long, v string").repartition(9)
    got = numbered(placed(frame, "at", "test"), ["k", "v"], ["o", "at"], "n").collect()
    seen = defaultdict(list)
    for r in got:
        seen[r.k, r.v].append(r.n)
    assert sum(map(len, seen.values())) == 500
    assert all(sorted(n) == list(range(len(n))) for n in seen.values())


def test_equal_rows_are_dealt_to_many_parts(spark, monkeypatch):
    """100,000 rows without id or text: no window holds more than a few thousand."""
    monkeypatch.setattr(common, "PART_ROWS", 1_000)
    frame = spark.range(100_000).selectExpr("cast(null as long) doc_id", "'' text")
    got = S.balanced_shards(frame, 4)
    assert [tuple(r) for r in got.groupBy("shard").agg(
        F.count("*"), F.min("slot"), F.max("slot"), F.countDistinct("slot")
    ).orderBy("shard").collect()] == [(s, 25_000, 0, 24_999, 25_000) for s in range(4)]
    links = placed(S.with_links(frame).withColumn("all", F.lit(0)), "place", "test")
    rows = numbered(links, ["all"], ["doc_id", "g0", "g1", "g2", "place"], "row")
    assert rows.agg(F.countDistinct("row"), F.max("row")).first()[:] == (100_000, 99_999)
    # As `numbered` deals them.
    dealt = links.groupBy(F.expr("pmod(xxhash64(doc_id, g0, g1, g2, place), 100)")).count()
    assert dealt.count() == 100
    assert dealt.agg(F.max("count")).first()[0] < 1_300


def test_very_long_texts(spark):
    frame = spark.createDataFrame([(i, "é" * 3_000_000) for i in (1, 2)] + [(3, "x")],
                                  "doc_id long, text string")
    got = S.balanced_shards(frame, 1).collect()
    assert sorted(r["size"] for r in got) == [17, 6_000_016, 6_000_016]
    check_law(got, 1)
