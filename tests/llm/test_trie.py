"""The conversation trie against plain dictionaries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import trie as T
from millrace.llm.queries import QUERIES
from tests.conftest import SF, SF_SMALL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def plain(rows):
    """All node rows, from (conv, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, (role or "").encode(), (text or "").encode())
            own.setdefault(conv, []).append(key)
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        whole = tuple(own.get(conv - conv % 20, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(conv)
        ends.setdefault(whole, []).append(conv)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * words
        leaves[path] = leaves.get(path, 0) or 1
        if path:
            up = path[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[path]
            saved[up] = saved.get(up, 0) + saved[path]
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p],
            saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def got(frame):
    assert frame.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


@pytest.mark.parametrize("folder", [SF_SMALL, SF])
def test_query_equals_brute_force(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    want = plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert got(QUERIES["op13_conversation_trie"](spark, folder)) == want


@pytest.mark.parametrize("seed, light, task", [(1, 4096, 500_000), (2, 2, 4), (3, 3, 1), (4, 1, 2)])
def test_shared_turns_at_all_cuts(spark, monkeypatch, seed, light, task):
    monkeypatch.setattr(T, "LIGHTER", 3)
    monkeypatch.setattr(T, "CHUNK_BITS", 3)
    rng = random.Random(seed)
    rows = []
    texts = ["a b", "a", "", " \t", "b\x0bc", "é", None]
    for conv in rng.sample(range(400), 160):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["u", "u", None, ""]),
                         rng.choices(texts, [20, 2, 1, 1, 1, 1, 1])[0]))
    rows += [(None, 1, "u", "lost"), (500, None, None, None), (500, None, None, None)]
    rows += [(600 + k, t, "u", f"same {t % 3}") for k in range(40) for t in range(12)]
    rows += [(1000, t, "u", "long talk") for t in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = T.conversation_trie(frame.repartition(3), light=light, task_nodes=task)
    assert got(made) == plain(rows)


def test_empty_and_turnless(spark):
    kind = "conv_id long, turn long, role string, text string, depth string"
    assert T.conversation_trie(spark.createDataFrame([], kind)).collect() == []
    # Without a donor, a conversation of fewer turns than it would get loses them.
    alone = [c for c in range(21, 200) if zlib.crc32(str(c).encode()) % 4 >= 2][:3]
    rows = [(c, 0, "u", "gone", "x") for c in alone]
    assert got(T.conversation_trie(spark.createDataFrame(rows, kind))) == plain([r[:4] for r in rows])


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        a[: n // 2] = 7
        table = T.SlotTable(a, b)
        assert sorted(table.slots(a, b).tolist()) == list(range(n))
        assert (table.slots(a, b ^ np.uint64(1 << 50)) == -1).all()
