"""The prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

from freshet.llm import prefix_trie, queries

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes from a dictionary of prefixes; ties of a turn number must be equal rows."""
    own = defaultdict(list)
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own[c].append((r or "", x or ""))
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(int)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        s = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not kids[k]
    return sorted(
        (
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
            for k, m in members.items()
        ),
        key=repr,
    )


def found(spark, table, rows):
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS k1", "2 AS depth", "3 AS pos")
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op12_prefix_trie"](spark, table(df, "conversations")).collect()), key=repr)


def made(seed: int, n: int):
    """Conversations of few different turns; some long ones that share long fronts, copies, gaps, NULLs and other ids."""
    rng, rows = random.Random(seed), []
    long = [("user", f"t{i % 7}") for i in range(200)]
    for c in [*range(n), *range(300, 300 + n // 2), 1_000_003, -5, -205]:
        if rng.random() < 0.15:
            continue
        turns = [(rng.choice(["user", None]), rng.choice(["a", "bb", "", None, "é🙂"])) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.1:
            turns = long[: rng.choice([63, 64, 65, 128, 130, 200])] + turns[: rng.randint(0, 1)]
        rows += [(c, None if i == 0 and rng.random() < 0.3 else 3 * i, r, x) for i, (r, x) in enumerate(turns)]
    return rows + [(None, 0, "user", "lost")]


def test_against_plain_prefixes(spark, table):
    rows = made(1, 260)
    assert found(spark, table, rows) == plain(rows)


def test_many_small_runs(spark, table):
    """Nodes that spread over many partitions are put together from parts."""
    rows = made(3, 150) + [(1000 + c, t, "user", "same") for c in range(200) for t in range(2)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 12)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(spark, table, rows) == plain(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_tables(spark, table):
    assert found(spark, table, []) == []
    assert found(spark, table, [(None, 1, "user", "x")]) == []


def test_turnless_conversations_belong_to_the_root(spark, table):
    """Where the other conversation is absent and the own turns are dropped, nothing is left."""
    gone = [c for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6 >= 1]
    rows = [(c, 0, "user", "x") for c in gone]
    assert found(spark, table, rows) == plain(rows)
    assert len(plain(rows)) == 1


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(7, t, "user", f"x{i}") for i in range(40) for t in (None, 1, 5000, 9000)]
    one = spark.createDataFrame(rows, TURNS).repartition(5)
    two = spark.createDataFrame(rows[::-1], TURNS).repartition(3)
    a, b = ({tuple(r) for r in prefix_trie.ordered(x).collect()} for x in (one, two))
    assert a == b and sorted(r[1] for r in a) == list(range(160))


def test_range_minima():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(-1, 5, 70)
    x[0] = -1
    rows = prefix_trie.Minima(x)
    for k in range(70):
        for d in range(6):
            left = right = k
            while x[left] >= d:
                left -= 1
            while right + 1 < 70 and x[right + 1] >= d:
                right += 1
            assert (rows.left(np.array([k]), np.array([d]))[0], rows.right(np.array([k]), np.array([d]))[0]) == (left, right)
