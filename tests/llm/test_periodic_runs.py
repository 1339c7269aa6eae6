"""Periodic runs against a plain search of every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from freshet.llm import periodic_runs, queries


def plain(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            smaller = any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q))
            if j > i and n >= max(least, exponent * q) and not smaller:
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def row(doc_id, text):
    """What the query returns for a document, worked out word by word."""
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)), max_size=8), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_against_every_period(parts, bounds):
    w = [x for part, times in parts for x in part * times]
    _, ids = periodic_runs.numbered(b" ".join(b"w%d" % x for x in w))
    assert periodic_runs.find(ids, *bounds) == plain(w, *bounds)


def test_query_on_odd_rows(spark, table):
    rng = random.Random(4)
    words = ["a", "b", "é", "c d", " "]
    rows = [(i, rng.choice([" ", "\n", "\t \r"]).join(rng.choice(words[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(301, None), (302, ""), (303, " \t\n"), (None, "x x x x x x x"), (None, None), (7, "x y " * 9), (7, "x y " * 9), (304, " lead x x x x x x "), (305, "ab " * 5000)]
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id bigint, text string, runs int, w string")
    got = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, table(df)).collect()]
    assert sorted(got, key=repr) == sorted((row(*r) for r in rows), key=repr)


def test_query_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: row(r.doc_id, r.text) for r in docs if len(r.text or "") < 6000}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs) and {k: got[k] for k in short} == short


def test_real_outputs_and_empty_table(spark, none):
    got = periodic_runs.runs(spark.createDataFrame([("k", "up a b a b a b a b down")], "key string, body string"), "key", "body").first()
    assert (got.key, got.n_words, [tuple(r) for r in got.runs], got.collapsed) == ("k", 10, [(1, 8, 2)], "up a b down")
    assert periodic_runs.runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs(none, exponent=1)


def test_long_periodic_texts_stay_quick():
    assert periodic_runs.find(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic_runs.find(np.tile(np.arange(5_000), 40)) == [(0, 200_000, 5_000)]
