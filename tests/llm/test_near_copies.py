from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from freshet.llm import graph, simhash, vector_join
from freshet.llm.queries import QUERIES

from .conftest import odd_rows, prose


def plain_simhash(text, width=4):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate(dict.fromkeys([9, 10, 11, 12, 13], 32)).split(" ") if w]
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g.encode(), seed=42) >> bit & 1 for g in grams)
        out |= (2 * ones > len(grams)) << bit
    return out


def closure(ids, linked):
    comp = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for c, i in zip(comp, ids):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in comp]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = sorted({x for p in pairs if None not in p and p[0] != p[1] for x in p})
    near = {frozenset(p) for p in pairs if None not in p}
    want = dict(zip(ids, closure(ids, lambda i, j: frozenset((ids[i], ids[j])) in near)))
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_is_the_plain_one():
    for _, t, *_ in odd_rows():
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_simhash(t)


def test_simhash_query(docs, none, spark, table):
    got = sorted(map(tuple, QUERIES["op1_simhash"](spark, table(docs)).collect()), key=str)
    rows = odd_rows()
    fps = [plain_simhash(r[1]) for r in rows]
    comp = closure([r[0] for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert got == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp)), key=str)
    assert QUERIES["op1_simhash"](spark, table(none)).count() == 0


@pytest.mark.parametrize("most", [0, 3, 4, 5])
def test_gray_index_loses_no_link(spark, most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:40].tolist():  # chains and dense groups at all distances
        x = b
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps |= {base[0].item() ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}  # over several runs
    fps = sorted(fps)
    from freshet.llm.common import signed

    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    got = {r.fp: r.component_id for r in simhash.groups(df, "id", most).collect()}
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= most
    lab = np.arange(len(fps))
    while True:
        new = np.where(near, lab[None, :], len(fps)).min(1)
        if (new == lab).all():
            break
        lab = new
    assert [got[signed(f)] for f in fps] == lab.tolist()


def test_keep_one(docs, none):
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    rows = odd_rows()
    assert set(kept) <= set(rows) and len(kept) == len(set(kept))
    ids = [r[0] for r in kept]
    assert 1 in ids and 3 not in ids and 8 in ids
    assert simhash.keep_one(none).columns == docs.columns and simhash.keep_one(none).count() == 0
    clash = docs.withColumn("fp", F.lit(1)).withColumn("component", F.lit("x"))
    assert simhash.keep_one(clash).columns == clash.columns and simhash.keep_one(clash).count() == len(kept)


def plain_vectors(rows, threshold=0.95):
    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        a, b = rows[i][1], rows[j][1]
        if not usable(a) or not usable(b) or len(a) != len(b):
            return False
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        return a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold

    ids = [r[0] for r in rows]
    return [sum(linked(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))], closure(ids, linked)


@pytest.mark.parametrize("dim", [1, 3, 40, 64])
def test_vectors_match_brute_force(spark, table, dim):
    rng = np.random.default_rng(dim)
    rows, at = [], 0
    for size in (1, 1, 5, 30):
        c = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((at, (c + 0.2 * rng.standard_normal(dim) * np.linalg.norm(c) / np.sqrt(dim)).tolist()))
            at += 1
    rows += [(at, rows[3][1]), (at + 1, [2 * x for x in rows[3][1]]), (at + 2, None), (at + 3, [0.0] * dim), (at + 4, [float("nan")] * dim), (at + 5, [None] * dim), (at + 6, []), (None, rows[3][1]), (at + 7, [1.0] * (dim + 1)), (at + 7, [1.0] * (dim + 1)), (at + 8, [float("inf")] + [1.0] * (dim - 1))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in QUERIES["op3_vector_join"](spark, table(df, "embeddings")).collect()]
    n, comp = plain_vectors(rows)
    want = [(r[0], x, c if c is not None else r[0], r[0] is not None and r[0] == (c if c is not None else r[0])) for r, x, c in zip(rows, n, comp)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_crowded_vectors_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "CHUNK", 64)
    rng = np.random.default_rng(1)
    c = rng.standard_normal((3, 64))
    x = np.concatenate([c[i] + 0.16 * rng.standard_normal((250, 64)) for i in range(3)] + [rng.standard_normal((300, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_join.near_copies(df).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    lab = np.arange(len(x))
    while True:
        new = np.where(near, lab[None, :], len(x)).min(1)
        if (new == lab).all():
            break
        lab = new
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == lab.tolist()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, node long, k1 string")
    assert vector_join.near_copies(df).count() == 0
    assert prose(1, 3) == prose(1, 3)
