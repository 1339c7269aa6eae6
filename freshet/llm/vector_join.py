"""Embedding near copies by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within the squared distance 2 - 2c. Rotated and cut into
blocks of dimensions, at least one block of such a pair stays within its share of that distance. Each
block is joined by range; what any block brings together is verified on the full vectors.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import kept
from freshet.llm.graph import components

THRESHOLD = 0.95
#: Dimensions of a block, at least; the last block takes what is left.
WIDTH = 16
#: Vectors of one chunk of a slice.
CHUNK = 1024
SEED = 7
CHUNKED = "dim int, block int, slice bigint, chunk bigint, low array<double>, high array<double>, nodes binary, copies binary, vecs binary"


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, width: int = WIDTH) -> list[slice]:
    n = max(1, dim // width)
    return [slice(i * width, dim if i == n - 1 else (i + 1) * width) for i in range(n)]


def budget(dim: int, block: slice, threshold: float) -> float:
    """The block's share of the squared distance, in proportion to its dimensions, and a little for rounding."""
    return (2 - 2 * threshold) * (block.stop - block.start) / dim * (1 + 1e-9) + 1e-12


def rotated(vecs: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated. Each row is summed by itself, so it does not depend on its neighbours."""
    unit = vecs / np.sqrt(np.einsum("ij,ij->i", vecs, vecs))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(vecs.shape[1]))


def usable(vec: str):
    """A vector that links: not NULL or empty, all components finite, not all zero."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~odd & F.exists(vec, lambda x: x != 0), F.lit(False))


def chunks(classes: DataFrame, threshold: float) -> DataFrame:
    """Chunks of each block's slices: neighbours along the block's first two coordinates, with the box they fill.

    A slice is as wide as the block's radius. Range partitions split a crowded slice over many
    tasks, so no slice is gathered.
    """

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            vecs = b.column(2)
            sizes = np.array([len(v) for v in vecs])
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                x = np.array(vecs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                rot = rotated(x)
                for j, cut in enumerate(blocks(int(dim))):
                    part = rot[:, cut]
                    second = part[:, 1] if part.shape[1] > 1 else part[:, 0]
                    step = np.floor(part[:, 0] / np.sqrt(budget(int(dim), cut, threshold)) / (1 + 1e-9)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), j, np.int32)), pa.array(step), pa.array(second), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())],
                        names=["dim", "block", "slice", "second", "node", "copies", "vec"],
                    )

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKED.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
        held, key = [], None

        def row():
            x = np.frombuffer(b"".join(v for _, _, v in held)).reshape(len(held), -1)
            part = rotated(x)[:, blocks(key[0])[key[1]]]
            nodes, copies = (np.array([h[i] for h in held], np.int64).tobytes() for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*key, held[0][0], part.min(0), part.max(0), nodes, copies, x.tobytes()], types)], names=names)

        for b in rows:
            for dim, block, step, node, copies, vec in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))):
                if key != (dim, block, step) or len(held) == CHUNK:
                    if held:
                        yield row()
                    held, key = [], (dim, block, step)
                held.append((node, copies, vec))
        if held:
            yield row()

    placed = classes.select("node", "copies", "vec").mapInArrow(place, "dim int, block int, slice bigint, second double, node bigint, copies bigint, vec binary")
    order = ["dim", "block", "slice", "second", "node"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, CHUNKED)


def _near(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that the block brings together and the full vectors confirm."""
    dim = x.shape[1]
    cut = blocks(dim)[block]
    a, b = rx[:, cut].astype(np.float32), ry[:, cut].astype(np.float32)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(square <= budget(dim, cut, threshold) + 1e-5)
    good = []
    for k in range(0, len(i), 1 << 16):
        at, to = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        p, q, gap = x[at], y[to], rx[at, cut] - ry[to, cut]
        dot = np.einsum("ij,ij->i", p, q)
        cosine = dot / (np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
        good.append((cosine >= threshold) & (np.einsum("ij,ij->i", gap, gap) <= budget(dim, cut, threshold)))
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    return i[keep], j[keep]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links i - j."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = np.minimum(new, new[new])
        if (new == lab).all():
            return lab
        lab = new


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node, n, peer``: how many copies a node links with (to be summed), and edges that connect what is linked.

    Chunks are paired by an equi-join on the slice and the one after it, and only if their boxes
    lie within the block's radius. A pair of vectors that several blocks bring together counts in the
    first. Not pairs come out, but a count for each vector of a pair of chunks, and one edge
    for each two parts that hang together.
    """
    cut = kept(chunks(classes, threshold), "vector-chunks")
    left = cut.select(*[F.col(n).alias(f"_{n}") for n in cut.columns], F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("_step"))
    left = left.withColumnsRenamed({"_dim": "dim", "_block": "block"}).withColumn("slice", F.col("_slice") + F.col("_step"))
    both = left.join(cut, ["dim", "block", "slice"]).where("_step = 1 OR chunk >= _chunk")
    gaps = F.zip_with(F.zip_with("_low", "high", lambda a, b: a - b), F.zip_with("low", "_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    square = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    widths = F.when(F.col("dim") < 2 * WIDTH, F.col("dim")).when((F.col("block") + 1) * WIDTH + WIDTH <= F.col("dim"), F.lit(WIDTH)).otherwise(F.col("dim") - F.col("block") * WIDTH)
    near = both.where(square <= (2 - 2 * threshold) * widths / F.col("dim") * (1 + 1e-6) + 1e-9)
    near = near.select("dim", "block", (F.expr("_step = 0 AND chunk = _chunk")).alias("same"), "_nodes", "_copies", "_vecs", "nodes", "copies", "vecs")

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for dim, block, same, *parts in zip(*(b.column(i) for i in range(9))):
                dim, block, same = dim.as_py(), block.as_py(), same.as_py()
                na, ca, nb, cb = (np.frombuffer(parts[k].as_buffer(), np.int64) for k in (0, 1, 3, 4))
                x, y = (np.frombuffer(parts[k].as_buffer()).reshape(-1, dim) for k in (2, 5))
                rx = rotated(x)
                ry = rx if same else rotated(y)
                i, j = _near(x, y, rx, ry, block, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                first = np.ones(len(i), bool)
                cuts = blocks(dim)
                for k in range(block):
                    for s in range(0, len(i), 1 << 16):
                        gap = rx[i[s : s + (1 << 16)], cuts[k]] - ry[j[s : s + (1 << 16)], cuts[k]]
                        first[s : s + (1 << 16)] &= np.einsum("ij,ij->i", gap, gap) > budget(dim, cuts[k], threshold)
                n, m = len(na), 0 if same else len(nb)
                count = np.zeros(n + m, np.int64)
                np.add.at(count, i[first], cb[j[first]])
                np.add.at(count, j[first] + (0 if same else n), ca[i[first]])
                nodes = na if same else np.concatenate([na, nb])
                if same:
                    lab = _labels(n, i, j)
                    moved = np.nonzero(lab != np.arange(n))[0]
                    ends = nodes[moved], nodes[lab[moved]]
                else:
                    la, lb = np.arange(n), np.arange(m)
                    if len(i) > 2 * (n + m):  # what hangs together inside a chunk is linked by the chunk's own comparison
                        la, lb = _labels(n, *_near(x, x, rx, rx, block, threshold)), _labels(m, *_near(y, y, ry, ry, block, threshold))
                    pairs = np.unique(np.stack([la[i], lb[j]], 1), axis=0)
                    lab = _labels(n + m, pairs[:, 0], pairs[:, 1] + n)
                    moved = np.nonzero(lab != np.arange(n + m))[0]
                    ends = nodes[moved], nodes[lab[moved]]
                some = np.nonzero(count)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([nodes[some], ends[0]])), pa.array(np.concatenate([count[some], np.zeros(len(moved), np.int64)])), pa.array([None] * len(some) + ends[1].tolist(), pa.int64())],
                    names=["node", "n", "peer"],
                )

    return near.mapInArrow(compare, "node bigint, n bigint, peer bigint")


def near_copies(vectors: DataFrame, ident: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``ident, n_links, component_id, kept`` for every row.

    ``n_links`` counts the other rows whose cosine is ``threshold`` or more, ``component_id`` is the smallest
    id reachable over links, the row's own included; ``kept`` says that this is the row's own. Vectors
    that are NULL, empty, zero or hold NULL or non-finite components link with nothing, nor do
    vectors of different lengths. Equal vectors are one class until the end, so copies cost
    nothing. A NULL id is kept, names no component and is not ``kept``. No rows give no rows.
    """
    rows = vectors.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("vec"))
    keyed = rows.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), "vec"))
    good = keyed.where(usable("vec"))
    classes = good.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = kept(links(classes, threshold), "vector-links")
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.where("peer IS NOT NULL").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = classes.select("k1", "k2", "node", "least", "copies").join(counts, "node", "left").join(comp, "node", "left")
    named = kept(named.withColumn("component", F.coalesce("component", "node")), "vector-components")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    marked = keyed.select("id", F.when(usable("vec"), F.col("k1")).alias("k1"), "k2")
    out = marked.join(named, ["k1", "k2"], "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(ident), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
