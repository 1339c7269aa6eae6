"""SimHash near copies, found with a Gray-ordered hierarchical index over the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import batches, kept, row_key, signed
from freshet.llm.graph import components

SEED = 42
#: Left turns of the 64 bits. Each turn brings another third of the bits to the front.
TURNS = (0, 22, 43)
#: With at most this many differing bits one of the three thirds differs in one bit at most.
MOST_BITS = 5
#: Fingerprints in one node of the lowest level.
RUN = 256


def shingles(text: bytes | None, width: int = 4) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included; a shorter text is one shingle, one without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash64(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *stops[: len(words) - width].tolist()]
    last = (stops[width - 1 :] - 1).tolist()
    return np.fromiter((hash64(joined[s:e], SEED) for s, e in zip(first, last)), np.uint64, len(first))


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text over word shingles, repeats included; no words: zero."""
    hashes = shingles(text, width)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):  # bounds the unpacked bits of a long text
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str, width: int = 4) -> DataFrame:
    """The key columns and ``fp``, the fingerprint's bits as a long, for every row; NULL text counts as empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 2048):
            fps = [signed(fingerprint(t, width)) for t in b.column(len(keys)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(fps, pa.int64())], names=[*keys, "fp"])

    src = docs.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in src.dtypes[:-1])
    return src.mapInArrow(run, f"{schema}, fp bigint")


def gray_rank(x: str):
    """Position of a bit pattern in Gray order, as a signed long that sorts like the unsigned one."""
    g = F.col(x)
    for s in (1, 2, 4, 8, 16, 32):
        g = g.bitwiseXOR(F.shiftrightunsigned(g, s))
    return g.bitwiseXOR(F.lit(signed(1 << 63)))


def nodes(fps: DataFrame, bits: int) -> DataFrame:
    """The index: runs of fingerprints next to each other in Gray order, under the prefix they share.

    One row per run: ``turn``, ``leaf`` (the prefix), ``run`` (its first rank), ``low`` and
    ``high`` (AND and OR of its members, so the masked pattern all of them share is where both
    agree) and ``members``. Range partitions split a crowded prefix over many tasks.
    """

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["turn", "leaf", "run", "low", "high", "members"]
        held, key = [], None

        def row():
            x = np.array(held, np.int64)
            return [key[0], key[1], first, int(np.bitwise_and.reduce(x)), int(np.bitwise_or.reduce(x)), x.tobytes()]

        def batch(out):
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        out, first = [], 0
        for b in rows:
            for turn, leaf, rank, code in zip(*(b.column(i).to_pylist() for i in range(4))):
                if key != (turn, leaf) or len(held) == RUN:
                    if held:
                        out.append(row())
                    held, key, first = [], (turn, leaf), rank
                held.append(code)
                if len(out) >= 512:
                    yield batch(out)
                    out = []
        if held:
            out.append(row())
        if out:
            yield batch(out)

    turned = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(s).alias("by")) for i, s in enumerate(TURNS)])).alias("t"))
    spun = "CASE t.by " + " ".join(f"WHEN {s} THEN " + (f"shiftleft(fp, {s}) | shiftrightunsigned(fp, {64 - s})" if s else "fp") for s in TURNS) + " END"
    codes = turned.select(F.col("t.turn").alias("turn"), F.expr(spun).alias("code"))
    ranked = codes.select("turn", F.shiftrightunsigned("code", 64 - bits).alias("leaf"), gray_rank("code").alias("rank"), "code")
    ordered = ranked.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    return ordered.mapInArrow(cut, "turn int, leaf bigint, run bigint, low bigint, high bigint, members binary")


def _parts(near: np.ndarray) -> np.ndarray:
    """Smallest member of each member's connected part, from a symmetric matrix of links."""
    n = len(near)
    lab = np.arange(n)
    while True:
        new = np.where(near, lab[None, :], n).min(1)
        new = np.minimum(new, new[new])
        if (new == lab).all():
            return lab
        lab = new


def run_links(a: np.ndarray, b: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Links that join what is connected: inside ``a``, or between parts of ``a`` and parts of ``b``."""
    inner = np.bitwise_count(a[:, None] ^ a[None, :]) <= most
    if b is None:
        lab = _parts(inner)
        return [(int(x), int(y)) for x, y in zip(a, a[lab]) if x != y]
    cross = np.bitwise_count(a[:, None] ^ b[None, :]) <= most
    if not cross.any():
        return []
    la, lb = _parts(inner), _parts(np.bitwise_count(b[:, None] ^ b[None, :]) <= most)
    i, j = np.nonzero(cross)
    pairs = np.unique(np.stack([la[i], lb[j]], 1), axis=0)
    return [(int(a[x]), int(b[y])) for x, y in pairs]


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect all pairs within ``most`` bits.

    Search goes down the index: two prefixes are paired when they differ in one bit at most
    (an equi-join on the prefix with each bit flipped), two runs when their shared masked
    patterns differ in ``most`` bits at most, and only then members are compared. From a pair
    of runs one link for each two connected parts comes out, not all its pairs.
    """
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"most must lie in 0..{MOST_BITS}")
    n = fps.count()
    bits = min(21, max(6, (n // 64).bit_length()))
    runs = kept(nodes(fps, bits), "gray-runs")
    flips = F.array(*[F.lit(0).cast("long")] + [F.lit(1 << i).cast("long") for i in range(bits)])
    left = runs.select(*[F.col(n).alias(f"_{n}") for n in runs.columns], F.explode(flips).alias("_flip"))
    left = left.withColumn("leaf", F.col("_leaf").bitwiseXOR(F.col("_flip"))).withColumnRenamed("_turn", "turn").where("leaf >= _leaf")
    shared = "~(low ^ high) & ~(_low ^ _high)"
    pairs = left.join(runs, ["turn", "leaf"]).where(f"(leaf > _leaf OR run >= _run) AND bit_count((low ^ _low) & {shared}) <= {most}")
    pairs = pairs.select("turn", (F.expr("leaf = _leaf AND run = _run")).alias("same"), "_members", "members")
    shifts = TURNS

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            got = []
            for turn, same, x, y in zip(*(b.column(i) for i in range(4))):
                one = np.frombuffer(x.as_buffer(), np.uint64)
                found = run_links(one, None if same.as_py() else np.frombuffer(y.as_buffer(), np.uint64), most)
                s = shifts[turn.as_py()]
                got += [(signed(v >> s | v << 64 - s), signed(w >> s | w << 64 - s)) for v, w in found]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def groups(fps: DataFrame, ident: str, most: int = 4) -> DataFrame:
    """``(fp, component_id)``: for each distinct fingerprint the smallest id its links reach; NULL ids count for nothing."""
    each = kept(fps.groupBy("fp").agg(F.min(ident).alias("least")), "fingerprints")
    comp = components(links(each.select("fp"), most))
    joined = each.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = kept(joined, "components")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(least, "component").select("fp", "component_id", "component")


def near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", most: int = 4, width: int = 4) -> DataFrame:
    """``(ident, fp, component_id)`` for every row of ``docs``.

    Rows whose fingerprints differ in ``most`` bits or fewer are linked; ``component_id`` is the
    smallest id reachable, the row's own included. NULL and word-less texts have fingerprint
    zero, linked like any other. NULL ids are kept and never name a component unless nothing
    else does. Repeated rows come back as often as they stand; no rows give no rows.
    """
    fps = kept(fingerprints(docs, [ident], text, width), "simhash")
    return fps.join(groups(fps, ident, most), "fp").select(ident, "fp", "component_id")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", most: int = 4, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Ties (one id on several rows) go to the smaller row hash; of rows equal in every column one
    stays; a NULL id comes last. Columns come back as they are.
    """
    k1, k2 = row_key(docs)
    fps = kept(fingerprints(docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("txt")), ["k1", "k2", "id"], "txt", width), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")).alias("w")
    won = fps.join(groups(fps, "id", most), "fp").groupBy("component").agg(first).select(F.col("w.k1").alias("_k1"), F.col("w.k2").alias("_k2"))
    cols = [F.col(f"`{n}`") for n in docs.columns]
    stay = docs.select(*cols, k1.alias("_k1"), k2.alias("_k2")).join(won, ["_k1", "_k2"], "left_semi")
    return stay.dropDuplicates(["_k1", "_k2"]).select(*cols)
