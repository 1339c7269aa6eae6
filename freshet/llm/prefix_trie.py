"""The trie of all conversation prefixes, as intervals of the sorted conversations.

Conversations become chunks of at most ``CHUNK`` turns, each turn two 64-bit hashes, under the hash of everything
before the chunk. Chunks are range-partitioned in lexicographic order and cut into runs. In a run the turns shared
by neighbours (LCPs) go into a sparse table of range minima; each candidate prefix looks for its left and right
extent there by binary search, on its own. A node inside a run is complete at once. Nodes that touch a
run's border, or whose conversations go on in another chunk, are put together from their parts afterwards;
sums over their subtrees come from pointer jumping, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from freshet.llm.common import kept, settle

#: Turns in one row of the sorted table.
CHUNK = 64
#: Turns in one run, so that what a task holds stays small.
RUN = 1 << 17
#: Turn numbers in one slice of a conversation: a long one is numbered in many tasks.
SLICE = 4096
#: The key of the textless root.
ROOT = (0, 0)

NODE = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, chars bigint, whole boolean, ends array<bigint>"


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, pos, t1, t2, chars)``: each turn's place in its conversation, hashes of role and text, code points of the text.

    Order is by turn, NULL first, ties by the hashes, so that it does not depend on how rows arrive. NULL role and
    text become empty. Rows without a conversation id belong to none and are left out. A conversation is
    numbered slice by slice of its turn numbers; only those of several slices need the offsets.
    """
    role, text = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (role, text))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.floor(F.col(f"`{turn}`") / SLICE).cast("bigint").alias("slice"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), role, text).alias("t2"), F.char_length(text).cast("bigint").alias("chars"),
    )
    rows = kept(rows, "turns")
    slices = rows.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("offset", F.sum("n").over(before)).where("offset IS NOT NULL").select("conv_id", F.col("slice").alias("_slice"), "offset")
    inside = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1)
    placed = placed.join(offsets.withColumnRenamed("conv_id", "_conv"), (F.col("conv_id") == F.col("_conv")) & F.col("slice").eqNullSafe(F.col("_slice")), "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("offset", F.lit(0))).cast("bigint").alias("pos"), "t1", "t2", "chars")


def chunks(placed: DataFrame) -> DataFrame:
    """``(conv_id, level, c1, c2, seq, chars, more)``: ``CHUNK`` turns under the key of the prefix before them.

    A prefix is known by the exclusive-or of its turns' hashes, each taken with its place, so keys of long
    conversations come from sums of chunks. ``more`` says that the conversation goes on.
    """
    level = F.floor(F.col("pos") / CHUNK).cast("bigint")
    turn = F.struct("pos", F.xxhash64("pos", "t1", "t2").alias("m1"), F.xxhash64(F.lit(1), "pos", "t1", "t2").alias("m2"), "chars")
    rows = placed.withColumn("level", level).groupBy("conv_id", "level").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    rows = rows.withColumns({f"x{i}": F.aggregate(F.col(f"ts.m{i}"), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)) for i in (1, 2)})
    by = Window.partitionBy("conv_id").orderBy("level")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.coalesce(F.expr(f"bit_xor(x{i})").over(upto), F.lit(0)).alias(f"c{i}") for i in (1, 2)]
    seq = F.flatten(F.transform("ts", lambda t: F.array(t["m1"], t["m2"])))
    return rows.select("conv_id", "level", *keys, seq.alias("seq"), F.col("ts.chars").alias("chars"), F.lead("level").over(by).isNotNull().alias("more"))


class Minima:
    """Range minima of a row of numbers: tables for spans of 1, 2, 4, ... numbers."""

    def __init__(self, x: np.ndarray):
        self.tables = [x]
        while 2 * (w := 1 << (len(self.tables) - 1)) <= len(x):
            self.tables.append(np.minimum(self.tables[-1][:-w], self.tables[-1][w:]))

    def _steps(self, at: np.ndarray, depth: np.ndarray, way: int) -> np.ndarray:
        at = at.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            t, w = self.tables[k], 1 << k
            first = at + 1 if way > 0 else at - w + 1
            can = (first >= 0) & (first < len(t))
            can[can] = t[first[can]] >= depth[can]
            at = at + way * w * can
        return at

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row reached from ``row`` over neighbours that share ``depth`` turns or more."""
        return self._steps(row, depth, 1)

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self._steps(row, depth, -1)


def shared(ctx: np.ndarray, m: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before; -1 where their contexts differ, and at the first."""
    size = np.diff(off)
    n = len(size)
    out = np.full(n, -1, np.int64)
    if n < 2:
        return out
    both = np.minimum(size[1:], size[:-1])
    row = np.repeat(np.arange(1, n), both)
    at = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    differ = (m[off[row] + at] != m[off[row - 1] + at]).any(1)
    first = both.copy()
    np.minimum.at(first, row[differ] - 1, at[differ])
    same = (ctx[1:] == ctx[:-1]).all(1)
    out[1:] = np.where(same, first, -1)
    return out


def run_nodes(conv: np.ndarray, level: np.ndarray, ctx: np.ndarray, m: np.ndarray, off: np.ndarray, chars: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """The nodes of one run of sorted chunks, and a part of the node that each chunk's context is. Columns as in ``NODE``."""
    size, n = np.diff(off), len(conv)
    lcp = shared(ctx, m, off)
    rows = Minima(lcp)
    # Candidates: each whole chunk, and what it shares with the chunk before.
    at, depth = np.concatenate([np.arange(n), np.arange(n)]), np.concatenate([size, lcp])
    at, depth = at[depth > 0], depth[depth > 0]
    base = CHUNK + 1
    code = np.unique(rows.left(at, depth) * base + depth)
    left, depth = code // base, code % base
    right = rows.right(left, depth)
    # A candidate stands for one node a turn, from below the node above it down to its own depth, all with the same rows.
    above = np.maximum(np.maximum(lcp[left], np.append(lcp, -1)[right + 1]), 0)
    many = depth - above
    own = np.repeat(np.arange(len(left)), many)
    depth = above[own] + 1 + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    left, right = left[own], right[own]
    turn = np.argsort(left * base + depth)
    left, right, depth = left[turn], right[turn], depth[turn]
    code, total = left * base + depth, len(left)

    first = np.flatnonzero(lcp < 0)  # the first row of each context
    over = total + np.searchsorted(first, left, "right") - 1
    deep = np.flatnonzero(depth > 1)
    over[deep] = np.searchsorted(code, rows.left(left[deep], depth[deep] - 1) * base + depth[deep] - 1)
    last = np.searchsorted(code, (right + 1) * base)

    acc = np.concatenate([np.zeros((1, 2), np.int64), np.bitwise_xor.accumulate(m, axis=0)])
    keys = np.concatenate([acc[off[left] + depth] ^ acc[off[left]] ^ ctx[left], ctx[first]])
    goes = np.concatenate([[0], np.cumsum(more)])
    whole = (left > 0) & (right < n - 1) & (goes[right + 1] == goes[left])
    known = np.append(whole, np.zeros(len(first), bool))[over]  # whether the node above is complete
    least = np.minimum.reduceat(np.append(conv, 0), np.stack([left, right + 1], 1).ravel())[::2]
    members, text = right - left + 1, chars[off[left] + depth - 1]

    # Sums over the subtrees of complete nodes, which are stretches of the preorder.
    kids = np.bincount(over, minlength=total + len(first))[:total]
    sums = [np.concatenate([[0], np.cumsum(np.where(whole, x, 0))]) for x in (kids == 0, (members - 1) * text)]
    leaves, saved = (s[last] - s[:total] for s in sums)
    # An incomplete node, or the context, gets what the complete nodes right below it add.
    added = [np.zeros(total + len(first), np.int64) for _ in range(3)]
    give = whole & ~known
    for x, v in zip(added, (np.ones(total, np.int64), leaves, saved)):
        np.add.at(x, over[give], v[give])

    ends: list = [None] * (total + len(first))
    here = np.flatnonzero(~more)
    tip = np.searchsorted(code, rows.left(here, size[here]) * base + size[here])
    cuts = np.flatnonzero(np.diff(tip, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(here))):
        ends[tip[a]] = conv[here[a:b]]

    part = np.append(np.zeros(total, bool), np.ones(len(first), bool))
    pad = np.zeros(len(first), np.int64)
    done = np.append(whole, pad > 0)
    long, mixed = (lambda x, mask=None: pa.array(x, pa.int64(), mask=mask)), (lambda a, b: np.where(done, np.append(a, pad), b))
    up = keys[np.append(over, pad)]
    return pa.RecordBatch.from_arrays(
        [
            long(keys[:, 0]), long(keys[:, 1]), long(up[:, 0], part), long(up[:, 1], part), long(np.append(depth + level[left] * CHUNK, level[first] * CHUNK)),
            long(np.append(least, pad), part), long(np.append(least, pad)[np.where(np.append(known, pad > 0), np.append(over, pad), 0)], ~np.append(known, pad > 0)), long(np.append(members, pad)),
            long(mixed(kids, added[0])), long(mixed(leaves, added[1])), long(mixed(saved, added[2])), long(np.append(text, pad)), pa.array(done), pa.array(ends, pa.list_(pa.int64())),
        ],
        names=[x.split()[0] for x in NODE.split(", ")],
    )


def sorted_nodes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition of sorted chunks, run by run."""
    held, turns = [], 0

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t["seq"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        off = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) // 2
        col = {n: t[n].to_numpy() for n in ("conv_id", "level", "c1", "c2", "more")}
        chars = t["chars"].combine_chunks()
        chars = (pa.concat_arrays(chars.chunks) if isinstance(chars, pa.ChunkedArray) else chars).flatten().to_numpy(zero_copy_only=False)
        return run_nodes(col["conv_id"], col["level"], np.stack([col["c1"], col["c2"]], 1), flat, off.astype(np.int64), chars, col["more"].astype(bool))

    for b in rows:
        if b.num_rows:
            held.append(b)
            turns += len(b.column("chars").flatten())
        if turns >= RUN:
            yield done()
            held, turns = [], 0
    if held:
        yield done()


def subtree_sums(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` (``k1, k2, p1, p2, depth, leaves, gain``) with both numbers summed over each node's subtree.

    Pointer jumping: after r rounds a node has the sum over fewer than 2^r levels, and its pointer is 2^r levels up.
    A node whose pointer would leave the tree takes part in no further join, so the root is no hot key.
    """
    now = nodes.withColumnsRenamed({"p1": "u1", "p2": "u2"})
    for i in range(depth.bit_length()):
        step = 1 << i
        got = now.where(F.col("depth") >= step).groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("leaves").alias("l"), F.sum("gain").alias("g"))
        far = now.where(F.col("depth") >= 2 * step).select("k1", "k2", F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        up = now.where(F.col("depth") >= step).select(F.col("k1").alias("v1"), F.col("k2").alias("v2"), F.col("u1").alias("w1"), F.col("u2").alias("w2"))
        new = far.join(up, ["v1", "v2"]).select("k1", "k2", "w1", "w2")
        now = now.join(got, ["k1", "k2"], "left").join(new, ["k1", "k2"], "left")
        now = settle(now.select("k1", "k2", F.col("w1").alias("u1"), F.col("w2").alias("u2"), "depth", *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("gain", "g"))]))
    return now.select("k1", "k2", "leaves", "gain")


def trie(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prefix of the conversations, and the conversations that end at it.

    ``turns`` has ``conv_id, pos, t1, t2, chars`` (see ``ordered``; places from 0 without a gap), ``members`` each
    conversation once with its ``size`` in turns; one of size 0 belongs to the root alone. The nodes have ``k1, k2, depth,
    conv_id`` (smallest member), ``parent_conv_id, n_convs, n_children, n_leaves, saved`` and, where one run held them all,
    ``ends``. The second table has the ends of the other nodes: ``k1, k2, first, ids``, each row a stretch of ids in ascending
    order, in the order of ``first``. Without a conversation there is no node, not even the root.
    """
    spark = members.sparkSession
    rows = kept(chunks(turns), "chunks")
    order = ["level", "c1", "c2", "seq", "conv_id"]
    found = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sorted_nodes, NODE), "prefixes")
    whole, parts = found.where("whole"), found.where("NOT whole")

    top = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    if not top["n"]:
        none = spark.createDataFrame([], NODE)
        return none, none.select("k1", "k2", F.col("conv_id").alias("first"), F.col("ends").alias("ids"))
    key = [F.lit(x).cast("bigint") for x in ROOT]
    root = spark.range(1).select(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "chars"), (*ROOT, None, None, 0, top["least"], top["n"], 0, 0, 0, 0))])
    sums = [F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved")]
    met = parts.select(root.columns).union(root).groupBy("k1", "k2").agg(*[F.max(x).alias(x) for x in ("p1", "p2", "depth", "chars")], F.min("conv_id").alias("conv_id"), *sums)
    met = settle(met)
    kids = met.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("more_children"))
    met = met.join(kids, ["k1", "k2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more_children", F.lit(0)))
    met = met.withColumns({"leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0), "gain": F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")})
    met = settle(met.drop("more_children", "n_leaves", "saved"))
    summed = subtree_sums(met.select("k1", "k2", "p1", "p2", "depth", "leaves", "gain"), met.agg(F.max("depth")).first()[0])
    open_nodes = met.drop("leaves", "gain").join(summed, ["k1", "k2"])

    # A node under the root has the root's member as its parent's; only other parents are looked up.
    above = met.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    cols = ["k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    no_ends = F.lit(None).cast("array<bigint>").alias("ends")
    seek = open_nodes.select(*cols[:8], F.col("leaves").alias("n_leaves"), F.col("gain").alias("saved"), no_ends).union(whole.where("parent_conv_id IS NULL").select(cols))
    last = ["n_convs", "n_children", "n_leaves", "saved", "ends"]
    under = seek.where("depth < 2").select("k1", "k2", "depth", "conv_id", F.when(F.col("depth") == 1, F.lit(top["least"])).cast("bigint").alias("parent_conv_id"), *last)
    lower = seek.where("depth > 1").join(above, ["p1", "p2"]).select("k1", "k2", "depth", "conv_id", F.col("above").alias("parent_conv_id"), *last)
    ready = whole.where("parent_conv_id IS NOT NULL").select("k1", "k2", "depth", "conv_id", "parent_conv_id", *last)

    empty = members.where("size = 0").groupBy(F.floor(F.col("conv_id") / SLICE).alias("s")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ids = parts.where("ends IS NOT NULL").select("k1", "k2", F.col("ends").alias("ids")).union(empty.select(key[0].alias("k1"), key[1].alias("k2"), "ids"))
    return ready.union(lower).union(under), ids.select("k1", "k2", F.col("ids")[0].alias("first"), "ids")


def digests(ends: DataFrame) -> DataFrame:
    """``(k1, k2, sha)``: SHA-256 of a node's ids in ascending order, as decimals joined by commas.

    The stretches of a node are read in order and hashed one after the other, so no list of all ids exists.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for b in rows:
            for k1, k2, ids in zip(*(b.column(n).to_pylist() for n in ("k1", "k2", "ids"))):
                if (k1, k2) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids)).encode())
        if key:
            out.append((*key, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k1", "k2", "sha"])

    return ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(run, "k1 bigint, k2 bigint, sha string")


def rebuilt(placed: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with another's first turns in front, as ``(turns, members)`` for ``trie``.

    Conversation c gets the first h = crc32(c) mod ``most`` turns of c - c mod ``every`` (all, if it has fewer; none, if it is
    absent) and keeps its own turns after its first h.
    """
    heads = placed.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("heads"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    convs = placed.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    given = F.when(F.col("heads").isNotNull() & (F.col("h") > 0), F.slice("heads", 1, F.greatest("h", F.lit(1))))
    convs = kept(convs.join(heads, "base", "left").select("conv_id", "n", "h", given.alias("heads")), "conversations")
    got = F.coalesce(F.size("heads"), F.lit(0))
    got = F.greatest(got, F.lit(0)).cast("bigint")
    front = convs.select("conv_id", F.explode("heads").alias("t")).select("conv_id", "t.*")
    short = convs.where(got < F.col("h")).select("conv_id", (F.col("h") - got).alias("short"))
    back = placed.where(F.col("pos") >= h).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "t1", "t2", "chars")
    return front.unionByName(back), convs.select("conv_id", (got + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
