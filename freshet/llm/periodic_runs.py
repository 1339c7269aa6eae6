"""Periodic runs of words: a passage that repeats itself several times in a row, found in every whole text.

A run is a stretch of words with smallest period q, at least ``least`` words and ``exponent`` periods long,
which no neighbouring word extends. Suffixes of the text are united by decreasing longest common prefix, as in
Kruskal's method. Two positions that become neighbours in a class at level l and lie d apart, with d small
against l, seed a run: words d apart agree from the first position on for l + d words.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import batches

#: Texts turned into word numbers at a time.
ROWS = 512


def numbered(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and a number for each, equal words sharing one."""
    words = text.split()
    seen: dict[bytes, int] = {}
    return words, np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))


def lowest_level(least: int, exponent: int) -> int:
    """The least common prefix of two positions one period apart in any run."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def repeats(ids: np.ndarray, width: int) -> bool:
    """Whether any ``width`` words stand in two places (by hash: may say yes without need, never no)."""
    n = len(ids) - width + 1
    if n < 2:
        return False
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the words each shares with the one before (prefix doubling, tied groups only)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    slot, fresh = np.arange(n), np.ones(n, bool)
    fresh[1:] = ids[order[1:]] != ids[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, slot, 0))
    ranks, h = [rank], 1
    while True:
        tied = ~fresh
        tied[:-1] |= tied[1:]
        at = slot[tied]
        if not len(at):
            break
        pos = order[at]
        after = np.zeros(len(pos), np.int64)
        inside = pos + h < n
        after[inside] = rank[pos[inside] + h] + 1
        key = rank[pos] * (n + 1) + after
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        order[at] = pos = pos[turn]
        fresh[at] = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[pos] = np.maximum.accumulate(np.where(fresh[at], at, 0))
        ranks.append(rank)
        h *= 2
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        step = same.astype(np.int64) << k
        a, b = a + step, b + step
        common[1:] += step
    return order, common


def neighbours(one: list[int], two: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Two ordered sets as one, and the pairs from different sets that are neighbours in it."""
    if len(one) < len(two):
        one, two = two, one
    met = []
    places = [bisect_left(one, x) for x in two]
    for i, (x, j) in enumerate(zip(two, places)):
        if j and (not i or places[i - 1] != j):
            met.append((one[j - 1], x))
        if j < len(one) and (i + 1 == len(two) or places[i + 1] != j):
            met.append((x, one[j]))
    if len(two) * 16 < len(one) or len(two) == 1:
        for x in two:
            insort(one, x)
    else:
        one += two
        one.sort()
    return one, met


def find(ids: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence, by start and then period."""
    low = lowest_level(least, exponent)
    if len(ids) < least or not repeats(ids, low):
        return []
    order, common = suffix_order(ids)
    edges = np.flatnonzero(common >= low)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    ends = order.tolist()
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    found = []
    for k, level in zip(edges.tolist(), common[edges].tolist()):
        a, b = top(k - 1), top(k)
        both, met = neighbours(members.pop(a, None) or [ends[a]], members.pop(b, None) or [ends[b]])
        root[a] = b
        members[b] = both
        for i, j in met:
            d = j - i
            if d * (exponent - 1) <= level and level + d >= least and (not i or ids[i - 1] != ids[j - 1]):
                found.append((i, level + d, d))
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that follow the first period of a run, joined by one space."""
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
    return b" ".join(words)


def runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``(ident, n_words, runs, collapsed)`` for every row of ``docs``.

    ``runs`` lists ``(start, length, period)`` in words by start and then period; ``collapsed`` is the text with
    one period of each run, words joined by one space. Words are what white space of ASCII separates. NULL and
    empty texts have no words, no runs and an empty ``collapsed``. Rows with a NULL or repeated id come back as they
    stand; other columns are left out; an empty table gives no rows. A text is worked on as a whole in the
    task that reads it, nothing is shuffled, and a lost task repeats its own rows only.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["_id", "n_words", "runs", "collapsed"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, ROWS):
            sizes, lists, texts = [], [], []
            for t in b.column(1):
                words, ids = numbered(t.as_buffer().to_pybytes() if t.is_valid else b"")
                got = find(ids, least, exponent)
                sizes.append(len(words))
                lists.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                texts.append(collapsed(words, got))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    src = docs.select(F.col(f"`{ident}`").alias("_id"), F.col(f"`{text}`").cast("binary").alias("_text"))
    done = src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return done.withColumnRenamed("_id", ident)
