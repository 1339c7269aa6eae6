"""Token counts that follow edits: a segment tree over the pre-tokens of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from freshet.llm.bpe import HELD, RANKS, Encoder, encoder, shipped, texts
from freshet.llm.common import batches

#: Pre-tokens in one leaf.
LEAF = 16


class CountTree:
    """Characters and tokens of runs of pre-tokens, with the token sums of all subtrees.

    ``chars[i]`` is the length of leaf ``i``; ``sums`` is a binary tree in heap order whose
    root ``sums[1]`` is the document's token count and whose leaves start at the middle.
    """

    def __init__(self, chars: list[int], sums: list[int]):
        self.chars, self.sums = chars, sums

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> CountTree:
        half = 1 << max(0, len(tokens) - 1).bit_length()
        sums = np.zeros(2 * half, np.int64)
        sums[half : half + len(tokens)] = tokens
        level = half
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2
        return cls(chars, sums.tolist())

    @property
    def total(self) -> int:
        return self.sums[1] if len(self.sums) > 1 else 0

    def tokens(self) -> list[int]:
        half = len(self.sums) // 2
        return self.sums[half : half + len(self.chars)]

    def replace(self, first: int, stop: int, chars: list[int], tokens: list[int]) -> CountTree:
        """Put new leaves in place of ``first`` to ``stop``; sums change on their paths only, unless leaves shift."""
        if len(chars) == stop - first:
            half = len(self.sums) // 2
            self.chars[first:stop] = chars
            self.sums[half + first : half + stop] = tokens
            touched = set(range(half + first, half + stop))
            while touched and max(touched) > 1:
                touched = {i // 2 for i in touched}
                for i in touched:
                    self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            return self
        old = self.tokens()
        return CountTree.of(self.chars[:first] + chars + self.chars[stop:], old[:first] + tokens + old[stop:])


def leaves(enc: Encoder, text: str) -> tuple[list[int], list[int]]:
    """Characters and tokens of each run of ``LEAF`` pre-tokens."""
    chars, tokens, held = [], [], []
    for part in enc.pieces(text):
        held = held + part if held else part
        whole = len(held) // LEAF * LEAF if len(part) >= HELD else len(held)
        if whole:
            now, starts = held[:whole] if whole < len(held) else held, range(0, whole, LEAF)
            chars += np.add.reduceat(np.fromiter(map(len, now), np.int64, whole), starts).tolist()
            tokens += np.add.reduceat(np.fromiter(map(enc.counts.__getitem__, now), np.int64, whole), starts).tolist()
        held = held[whole:]
    if held:
        chars.append(sum(map(len, held)))
        tokens.append(sum(map(enc.counts.__getitem__, held)))
    return chars, tokens


def apply_edit(enc: Encoder, text: str, tree: CountTree, start: int, stop: int, insert: str) -> tuple[str, CountTree, int]:
    """Replace ``text[start:stop]`` and bring the tree up to date; also how many characters were encoded again.

    Leaves that end two characters or more before the edit stay: the pattern looks no further
    ahead. From there pre-tokens are cut anew until a border falls on an old leaf border after
    the edit; all leaves behind it stay too.
    """
    start = min(max(0, start), len(text))
    stop = min(max(start, stop), len(text))
    new = text[:start] + insert + text[stop:]
    shift, edge = len(new) - len(text), start + len(insert)
    ends = np.cumsum(np.array(tree.chars, np.int64))
    first = int(np.searchsorted(ends, start - 2, "right"))
    begin = at = int(ends[first - 1]) if first else 0
    after = {int(e) + shift: i + 1 for i, e in enumerate(ends.tolist()) if e >= stop and i >= first}
    if not shift and not len(text):
        return new, tree, 0
    chars, tokens, n, size, count = [], [], 0, 0, 0
    last = len(tree.chars)
    for m in enc.pattern.finditer(new, begin):
        piece = m.group()
        size, count, n, at = size + len(piece), count + enc.counts[piece], n + 1, m.end()
        met = at >= edge and at in after
        if n == LEAF or met:
            chars.append(size)
            tokens.append(count)
            n = size = count = 0
        if met:
            last = after[at]
            break
    if n:
        chars.append(size)
        tokens.append(count)
    return new, tree.replace(first, last, chars, tokens), at - begin


def build(docs: DataFrame, text: str = "text", ranks: str | bytes = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns of ``docs`` with ``leaf_chars`` and ``sums``, the document's tree; ``sums[1]`` is its token count.

    NULL text counts as empty: no leaves and zero sums. Rows stay where they are, repeated
    ones included; columns that already bear these names are replaced.
    """
    packed = shipped(ranks)
    made = ("leaf_chars", "sums")
    cols = [n for n in docs.columns if n not in made]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(packed, pattern)
        for b in batches(rows, 1024):
            trees = [CountTree.of(*leaves(enc, t)) for t in texts(b.column(len(cols)))]
            new = [pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.sums for t in trees], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*cols, *made])

    src = docs.select(*[F.col(f"`{n}`") for n in cols], F.col(f"`{text}`").alias("_text_in"))
    return src.mapInArrow(run, src.drop("_text_in").schema.add("leaf_chars", T.ArrayType(T.IntegerType())).add("sums", T.ArrayType(T.LongType())))


def update(state: DataFrame, edits: str, text: str = "text", ranks: str | bytes = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Apply each row's ``edits`` (array of structs ``start, stop, insert``, in order) to its text and tree.

    Offsets count code points of the text as the edits before have left it and are brought
    into it if they lie outside. NULL or empty ``edits``, or a NULL part of one, change nothing
    there. Returns ``state`` with text, ``leaf_chars`` and ``sums`` brought up to date, without
    ``edits`` and with ``encoded_chars``: how many characters had to be encoded again.
    """
    packed = shipped(ranks)
    cols = [n for n in state.columns if n not in (edits, "encoded_chars")]
    at = {n: i for i, n in enumerate(cols)}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(packed, pattern)
        for b in batches(rows, 512):
            new_text, new_chars, new_sums, again = [], [], [], []
            cells = [b.column(i).to_pylist() for i in (at["leaf_chars"], at["sums"], len(cols))]
            null = b.column(at[text]).is_null().to_pylist()
            for t, none, chars, sums, changes in zip(texts(b.column(at[text])), null, *cells):
                tree, total = CountTree(chars, sums), 0
                for e in changes or []:
                    if e and None not in e.values():
                        t, tree, n = apply_edit(enc, t, tree, e["start"], e["stop"], e["insert"])
                        total += n
                new_text.append(None if none and not t else t)
                new_chars.append(tree.chars)
                new_sums.append(tree.sums)
                again.append(total)
            done = {text: pa.array(new_text, pa.string()), "leaf_chars": pa.array(new_chars, pa.list_(pa.int32())), "sums": pa.array(new_sums, pa.list_(pa.int64()))}
            out = [done.get(n, b.column(i)) for n, i in at.items()]
            yield pa.RecordBatch.from_arrays([*out, pa.array(again, pa.int64())], names=[*cols, "encoded_chars"])

    src = state.select(*[F.col(f"`{n}`") for n in cols], F.col(f"`{edits}`").alias("_edits_in"))
    return src.mapInArrow(run, src.drop("_edits_in").schema.add("encoded_chars", T.LongType()))
