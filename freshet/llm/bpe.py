"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text the table holds the one token that ends its encoding.
A token may follow that of the prefix before it only if encoding the two tokens' bytes
gives back just these two; exactly one candidate passes. So a longer piece needs only
entries for its new bytes (exact appends), and walking the table back gives the ids.
"""

from __future__ import annotations

import base64
import functools
import itertools
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from freshet.llm.common import batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries of the memo tables of a Python worker; a full table starts anew.
MEMO = 120_000
#: Pieces of a text that are held at once.
HELD = 100_000


def rank_file(name: str = RANKS) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


class Vocabulary:
    """Token ranks with the pair test and the prefix tables built on it."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        #: Finds all tokens that end at a byte, the longest first.
        self.found = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.found.add_word(t.decode("latin-1"), (i, len(t)))
        self.found.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one byte."""
        if token not in self.halves:
            parts = [bytes([x]) for x in self.tokens[token]]
            while len(parts) > 2:
                ranks = [self.ranks.get(x + y, token) for x, y in zip(parts, parts[1:])]
                best = min(ranks)
                if best >= token:
                    raise ValueError(f"token {token} is not reached by merges")
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens, encoded together, give these two tokens.

        Merges are undone from the latest (highest rank) on. If the tokens that meet at the
        seam could have merged before the one undone was formed, the pair is not stable; at
        equal ranks the merge further left comes first.
        """
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        got = self.pairs[left << 32 | right] = self._fits(left, right)
        return got

    def _fits(self, x: int, y: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        bound = len(ranks) + 1 << 1
        while True:
            merged = ranks.get(tokens[x] + tokens[y])
            if merged is not None and merged < bound:
                return False
            sx, sy = self.split(x), self.split(y)
            if sx is None and sy is None:
                return True
            if sy is None or sx is not None and x > y:
                bound, x = x, sx[1]
            else:
                bound, y = y + 1, sy[0]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Add to the table of a prefix of ``piece`` the entries of its further bytes."""
        old = len(last)
        skip = max(0, old - self.longest)
        last += [-1] * (len(piece) - old)
        pairs, fits = self.pairs.get, self.fits
        for at, (token, size) in self.found.iter(piece[skip:].decode("latin-1")):
            stop = skip + at
            if last[stop] < 0:
                start = stop - size
                if start >= 0:
                    before = last[start]
                    good = pairs(before << 32 | token)
                    if good is None:
                        good = fits(before, token)
                    if good:
                        last[stop] = token
                else:
                    last[stop] = token
        if -1 in last:
            raise ValueError("a byte has no token")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """Ids of the whole piece from its table."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.tokens[last[i - 1]])
        return out[::-1]

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.extend(piece, []))


class Memo(dict):
    """Results by piece of text. A full table becomes the old one, from which what is met again is taken over."""

    def __init__(self, make: Callable[[str], object], most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(piece) <= 64:
            self[piece] = out
        return out


class Encoder:
    """Encodes and decodes whole texts: the pattern cuts a text into pieces, each is encoded by itself."""

    def __init__(self, data: bytes, pattern: str):
        self.vocabulary = Vocabulary(data)
        self.pattern = regex.compile(pattern)
        self.packed = Memo(self._pack)
        self.counts = Memo(lambda piece: len(self.vocabulary.piece(piece.encode())), 2 * MEMO)

    def _pack(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        ids = self.vocabulary.piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= 8 * HELD:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(itertools.islice(found, HELD)):
            yield part

    def encode(self, text: str) -> bytes:
        get = self.packed.__getitem__
        return b"".join(b"".join(map(get, part)) for part in self.pieces(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))

    def edit(self, text: str, ids: bytes, start: int, stop: int, insert: str) -> tuple[str, bytes, int]:
        """Replace ``text[start:stop]``; the new text, its ids, and how many characters were encoded again.

        Pieces that end two characters before the edit stay (the pattern looks no further
        ahead), and so do all pieces from the first old piece border after it that is one again.
        """
        borders, at, seen = [(0, 0)], 0, 0
        for m in self.pattern.finditer(text):
            seen += len(self.packed[m.group()])
            borders.append((m.end(), seen))
        begin, head = max((b for b in borders if b[0] <= start - 2), default=(0, 0))
        after = {b: i for b, i in borders if b >= stop}
        new = text[:start] + insert + text[stop:]
        shift, out = len(insert) - (stop - start), [ids[:head]]
        for m in self.pattern.finditer(new, begin):
            out.append(self.packed[m.group()])
            at = m.end()
            if at >= start + len(insert) and at - shift in after:
                return new, b"".join([*out, ids[after[at - shift] :]]), at - begin
        return new, b"".join(out), len(new) - begin


@functools.lru_cache(maxsize=2)
def _shared(packed: bytes, pattern: str) -> Encoder:
    return Encoder(zlib.decompress(packed), pattern)


def encoder(packed: bytes, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """The worker's encoder for a compressed rank file, made once for all tasks it runs."""
    return _shared(packed, pattern)


def shipped(ranks: str | bytes = RANKS) -> bytes:
    """A rank file (name or content) as tasks get it; a file of fixed size, whatever the data."""
    return zlib.compress(rank_file(ranks) if isinstance(ranks, str) else ranks)


def texts(column: pa.Array) -> Iterator[str]:
    """Whole texts of a batch one by one; NULL as the empty text, broken UTF-8 with replacement characters."""
    for x in column.cast(pa.binary()):
        yield "" if not x.is_valid else bytes(x.as_buffer()).decode("utf-8", "replace")


def encode(docs: DataFrame, text: str = "text", out: str = "ids", ranks: str | bytes = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns of ``docs`` and ``out``: the token ids of the whole text as little-endian unsigned 32-bit integers.

    NULL text counts as empty and gets no ids. A column named ``out`` is replaced. Rows are
    neither moved nor merged, so repeated rows and ties stay as they are; no shuffle.
    """
    packed = shipped(ranks)
    cols = [n for n in docs.columns if n != out]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(packed, pattern)
        for b in batches(rows, 1024):
            ids = pa.array([enc.encode(t) for t in texts(b.column(len(cols)))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*cols, out])

    src = docs.select(*[F.col(f"`{n}`") for n in cols], F.col(f"`{text}`").alias("_text_in"))
    schema = src.drop("_text_in").schema.add(out, T.BinaryType())
    return src.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | bytes = RANKS) -> DataFrame:
    """All columns of ``df`` and ``out``: the bytes the ids stand for; NULL ids give NULL."""
    packed = shipped(ranks)
    cols = [n for n in df.columns if n != out]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(packed)
        for b in batches(rows, 1024):
            done = [None if x is None else enc.decode(x) for x in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(done, pa.binary())], names=[*cols, out])

    src = df.select(*[F.col(f"`{n}`") for n in cols], F.col(f"`{ids}`").alias("_ids_in"))
    return src.mapInArrow(run, src.drop("_ids_in").schema.add(out, T.BinaryType()))
