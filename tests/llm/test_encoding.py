from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from freshet.llm import bpe, token_counts
from freshet.llm.queries import QUERIES

from .conftest import odd_rows

ALPHABET = "ab 's\n\t '1é.lL中  🙂xyzthe"


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.rank_file(), P.PATTERN)


def some(rng, most=120):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def test_ids_are_those_of_the_library(known, enc):
    rng = random.Random(0)
    for t in [some(rng) for _ in range(1500)] + [r[1] or "" for r in odd_rows()] + ["a" * 5000, " " * 3000, "ab" * 2000 + "é" * 999]:
        ids = enc.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == known.encode_ordinary(t)
        assert enc.decode(ids) == t.encode()


def test_appends_to_a_prefix_table_are_exact(enc):
    rng = random.Random(1)
    v = enc.vocabulary
    for _ in range(300):
        piece = "".join(rng.choice("theationingérowx") for _ in range(rng.randint(1, 60))).encode()
        cut = rng.randint(0, len(piece))
        table = v.extend(piece, v.extend(piece[:cut], []))
        assert table == v.extend(piece, []) and b"".join(v.tokens[i] for i in v.walk(table)) == piece


def test_edits_encode_only_what_is_near(known, enc):
    rng = random.Random(2)
    for _ in range(800):
        t = some(rng, 300)
        tree = token_counts.CountTree.of(*token_counts.leaves(enc, t))
        ids = enc.encode(t)
        for _ in range(3):
            a = rng.randint(0, len(t))
            b, put = min(len(t), a + rng.randint(0, 12)), some(rng, 12)
            new, ids, _ = enc.edit(t, ids, a, b, put)
            t, tree, _ = token_counts.apply_edit(enc, t, tree, a, b, put)
            want = known.encode_ordinary(t)
            assert new == t and ids == enc.encode(t) and len(ids) == 4 * len(want)
            assert tree.total == len(want) and sum(tree.chars) == len(t) and tree.sums == token_counts.CountTree.of(tree.chars, tree.tokens()).sums
    long = " word" * 20_000
    tree = token_counts.CountTree.of(*token_counts.leaves(enc, long))
    assert token_counts.apply_edit(enc, long, tree, 50_000, 50_004, "other")[2] < 500


def test_bpe_query(docs, none, spark, table, known):
    got = sorted(map(tuple, QUERIES["op7_byte_bpe"](spark, table(docs)).collect()), key=str)
    want = []
    for i, t, *_ in odd_rows():
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert QUERIES["op7_byte_bpe"](spark, table(none)).count() == 0
    clash = docs.withColumn("ids", F.lit("x")).withColumn("_x", F.lit(1))
    assert bpe.encode(clash).columns == ["doc_id", "text", "lang", "source", "n_chars", "_x", "ids"]


def test_counts_query(docs, none, spark, table, known):
    got = {(r.doc_id, r.edited_sha256): r for r in QUERIES["op2_token_counts"](spark, table(docs)).collect()}
    for i, t, *_ in odd_rows():
        if t is None:
            assert got[i, None].n_tokens == 0 == got[i, None].edited_n_tokens
            continue
        new, n = t, len(t)
        new = new[: n // 2] + t[:40] + new[n // 2 + 20 :]
        new = new[: n // 4] + new[n // 4 + 10 :]
        r = got[i, hashlib.sha256(new.encode()).hexdigest()]
        assert (r.n_tokens, r.edited_n_tokens) == (len(known.encode_ordinary(t)), len(known.encode_ordinary(new)))
    assert QUERIES["op2_token_counts"](spark, table(none)).count() == 0


def test_edits_may_be_missing_or_outside(spark, known):
    rows = [(1, "one two three", [(4, 7, "2"), (100, 200, " four")]), (2, "x", None), (3, None, [(0, 0, "new")]), (4, "y", [(0, None, "z")]), (5, "abc", [(-5, 1, "")])]
    df = spark.createDataFrame(rows, "id int, text string, e array<struct<start:int,stop:int,insert:string>>")
    got = {r.id: r for r in token_counts.update(token_counts.build(df), "e").collect()}
    assert [got[i].text for i in range(1, 6)] == ["one 2 three four", "x", "new", "y", "bc"]
    assert all(got[i].sums[1] == len(known.encode_ordinary(got[i].text)) for i in range(1, 6))
