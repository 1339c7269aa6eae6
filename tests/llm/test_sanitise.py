"""Values against plain patterns, telling words against counts by hand."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import queries, sanitise
from freshet.llm.common import kept

PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def good(kind, value):
    digits = [int(x) for x in value if x.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), no, m.end(), kind) for no, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def values(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = rows.select("i", sanitise.values(F.col("text")).alias("s")).collect()
    return {r.i: [(s.kind, s.start, s.stop) for s in r.s] for r in got}


def luhn(rng, n):
    d = [rng.randint(0, 9) for _ in range(n - 1)]
    s = sum(2 * x - 9 * (x > 4) if i % 2 == 0 else x for i, x in enumerate(d[::-1]))
    return "".join(map(str, [*d, -s % 10]))


def test_values_against_plain_patterns(spark):
    rng = random.Random(11)
    texts = [None, "", "a@b.c", "a@b.c_x@y.org", "a@@b.c", "x@a..b", "x@a.b.", "x@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "0001.02.3.255", "+1", "+12", "+1 2", "+1 (988) 555-2485.", "12--34"]
    texts += ["".join(rng.choice(["ab", "1", ".", ".c", "@", "@d", "-", "_", " ", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("0123456789 -.+()x🙂") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for _ in range(500):
        c = luhn(rng, rng.randint(10, 21))
        c = "".join(x + rng.choice(["", "", "", " ", "-"]) for x in c)
        texts.append("é " + rng.choice(["", "7", "7 ", "x"]) + c + rng.choice(["", "3", " 4", ".", "@a.b"]))
    got = values(spark, texts)
    assert sum(map(len, got.values())) > 1000
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, wrong[:3]


def test_long_texts_and_many_values(spark):
    """Runs on which plain patterns would try every start, and thousands of values in one text."""
    n = 100_000
    ips = [("ip", 8 * i, 8 * i + 7) for i in range(n // 4)]
    want = {
        "a" * n: [], "1" * n: [], "a@b" * n: [], "1 " * n: [], "+1 " * n: [], "a@" + "b." * n + "b": [("email", 0, 2 * n + 3)], "1." * n: ips,
        "a@b.cd " * 3_000 + "ü": [("email", 7 * i, 7 * i + 6) for i in range(3_000)],
        "1.1.1.1 +123456789; " * 2_000: [x for i in range(2_000) for x in (("ip", 20 * i, 20 * i + 7), ("phone", 20 * i + 8, 20 * i + 18))],
    }
    got = values(spark, list(want))
    for i, (text, spans) in enumerate(want.items()):
        assert got[i] == spans, text[:40]
    short = ["a" * 400, "a@b" * 200, "a@" + "b." * 300, "1." * 300, "a@b.cd " * 30 + "ü", "1.1.1.1 +123456789 " * 20, "1 " * 300]
    got = values(spark, short)
    assert [got[i] for i in range(len(short))] == [plain(t) for t in short]


def corpus():
    """A word that stands only by one address, one that often does, one that everybody uses, and copies."""
    rng = random.Random(5)
    some = lambda: " ".join(rng.choice(["river", "stone", "house", "green", "light"]) + str(rng.randint(0, 999)) for _ in range(6))
    rows = [f"{some()} Zorblatt wrote ann@mail.org today {some()}" for _ in range(6)]
    rows += [f"{some()} Quux wrote bob@mail.org today {some()}" for _ in range(4)] + [f"{some()} Quux {some()}" for _ in range(2)]
    rows += [f"{some()} wrote today {some()}" for _ in range(60)]
    rows += [f"only copies Flimflam carl@mail.org {some()}"] * 9
    rows += ["Zorblatt, Zorblattish and (Zorblatt) ann@mail.org.", None, "", "été Quux 🙂 Quux"]
    return rows


def by_hand(texts):
    """Words to hide, from counts over the documents."""
    words = lambda x: re.split(r"[\W_]+", x)
    good_words = lambda ws: [w for w in ws if len(w) >= 3 and w[0].isalpha()]
    places, together, everywhere = defaultdict(set), Counter(), Counter()
    for text in texts:
        text = text or ""
        everywhere.update(set(words(text)))
        pairs = set()
        for kind, pattern in PLAIN:
            found = [m for m in re.finditer(pattern, text)]
            for i, m in enumerate(found):
                before = text[found[i - 1].end() if i else 0 : m.start()]
                after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
                if not good(kind, m[0]):
                    continue
                a, b = words(before[-200:]), words(after[:200])
                near = good_words(a[1:] if len(before) > 200 else a)[-8:] + good_words(b[:-1] if len(after) > 200 else b)[:8]
                for w in near:
                    places[kind, m[0].lower(), w].add(tuple(near))
                    pairs.add((kind, m[0].lower(), w))
        together.update(pairs)
    bits = {}
    for k, where in places.items():
        left = math.log2(everywhere[k[2]] / together[k])
        if len(where) >= 3 and left <= 1:
            bits[k[2]] = min(left, bits.get(k[2], 9))
    return bits


def test_telling_words(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    base = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", sanitise.values(F.col("text")))
    base = kept(base, "values")
    got = {r.word: (r.bits, r.action) for r in sanitise.telling(docs, sanitise.candidates(base)).collect()}
    want = by_hand(texts)
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: v[0] for k, v in got.items()}
    assert got["Zorblatt"][1] == "remove" and got["Quux"][1] == "generalise"
    assert not {"Flimflam", "copies", "wrote", "today"} & set(got)


def test_scan_and_cleaned_text(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, spans string, k1 int")
    done = sanitise.scan(docs).collect()
    assert len(done) == len(texts)
    tell = set(by_hand(texts))
    for r in done:
        text = texts[r.doc_id] or ""
        base = plain(text)
        word = [("word", m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0] in tell and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert sorted((s.start, s.kind, s.stop) for s in r.spans) == sorted((a, k, b) for k, a, b in base + word)
    spans = spark.createDataFrame(done).withColumnRenamed("spans", "found")
    clean = {r.doc_id: r.clean for r in docs.join(spans, "doc_id").select("doc_id", sanitise.cleaned("text", "found").alias("clean")).collect()}
    assert clean[texts.index("été Quux 🙂 Quux")] == "été [WORD] 🙂 [WORD]"
    assert clean[len(texts) - 4] == ", Zorblattish and () [EMAIL]."
    assert not any("@mail" in (t or "") or "Zorblatt " in (t or "") for t in clean.values())


def test_query_on_odd_rows(spark, table, docs, none):
    more = [(500, "mail me: x.y@z.org or +1 (988) 555-2485, 10.0.0.1", "en", "a", 1), (501, "4041894974608795 é 4041894974608795", None, None, None)]
    rows = docs.union(spark.createDataFrame(more, docs.schema))
    got = queries.QUERIES["op11_sanitise"](spark, table(rows)).collect()
    want = sorted(((r.doc_id, plain(r.text)) for r in rows.collect()), key=repr)
    shown = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got), key=repr) == sorted(
        ((d, *(sum(x[0] == k for x in s) for k, _ in PLAIN), hashlib.sha256(shown(s).encode()).hexdigest(), shown(s)) for d, s in want), key=repr
    )
    assert queries.QUERIES["op11_sanitise"](spark, table(none)).count() == 0


def test_spread_words_are_joined_without_a_broadcast(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = sorted(map(repr, sanitise.scan(docs).collect()))
    monkeypatch.setattr(sanitise, "BROADCAST", 0)
    assert sorted(map(repr, sanitise.scan(docs).collect())) == want
