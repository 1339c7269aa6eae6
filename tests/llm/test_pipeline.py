from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import bpe, language
from freshet.llm.queries import QUERIES

from .conftest import odd_rows

SYLLABLES = {"en": "th ing ed er an on st re nd at".split(), "fr": "eau eux que ment tion ou ai re le é".split(), "de": "sch ung ich en der ei ß ü tz ver".split()}


def spoken(lang, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60))


def test_language_query(spark, table, docs, none):
    rows = [(1000 + i, spoken(lang, 3 * i + j), lang, "s", 0) for i in range(120) for j, lang in enumerate(SYLLABLES)]
    df = spark.createDataFrame(rows, docs.schema).union(docs.where("lang IS NULL"))
    got = QUERIES["op8_language"](spark, table(df)).collect()
    truth = {(r[0], r[2]) for r in rows}
    assert len(got) == df.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id == 6} == {"und"}
    counts = {}
    for r in got:
        counts.setdefault(r.doc_id, []).append(r.lang_pred)
    for i in {t[0] for t in truth}:
        assert sorted(counts[i]) == sorted(x for j, x in truth if j == i)
    assert QUERIES["op8_language"](spark, table(none)).count() == 0
    odd = {(r.doc_id, r.lang_pred) for r in QUERIES["op8_language"](spark, table(docs)).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (10, "und")} <= odd


def test_kernel_is_the_presence_kernel():
    texts = [spoken(x, i) for i, x in enumerate(SYLLABLES)] + ["a", "12"]
    sets = [set(language.buckets(t).tolist()) for t in texts]
    model = language.ridge([np.array(sorted(s), np.int64) for s in sets[:3]], list(SYLLABLES))
    k, known = model.kernel(texts)
    want = [[len(a & b) / np.sqrt(max(1, len(a)) * len(b)) for b in sets[:3]] for a in sets]
    assert np.allclose(k, want, atol=1e-6) and known.tolist() == [True] * 4 + [False]


def test_ridge_is_the_weighted_least_squares_fit():
    langs = ["en"] * 12 + ["fr"] * 7 + ["de"] * 5
    sets = [set(language.buckets(spoken(x, i)).tolist()) for i, x in enumerate(langs)]
    model = language.ridge([np.array(sorted(s), np.int64) for s in sets], langs, landmarks=4)
    marks = sets[:4] + sets[12:16] + sets[19:23]
    among, k = (np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in marks] for a in rows]) for rows in (marks, sets))
    x = np.linalg.solve(np.linalg.cholesky(among), k.T).T
    weight = np.sqrt([1 / langs.count(a) / 3 for a in langs])[:, None]
    y = np.array([[1.0 if a == b else -1.0 for b in ("de", "en", "fr")] for a in langs])
    penalty = np.hstack([np.sqrt(language.RIDGE / len(langs)) * np.eye(12), np.zeros((12, 1))])
    a = np.vstack([weight * np.hstack([x, np.ones((24, 1))]), penalty])
    w = np.linalg.lstsq(a, np.vstack([weight * y, np.zeros((12, 3))]), rcond=None)[0]
    want = np.hstack([x, np.ones((24, 1))]) @ w
    texts = [spoken(a, i) for i, a in enumerate(langs)]
    got, _ = model.scores(texts)
    assert model.labels == ["de", "en", "fr"] and np.allclose(got, want, atol=1e-3)
    names, score = model.predict(texts)
    top = np.sort(want, 1)
    assert names == [model.labels[j] for j in want.argmax(1)] and np.allclose(score, np.clip((top[:, 2] - top[:, 1]) / 2, 0, 1), atol=1e-3)


def test_corpus_without_labels_keeps_what_has_letters(spark, docs):
    for df in (docs.withColumn("lang", F.lit(None).cast("string")), docs.where(language.held_out("doc_id"))):
        left = corpus_pipeline.languages(spark, df, "")
        want = [r.doc_id for r in df.collect() if any(c.isalpha() for c in r.text or "")]
        assert want and sorted(map(str, want)) == sorted(str(r.doc_id) for r in left.collect()) and left.dtypes == df.dtypes


def test_fit_does_not_depend_on_the_partitions(spark, docs):
    rows = [(i, spoken(lang, 7 * i + j), lang, "s", 0) for i in range(40) for j, lang in enumerate(SYLLABLES)]
    df = spark.createDataFrame(rows, docs.schema)
    a, b = (language.fit(df.repartition(n), "text", "lang", "doc_id", train=20, landmarks=5) for n in (1, 5))
    assert a.labels == b.labels and np.allclose(a.weights, b.weights) and (a.rows == b.rows).all()


def test_stages_and_run(spark, docs, none, table):
    extra = docs.withColumn("copies", F.lit(1)).withColumn("_key", F.lit("k"))
    for df in (docs, none, extra):
        path, now = table(df), df
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, spark.createDataFrame(stage(spark, now, path).collect(), stage(spark, now, path).schema)
            if name != "byte_bpe":
                assert now.dtypes == df.dtypes
            if name == "language":
                assert {r.doc_id for r in before.collect()} - {r.doc_id for r in now.collect()} <= {4, 5, 6, 10}
            if name in ("line_dedup", "near_copies"):
                assert now.count() <= before.count()
        assert corpus_pipeline.run(spark, path).count() == now.count()
        texts = [bpe.Encoder(bpe.rank_file(), bpe.public_tokenizers.PATTERN).decode(r.ids) for r in now.limit(3).collect()]
        assert all(texts)
    assert len(odd_rows()) == docs.count()
