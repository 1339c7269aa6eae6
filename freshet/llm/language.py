"""Language identification with string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import dataclasses
import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from freshet.llm.common import batches

#: Lengths of the n-grams of the blended spectrum.
NGRAMS = (1, 2, 3)
#: Bits of an n-gram's bucket. The kernel is defined on buckets, so a collision is part of it.
BITS = 20
#: Bound on the labelled rows that are fitted, for each language.
TRAIN = 300
#: Landmarks for each language, among the fitted rows.
LANDMARKS = 40
RIDGE = 0.01
#: Score of a document without letters, and its label.
UNKNOWN = "und"
#: Odd multipliers that spread code points over buckets, one for each place in an n-gram.
PLACES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point; 0 for everything that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            low = ch.lower()
            table[i] = ord(low[0])
    return table


def _symbols(text: str) -> np.ndarray:
    """Lower-case letters with every run of other characters as one 0, and a 0 at each end."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = codes
    return padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])]


def buckets(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, repeats included; none for a text without letters."""
    s = _symbols(text)
    if not s.any():
        return np.zeros(0, np.int64)
    out = []
    for n in NGRAMS:
        if len(s) >= n:
            h = np.full(len(s) - n + 1, n * 0x2545F491, np.uint32)
            for i in range(n):
                h = (h ^ s[i : len(s) - n + 1 + i]) * np.uint32(PLACES[i])
                h ^= h >> np.uint32(15)
            out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int64)


@dataclasses.dataclass
class Model:
    """Landmark presence by bucket, the map to the Nystroem features' ridge weights, and the labels."""

    labels: list[str]
    #: Row of a bucket in ``landmarks``; -1 if no landmark has it.
    rows: np.ndarray
    #: Bucket x landmark presence, divided by the root of the landmark's size.
    landmarks: np.ndarray
    #: Landmark x label: kernel values to scores.
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised presence kernel of texts with the landmarks, and which texts have letters."""
        present = np.zeros((len(texts), len(self.landmarks)), np.float32)
        size = np.zeros(len(texts), np.float64)
        seen = np.zeros(1 << BITS, bool)
        for i, t in enumerate(texts):
            b = buckets(t)
            if len(b):
                seen[b] = True
                size[i] = np.count_nonzero(seen)
                r = self.rows[b]
                present[i, r[r >= 0]] = 1
                seen[b] = False
        return (present @ self.landmarks) / np.sqrt(np.maximum(size, 1))[:, None], size > 0

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k, known = self.kernel(texts)
        return k @ self.weights + self.bias, known

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Label and a score from 0 to 1: how far the best one-versus-rest value lies above the next."""
        values, known = self.scores(texts)
        best = values.argmax(1)
        names = [self.labels[j] if ok else UNKNOWN for j, ok in zip(best, known)]
        if len(self.labels) > 1:
            top = np.sort(values, 1)[:, -2:]
            margin = (top[:, 1] - top[:, 0]) / 2
        else:
            margin = np.ones(len(texts))
        return names, np.where(known, np.clip(margin, 0.0, 1.0), 0.0).astype(np.float64)


def ridge(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge_: float = RIDGE) -> Model:
    """Fit from bucket sets: landmarks are the first sets of each language, targets are +1 and -1 for each label."""
    labels = sorted(set(langs))
    chosen, taken = [], dict.fromkeys(labels, 0)
    for i, lang in enumerate(langs):
        if taken[lang] < landmarks and len(sets[i]):
            taken[lang] += 1
            chosen.append(i)
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
    rows = np.full(1 << BITS, -1, np.int32)
    rows[vocabulary] = np.arange(len(vocabulary))
    marks = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[rows[sets[i]], j] = 1 / np.sqrt(len(sets[i]))
    k = np.zeros((len(sets), len(chosen)))
    for i, s in enumerate(sets):
        r = rows[s]
        k[i] = marks[r[r >= 0]].sum(0, dtype=np.float64) / np.sqrt(max(1, len(s)))
    among = k[chosen]
    value, vector = np.linalg.eigh((among + among.T) / 2)
    good = value > 1e-8 * max(1.0, value.max(initial=0.0))
    root = vector[:, good] / np.sqrt(value[good])
    x = k @ root
    y = np.array([[1.0 if lang == name else -1.0 for name in labels] for lang in langs]).reshape(len(langs), len(labels))
    count = Counter(langs)
    weight = np.array([1 / count[lang] for lang in langs])[:, None]
    weight = weight / max(weight.sum(), 1e-300)
    mean_x, mean_y = (weight * x).sum(0), (weight * y).sum(0)
    xc, yc = x - mean_x, y - mean_y
    w = np.linalg.solve(xc.T @ (weight * xc) + ridge_ * np.eye(x.shape[1]) / max(1, len(langs)), xc.T @ (weight * yc))
    return Model(labels, rows, marks, (root @ w).astype(np.float32), (mean_y - mean_x @ w).astype(np.float32))


def fit(labelled: DataFrame, text: str, lang: str, key: str, train: int = TRAIN, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most about ``train`` rows of each language, picked by the hash of the row's key and text.

    A first pass counts the languages; a second keeps a row if its hash lies under the share
    that gives 1.2 times the bound, and only those rows' n-gram buckets reach the driver, where
    the bound itself is applied in hash order. Rows with a NULL label or without letters are left out.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.shiftrightunsigned(F.xxhash64(key, text, F.lit(8)), 11).alias("draw")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ridge([], [])
    share = F.create_map(*[F.lit(x) for lg, n in counts.items() for x in (lg, min(1.0, 1.2 * train / n + 20 / n))])
    picked = rows.where(F.col("draw") < share[F.col("lang")] * float(1 << 53))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 256):
            sets = [np.unique(buckets(t)).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sets, pa.binary())], names=["lang", "draw", "grams"])

    got = sorted(picked.mapInArrow(run, "lang string, draw bigint, grams binary").where("length(grams) > 0").collect(), key=lambda r: (r["lang"], r["draw"], r["grams"]))
    sets, langs, taken = [], [], {}
    for r in got:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= train:
            sets.append(np.frombuffer(r["grams"], np.int32).astype(np.int64))
            langs.append(r["lang"])
    return ridge(sets, langs, landmarks)


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted label and its score, from the whole text alone.

    A NULL text, and one without a letter, gets ``und`` and 0; so does every text if nothing
    was learned. Ties go to the first label in code point order. Columns of the same names are replaced.
    """
    cols = [n for n in docs.columns if n not in (label, score)]
    parts = [model.labels, model.rows.tobytes(), model.landmarks.shape, zlib.compress(np.packbits(model.landmarks > 0).tobytes(), 1), model.landmarks.max(0, initial=0).tolist(), model.weights, model.bias]
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # bounded by the fitted sample

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows, shape, bits, scale, weights, bias = shared.value
        present = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=shape[0] * shape[1]).reshape(shape)
        m = Model(labels, np.frombuffer(rows, np.int32), present * np.array(scale, np.float32), weights, bias)
        for b in batches(it, 128):
            texts = [x or "" for x in b.column(len(cols)).to_pylist()]
            if labels:
                names, values = m.predict(texts)
            else:
                names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*cols, label, score])

    src = docs.select(*[F.col(f"`{n}`") for n in cols], F.col(f"`{text}`").alias("_text_in"))
    return src.mapInArrow(run, src.drop("_text_in").schema.add(label, T.StringType()).add(score, T.DoubleType()))


def lettered(text: str) -> Column:
    """Whether a text holds a letter; false for NULL. What ``predict`` would label if it had learned a language."""
    return F.coalesce(F.rlike(F.col(f"`{text}`"), F.lit(r"\p{L}")), F.lit(False))


def held_out(key: str):
    """Every fourth document by the checksum of its id: never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
