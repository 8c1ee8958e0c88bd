"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased letters (all else is one blank), with sublinear
counts, inverse document frequency and unit length. The model is trained by follow-the-regularised-
leader with an elastic net, then one temperature is fitted on rows kept out of that training, against
targets smoothed by their number: of n rows with a label and K labels, (n + 1) / (n + K) for the label itself
and 1 / (n + K) for each other. So a sample without a single error doesn't make the model certain.

Only rows with a non-null label and text whose crc32(id as text) mod 3 is not 1 are learned from, and
of these a sample chosen by a hash of id and text, repeated rows once: about PER_LANG rows of each label. The
driver gets their counts, at most 2^BITS a row however long the text, so what reaches it does not grow with
the input. Prediction reads whole texts, PIECE characters at a time, and nothing else. A text that is
null or has no letter is `und` with score 0; so is all when nothing could be learned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import map_rows, only, slices

#: Rows of each label that the classifier is fitted on, on average.
PER_LANG = 800
BITS = 15
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3
UND = "und"
#: Characters of a text that are worked on at once: about 100 bytes of memory each.
PIECE = 1 << 18
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(1)
def _letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


@dataclass
class Features:
    """counts(text): hashed n-gram numbers and counts; empty where the text has no letter."""

    letters: np.ndarray

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text, n, known = text or "", np.zeros(1 << BITS, np.int64), False
        last = np.empty(0, np.uint64)  # up to two characters before the next ones
        for start in range(0, len(text), PIECE):
            c = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = self.letters[c]
            known |= bool(letter.any())
            # Lower case of a capital sigma depends on what follows it: both small ones are one character.
            c = np.where(letter, np.where(c == 0x3C2, 0x3C3, c), 32)
            before = c[:0] if not start else last[-1:].astype(c.dtype)
            first = not (start and before[0] == 32 and c[0] == 32)
            c = c[(c != 32) | np.concatenate([[first], c[1:] != c[:-1]])]
            last = self._add(n, last, np.concatenate([[32], c]) if not start else c)
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        self._add(n, last, np.array([32]))
        at = np.flatnonzero(n)
        return at, n[at]

    @staticmethod
    def _add(n: np.ndarray, last: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Counts the n-grams that end in new, after last, and returns the last two characters."""
        c = np.concatenate([last, new.astype(np.uint64)])
        h1 = c * _MULTIPLIERS[0]
        h2 = h1[:-1] + c[1:] * _MULTIPLIERS[1]
        h3 = h2[:-1] + c[2:] * _MULTIPLIERS[2]
        shift = np.uint64(64 - BITS)
        h = np.concatenate([h1[len(last) :], h2[max(len(last) - 1, 0) :] ^ np.uint64(0x5851F42D4C957F2D), h3])
        n += np.bincount(((h ^ (h >> np.uint64(29))) * _MULTIPLIERS[0] >> shift).astype(np.int64), minlength=1 << BITS)
        return c[-2:]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return v / max(np.sqrt(v @ v), 1e-12)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, at: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        if not len(at) or not self.labels:
            return UND, 0.0
        p = softmax(weighted(at, n, self.idf) @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def calibrated(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the least cross entropy against smoothed targets; 1 without rows. The loss is convex in
    the inverse temperature, whose slope is halved to 0; without one (all logits equal) it is 1 as well."""
    k = logits.shape[1] if len(logits) else 0
    if k < 2 or not np.ptp(logits, 1).any():
        return 1.0
    size = np.bincount(ys, minlength=k)[ys][:, None]
    target = ((np.arange(k) == ys[:, None]) * size + 1) / (size + k)
    slope = lambda b: ((softmax(logits * b) - target) * logits).sum()
    low, high = -7.0, 7.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(np.exp(middle)) < 0 else (low, middle)
    return float(np.exp(-(low + high) / 2))


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, label) rows, in the order given; every fifth row is kept for calibration."""
    features = Features(_letter_table())
    return fit_counts([(*features.counts(t), y) for t, y in rows])


def fit_counts(data: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """fit() of rows that are counted already."""
    data = [x for x in data if len(x[0])]
    labels = sorted({y for *_, y in data})
    seen = np.zeros(1 << BITS)
    for at, _, _ in data:
        seen[at] += 1
    idf = np.log((1 + len(data)) / (1 + seen)) + 1
    vectors = [(at, weighted(at, n, idf), labels.index(y)) for at, n, y in data]
    train, held = [x for i, x in enumerate(vectors) if i % 5], vectors[::5]
    z, n = np.zeros((1 << BITS, len(labels))), np.zeros((1 << BITS, len(labels)))

    def now(at=slice(None)):
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, v, y in train:
            w = now(at)
            g = v[:, None] * (softmax(v @ w) - (np.arange(len(labels)) == y))
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    weights, temperature = now().astype(np.float32), 1.0
    if held and labels:
        temperature = calibrated(np.stack([v @ weights[at] for at, v, _ in held]), np.array([y for *_, y in held]))
    return Model(labels, weights, idf.astype(np.float32), temperature)


def packed(at: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, which the driver holds without an object a number; at sorts as an array of its numbers would."""
    return at.astype(">u2").tobytes(), n.astype("<u8").tobytes() if n.max(initial=0) >= 1 << 32 else n.astype("<u4").tobytes()


def unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(at, ">u2").astype(np.uint16)
    return at, np.frombuffer(n, "<u8" if len(n) > 4 * len(at) else "<u4")


def remainder(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model of docs (doc_id, text, lang)."""
    usable = only(docs, doc_id="long", text="string", lang="string").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 1))
    usable = usable.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.countDistinct("doc_id", "place").alias("n")).collect()}
    if not sizes:
        return fit([])
    least = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, per_lang / n) * (1 << 30)))])
    chosen = usable.filter(F.col("place") < F.element_at(least, F.col("lang"))).dropDuplicates(["lang", "doc_id", "text"])

    def make() -> Callable:
        features = Features(_letter_table())
        return lambda columns: ((k, p, y, *packed(*features.counts(t))) for k, t, y, p in zip(*columns))

    counted = map_rows(chosen.select("doc_id", "text", "lang", "place"), "doc_id long, place long, lang string, at binary, n binary", make)
    rows = counted.orderBy("place", "doc_id", "lang", "at").collect()
    return fit_counts([(*unpacked(r["at"], r["n"]), r["lang"]) for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        features, m = Features(_letter_table()), held.value
        return lambda columns: ((k, *m.predict(*features.counts(t))) for k, t in zip(*columns))

    return map_rows(only(docs, doc_id="long", text="string"), "doc_id long, lang_pred string, score double", make)


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a label with at least this score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(_letter_table()), held.value
        for whole in batches:
            for part in slices(whole):
                found = [m.predict(*features.counts(t)) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([label != UND and score >= least for label, score in found]))

    return docs.mapInArrow(run, docs.schema)


def language_report(docs: DataFrame) -> DataFrame:
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
