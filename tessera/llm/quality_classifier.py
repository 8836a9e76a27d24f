"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL.

Features of a text are hashed n-grams (1 and 2) over two views of its words:
the words themselves with A-Z lower-cased, and their shapes (letters as ``a``
or ``A``, digits as ``9``, runs shortened); a 2-gram of one word twice is one
feature whatever the word.  Values are square roots of counts, scaled to unit
length; a bias of 1 is always present.  The score is the sigmoid of the sparse
dot product with the weights.

Training is follow-the-regularised-leader (proximal, per coordinate), one pass
over a bounded sample: the ``max_rows`` labelled rows of smallest id hash
(default ``MAX_ROWS``).  Their texts are turned into sparse vectors on the
executors, and one task updates the weights while the vectors stream past it.
The model is one array of ``2**bits`` floats, so what is broadcast has a fixed
size.  Scoring reads every whole text.

Null and empty texts have only the bias.  Labels that are null are not
learned from; without labels every score is 0.5.  Repeated rows get equal
scores; empty tables give no rows; input columns are kept, one with the name
of an added column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_WORDS, arrow_map, mix64, prepare, rolling, text_bytes

BITS = 18
MAX_ROWS = 8192
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7
_TWICE = np.uint64(xxhash.xxh64_intdigest(b"twice", 3))
_SHAPE = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, other characters themselves, runs shortened to one."""
    return _SHAPE.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class _Words(dict):
    """word bytes -> hash of the lower-cased word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.lower(), 1)
        return got


class _Shapes(dict):
    """word bytes -> hash of the word's shape (one object per shape)."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.known.clear()
        form = shape(word.decode("utf-8", "replace"))
        got = self[word] = self.known.setdefault(form, xxhash.xxh64_intdigest(form, 2))
        return got


class _Hashes:
    def __init__(self):
        self.words, self.shapes = _Words(), _Shapes()


def features(text: bytes, cache: _Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values) of the features of a text; number 0 is the bias."""
    words = text.split()
    if not words:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    word = np.fromiter(map(cache.words.__getitem__, words), np.uint64, len(words))
    form = np.fromiter(map(cache.shapes.__getitem__, words), np.uint64, len(words))
    pairs = rolling(word, 2)
    pairs[word[1:] == word[:-1]] = _TWICE
    grams = np.concatenate([mix64(word), mix64(form), pairs, rolling(form, 2)])
    numbers, counts = np.unique((grams >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
    values = np.sqrt(counts)
    return np.r_[np.int32(0), numbers], np.r_[1, values / np.sqrt(counts.sum())].astype(np.float32)


def _vectors(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in batches:
            found = [features(t, cache, bits) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("turn"), b.column("label"), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                names=["turn", "label", "features", "x"])
    return run


def _learn(bits: int, alpha: float, beta: float, l1: float, l2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(1 << bits), np.zeros(1 << bits)

        def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

        for b in batches:
            for label, numbers, values in zip(*(b.column(c).to_pylist() for c in ("label", "features", "x"))):
                f, x = np.frombuffer(numbers, "<i4"), np.frombuffer(values, "<f4").astype(np.float64)
                zi, ni = z[f], n[f]
                w = weights(zi, ni)
                g = (1 / (1 + np.exp(-(x @ w))) - label) * x
                z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
                n[f] = ni + g * g
        yield pa.RecordBatch.from_arrays([pa.array([weights(z, n).astype("<f4").tobytes()], pa.binary())], names=["weights"])
    return run


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learned from ``labelled`` (id, 0/1 label), at most ``max_rows`` of its rows."""
    turn = F.xxhash64(F.col(id_col))
    sample = (labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), turn.alias("turn"))
              .orderBy("turn", "label").limit(max_rows))
    texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
             .join(F.broadcast(sample), "_id").select("turn", "label", "text"))  # max_rows rows at most
    vectors = arrow_map(texts, _vectors(bits), "turn long, label int, features binary, x binary")
    one = vectors.repartition(1).sortWithinPartitions("turn", "label", "features")
    model = arrow_map(one, _learn(bits, ALPHA, BETA, L1, L2), "weights binary").collect()  # one row of fixed size
    return np.frombuffer(model[0]["weights"], "<f4") if model else np.zeros(1 << bits, "<f4")


def score_column(text: Column, weights: np.ndarray) -> Column:
    """Score (0 to 1) of a text under the weights."""
    bits = int(np.log2(len(weights)))
    cache = _Hashes()  # each task gets its own copy and keeps it from batch to batch

    def run(col: pa.Array) -> pa.Array:
        dots = []
        for t in text_bytes(col):
            f, x = features(t, cache, bits)
            dots.append(float(weights[f].astype(np.float64) @ x))
        return pa.array(1 / (1 + np.exp(-np.array(dots, np.float64))), pa.float64())
    return F.arrow_udf(run, "double").asNondeterministic()(text)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    prepare(docs.sparkSession)
    return (docs.withColumn("score", score_column(F.col(text_col), weights))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
