"""Helpers shared by the training-data operators.

A *word* is a maximal run of bytes other than space, tab, LF, VT, FF and CR.
Python's ``bytes.split()`` splits UTF-8 bytes on exactly that set, so the
Arrow-side operators work on UTF-8 bytes and never on ``str.split``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize, shared_dir, ship_package, track  # noqa: F401  (re-exported)

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 4 << 20  # text handled at once by the Arrow-side operators
CACHE_WORDS = 1 << 18  # a word cache is emptied beyond this many entries (some 50 MB)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of every text of an Arrow string column, null as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return [b""] * len(col)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b if b is not None else b"" for b in col.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows whose texts hold about ``limit`` bytes."""
    i = batch.schema.get_field_index(column)
    sizes = [len(b) for b in text_bytes(batch.column(i))]
    begin = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


class WordHashes(dict):
    """word bytes -> seeded 64-bit hash, computed once per distinct word."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a linear rolling hash over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every window of ``n`` word hashes (empty when there is none)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = acc * np.uint64(base) + h[k:k + m]
        return mix64(acc)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep the session's Arrow batches
    small: texts are large, and a batch is held by Spark and by the worker."""
    ship_package(spark)
    now = spark.conf.get(_BATCH, "64m").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped and batches kept small."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def partition_starts(totals: DataFrame, pid: str, *sums: str) -> DataFrame:
    """(pid, <sum>_before ...): exclusive prefix sums over one row per partition.

    ``totals`` has one row per task partition, never per data row, so the
    single ordered window stays tiny.
    """
    w = W.orderBy(pid).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(pid, *[F.coalesce(F.sum(s).over(w), F.lit(0)).cast("long").alias(f"{s}_before") for s in sums])


def neutral(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named c0, c1, ... and the new names of some of its columns.

    Operators that keep all input columns work on these, so no input name can
    clash with theirs, and give the old names back at the end.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``materialize`` with zstd: for intermediates that hold tokens or hashes."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    track(path)
    return df.sparkSession.read.parquet(path)
