"""Exact substring dedup with fixed-block anchors.

Every word of a document that lies in a window of ``window`` (13) consecutive
words which also starts in a document of smaller id is removed.

Any 13-word window holds a whole block of 7 words that starts at a multiple of
7, so: the non-overlapping 7-word blocks of all documents are the index, every
rolling 7-word window is a probe, and a repeated passage cannot hide from
both.  Around a hit the 13-word windows are compared exactly (96-bit hashes),
and the covered words merge into maximal repeats.

Steps, all keyed by *chunk* (a run of about 4 MB of texts from one task):

1. Documents are dealt by chunk once and written bucketed by it, one file a
   bucket, so later passes over the texts meet their hits without shuffling a
   text again.  ``spark.sql.shuffle.partitions`` sets the number of buckets, and
   so of files.  ``drop_materialized`` drops the table with its folder.
2. Exact copies (equal word sequences) are found by hash; all but the smallest
   id are wholly repeated and take no further part.  A hot group of copies is
   so reduced by a map-side minimum before anything is compared.
3. Anchors: every chunk sends its distinct rolling hashes, packed, to the hash
   ranges; a range answers each chunk with the hashes that are a block
   somewhere and occur twice.  A passage shared by millions of documents is
   one entry per chunk.
4. Windows: for windows around anchors a chunk sends (hash, smallest id), and
   is told the smaller id if another chunk has one.
5. Texts are cut.

The number of hash ranges follows the number of words, so each holds a bounded
number of entries whatever the size.

Words are runs of bytes other than space, tab, LF, VT, FF and CR.  Null and
empty texts and texts shorter than a window lose nothing.  Rows with a null id
are neither compared nor cut.  Rows that repeat an id are separate documents
of that id: neither is smaller, so they do not remove each other.  Empty
tables give no rows.  Other input columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, arrow_map, materialize, neutral, rolling, shared_dir, slices, text_bytes, track, written

WINDOW = 13
CHUNK = 4 << 20  # bytes of text in a chunk
RANGE_WORDS = 1 << 20  # words per hash range
_LOW = 38  # hash bits kept inside a range
_COPY, _ANCHOR, _SMALLER = 0, 1, 2  # kinds of what a chunk is told
_SIDE = "_chunk long, kind int, at int, data binary"


# ---- packing: arrays of hashes as bytes, one byte plane after the other, so sorted values compress ----

def _pack(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


# ---- step 1: chunks ----

def _chunked(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    pid, chunk, held, row = TaskContext.get().partitionId(), 0, 0, 0
    for batch in batches:
        for part in slices(batch, text_col, CHUNK):
            texts = text_bytes(part.column(text_col))
            size = sum(map(len, texts))
            if held and held + size > CHUNK:
                chunk, held, row = chunk + 1, 0, 0
            counts, seqs = [], []
            for t in texts:
                words = t.split()
                counts.append(len(words))
                seqs.append(xxhash.xxh3_128_digest(b" ".join(words)))
            n = len(texts)
            extra = [pa.array(np.full(n, (pid << 32) | chunk, np.int64)), pa.array(np.arange(row, row + n, dtype=np.int32)),
                     part.column(id_col).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(seqs, pa.binary())]
            held, row = held + size, row + n
            yield pa.RecordBatch.from_arrays(part.columns + extra,
                                             names=[*part.schema.names, "_chunk", "_row", "_id", "_words", "_seq"])


def _write_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with their chunk, as a table bucketed by it."""
    spark = docs.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = arrow_map(docs, lambda it: _chunked(it, id_col, text_col),
                     f"{fields}, _chunk long, _row int, _id long, _words long, _seq binary")
    path = shared_dir(spark, "substring-chunks")
    name = "substring_" + path.rsplit("-", 1)[-1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartition(n, "_chunk").write.format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(n, "_chunk").saveAsTable(name))
    track(path, name)
    return spark.table(name)


# ---- a chunk's words, windows and anchors ----

class _Chunk:
    """Word hashes of the compared documents of a chunk, end to end."""

    def __init__(self, texts: list[bytes], ids: list[int | None], skip: np.ndarray, seen: WordHashes):
        hashed = [seen.of(t.split()) if use else np.empty(0, np.uint64) for t, use in zip(texts, ~skip)]
        self.sizes = np.array([len(h) for h in hashed], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.concatenate(hashed or [np.empty(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        place = np.arange(len(self.hashes)) - self.starts[self.doc]
        self.place, self.left = place, self.sizes[self.doc] - place

    def windows(self, n: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the windows of n words inside one document."""
        at = np.flatnonzero(self.left >= n)
        return at, rolling(self.hashes, n, base)[at] if len(at) else np.empty(0, np.uint64)


def _keys(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(range, hash inside the range)."""
    return ((hashes >> np.uint64(_LOW)) % np.uint64(ranges)).astype(np.int64), hashes & np.uint64((1 << _LOW) - 1)


def _chunk_of(docs: pa.Table, side: pa.Table | None, text_col: str, window: int) -> tuple[_Chunk, np.ndarray, list[bytes]]:
    copies = np.zeros(docs.num_rows, bool)
    rows = np.array(docs.column("_row").to_pylist(), np.int64)
    if side is not None:
        dead = [r for k, r in zip(side.column("kind").to_pylist(), side.column("at").to_pylist()) if k == _COPY]
        copies = np.isin(rows, np.array(dead, np.int64))
    ids = docs.column("_id").to_pylist()
    short = np.array([n < window or i is None for n, i in zip(docs.column("_words").to_pylist(), ids)], bool)
    texts = text_bytes(docs.column(text_col))
    return _Chunk(texts, ids, copies | short, WordHashes()), copies, texts


def _told(side: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return [(a, d) for k, a, d in zip(side.column("kind").to_pylist(), side.column("at").to_pylist(),
                                      side.column("data").to_pylist()) if k == kind]


def _candidates(chunk: _Chunk, side: pa.Table, window: int, ranges: int) -> np.ndarray:
    """Start positions of the windows that hold an anchor hit."""
    block = (window + 1) // 2
    known = [(np.uint64(p) << np.uint64(_LOW)) | _unpack(d, 5) for p, d in _told(side, _ANCHOR)]
    at, h = chunk.windows(block)
    if not known or not len(at):
        return np.empty(0, np.int64)
    p, low = _keys(h, ranges)
    hit = np.zeros(len(chunk.hashes) + 1, np.int64)
    hit[at[np.isin((p.astype(np.uint64) << np.uint64(_LOW)) | low, np.concatenate(known))]] = 1
    upto = np.r_[0, np.cumsum(hit)]
    first = np.flatnonzero(chunk.left >= window)
    return first[upto[first + window - block + 1] > upto[first]]


def _window_hashes(chunk: _Chunk, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (64 and 32 bits) of the windows at some positions."""
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return (rolling(chunk.hashes, window)[at],
            rolling(chunk.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5), window, 0xD6E8FEB86659FD93)[at] >> np.uint64(32))


def _by_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of equal runs) of 96-bit hashes."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)


# ---- step 3: anchors ----

def _send_probes(text_col: str, window: int, ranges: int):
    block = (window + 1) // 2

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            chunk, _, _ = _chunk_of(docs, side, text_col, window)
            at, h = chunk.windows(block)
            p, low = _keys(h, ranges)
            order = np.lexsort((low, p))
            p, low, is_block = p[order], low[order], (chunk.place[at] % block == 0)[order]
            starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (low[1:] != low[:-1])]) if len(p) else np.empty(0, int)
            if len(starts):
                anchors = np.logical_or.reduceat(is_block, starts)
                twice = np.diff(np.r_[starts, len(p)]) > 1
                value = low[starts] << np.uint64(2) | anchors.astype(np.uint64) << np.uint64(1) | twice.astype(np.uint64)
                cuts = np.flatnonzero(np.diff(p[starts])) + 1
                name = docs.column("_chunk")[0].as_py()
                out = [(int(q[0]), name, _pack(v, 5)) for q, v in zip(np.split(p[starts], cuts), np.split(value, cuts))]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3,
                                                                    (pa.int32(), pa.int64(), pa.binary()))],
                                    names=["p", "_chunk", "data"])
    return run


def _answer(chunks: list[int], lengths: list[int], hit: np.ndarray, packed, p: int, kind: int) -> pa.Table:
    """One row for each chunk that has hits among its entries."""
    rows, begin = [], 0
    for c, n in zip(chunks, lengths):
        mine = np.flatnonzero(hit[begin:begin + n]) + begin
        if len(mine):
            rows.append((c, kind, p, packed(mine)))
        begin += n
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4,
                                                                (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                names=["_chunk", "kind", "at", "data"])


def _find_anchors(t: pa.Table) -> pa.Table:
    """Of one hash range: the entries that are a block somewhere and occur twice."""
    parts = [_unpack(d, 5) for d in t.column("data").to_pylist()]
    v = np.concatenate(parts)
    low = v >> np.uint64(2)
    uniq, back, count = np.unique(low, return_inverse=True, return_counts=True)
    block = np.zeros(len(uniq), bool)
    block[back[(v & np.uint64(2)) > 0]] = True
    twice = count > 1
    twice[back[(v & np.uint64(1)) > 0]] = True
    hit = (block & twice)[back]
    return _answer(t.column("_chunk").to_pylist(), [len(x) for x in parts], hit, lambda i: _pack(low[i], 5),
                   t.column("p")[0].as_py(), _ANCHOR)


# ---- step 4: windows ----

def _send_windows(text_col: str, window: int, ranges: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            chunk, _, _ = _chunk_of(docs, side, text_col, window)
            at = _candidates(chunk, side, window, ranges)
            h1, h2 = _window_hashes(chunk, at, window)
            order, starts = _by_hash(h1, h2)
            if len(starts):
                least = np.minimum.reduceat(chunk.ids[chunk.doc[at]][order], starts)
                a, b = h1[order][starts], h2[order][starts]
                p, _ = _keys(a, ranges)
                by = np.argsort(p, kind="stable")
                name = docs.column("_chunk")[0].as_py()
                for q in np.split(by, np.flatnonzero(np.diff(p[by])) + 1):
                    out.append((int(p[q[0]]), name, _pack(a[q], 8), _pack(b[q], 4), _pack(least[q].view(np.uint64), 8)))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)],
                                    names=["p", "_chunk", "h1", "h2", "least"])
    return run


def _find_smaller(t: pa.Table) -> pa.Table:
    """Of one hash range: the windows of a chunk that start in a smaller id of another chunk."""
    parts = [_unpack(d, 8) for d in t.column("h1").to_pylist()]
    h1 = np.concatenate(parts)
    h2 = np.concatenate([_unpack(d, 4) for d in t.column("h2").to_pylist()])
    ids = np.concatenate([_unpack(d, 8) for d in t.column("least").to_pylist()]).view(np.int64)
    order, starts = _by_hash(h1, h2)
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.r_[starts, len(ids)]))
    return _answer(t.column("_chunk").to_pylist(), [len(x) for x in parts], least < ids,
                   lambda i: _pack(h1[i], 8) + _pack(h2[i], 4) + _pack(least[i].view(np.uint64), 8),
                   t.column("p")[0].as_py(), _SMALLER)


# ---- step 5: cutting ----

def _cut(text_col: str, window: int, ranges: int, schema: pa.Schema, columns: list[str]):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        chunk, copies, texts = _chunk_of(docs, side, text_col, window)
        at = _candidates(chunk, side, window, ranges)
        h1, h2 = _window_hashes(chunk, at, window)
        told = _told(side, _SMALLER)
        n = [len(d) // 20 for _, d in told]
        k1 = np.concatenate([h1, *(_unpack(d[:8 * m], 8) for m, (_, d) in zip(n, told))])
        k2 = np.concatenate([h2, *(_unpack(d[8 * m:12 * m], 4) for m, (_, d) in zip(n, told))])
        own = chunk.ids[chunk.doc[at]]
        ids = np.concatenate([own, *(_unpack(d[12 * m:], 8).view(np.int64) for m, (_, d) in zip(n, told))])
        order, starts = _by_hash(k1, k2)
        least = np.empty(len(ids), np.int64)
        if len(ids):
            least[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.r_[starts, len(ids)]))
        repeated = at[least[:len(at)] < own]
        steps = np.zeros(len(chunk.hashes) + 1, np.int64)
        np.add.at(steps, repeated, 1)
        np.add.at(steps, repeated + window, -1)
        covered = np.cumsum(steps)[:-1] > 0
        removed, kept, spans = [], [], []
        sizes = docs.column("_words").to_pylist()
        for d, (first, size) in enumerate(zip(chunk.starts.tolist(), chunk.sizes.tolist())):
            gone = covered[first:first + size]
            if copies[d]:
                removed.append(sizes[d])
                kept.append(b"")
                spans.append([{"start": 0, "len": sizes[d]}])
            elif gone.any():
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(texts[d].split(), gone.tolist()) if not g]))
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans.append([{"start": int(a), "len": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
            else:
                removed.append(0)
                kept.append(b" ".join(texts[d].split()))
                spans.append([])
        return pa.Table.from_arrays(
            [docs.column(c).combine_chunks() for c in columns]
            + [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
               pa.array(spans, schema.field("removed_spans").type)], schema=schema)
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_removed``, ``kept_text`` (kept words
    joined by one space) and ``removed_spans`` (maximal repeats as word positions)."""
    added = ("n_words", "n_removed", "kept_text", "removed_spans")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    names = docs.columns
    docs, (id_col, text_col) = neutral(docs, id_col, text_col)
    chunks = _write_chunks(docs, id_col, text_col)
    facts = chunks.where((F.col("_words") >= window) & F.col("_id").isNotNull()).select("_chunk", "_row", "_id", "_seq", "_words")
    first = facts.groupBy("_seq").agg(F.min("_id").alias("first"))
    copies = materialize(facts.join(first, "_seq").where("_id > first").select(
        "_chunk", F.lit(_COPY).alias("kind"), F.col("_row").alias("at"), F.lit(None).cast("binary").alias("data")), "substring-copies")
    words = chunks.agg(F.sum("_words").alias("n")).first()["n"] or 0
    ranges = max(1, -(-words // RANGE_WORDS))

    texts = chunks.select("_chunk", "_row", "_id", "_words", text_col)

    def passed(side: DataFrame, fn, schema: str, rows: DataFrame = texts) -> DataFrame:
        return rows.groupBy("_chunk").cogroup(side.groupBy("_chunk")).applyInArrow(fn, schema)

    probes = passed(copies, _send_probes(text_col, window, ranges), "p int, _chunk long, data binary")
    anchors = written(probes.groupBy("p").applyInArrow(_find_anchors, _SIDE), "substring-anchors")
    told = copies.unionByName(anchors)
    sent = passed(told, _send_windows(text_col, window, ranges), "p int, _chunk long, h1 binary, h2 binary, least binary")
    smaller = written(sent.groupBy("p").applyInArrow(_find_smaller, _SIDE), "substring-windows")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = f"{fields}, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:long,len:long>>"
    return passed(told.unionByName(smaller), _cut_for(docs, text_col, window, ranges), out, chunks).toDF(*names, *added)


def _cut_for(docs: DataFrame, text_col: str, window: int, ranges: int):
    from pyspark.sql.pandas.types import to_arrow_schema

    span = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())]))
    extra = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_spans", span)]
    schema = pa.schema(list(to_arrow_schema(docs.schema)) + [pa.field(*e) for e in extra])
    return _cut(text_col, window, ranges, schema, docs.columns)
