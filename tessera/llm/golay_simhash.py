"""SimHash near-duplicates found with Golay-code fuzzy keys.

A fingerprint has 64 bits: bit b is set when more than half of the text's
shingle hashes (XXH64, seed 42; 4 words, repeats included) have it.  Two
fingerprints are linked when at most ``max_bits`` (4) bits differ, and a
document's group is its connected component.

**Keys.** The fingerprint is cut into three segments (23, 23, 18 bits; the
last is padded with zeros).  Each segment is decoded with the perfect binary
[23,12,7] Golay code to *all* codewords within distance 4: one codeword when
the nearest is at distance 0 to 2, six when it is at distance 3.  Two segments
that differ in at most 2 bits always share one of these codewords.  With at
most 4 differing bits over three segments, the two least differing segments
have at most 2 each, so the pair agrees on both codeword indices of at least
one of the three segment pairs: 3 x (1 to 36) keys of 24 bits per fingerprint
miss nothing.

**Join.** Only distinct fingerprints are keyed, so exact copies, however many,
are one row.  Keys are shuffled and sorted; every run of equal keys is
verified by bit distance.  A run yields a spanning forest of its links, never
all pairs: small runs by shifted comparison, long ones by a breadth-first
search over the not yet reached fingerprints, and very long ones are first cut
by five 13-bit blocks (4 errors leave one block equal).  Forests of all runs
together connect exactly what the links connect.

Words are runs of bytes other than space, tab, LF, VT, FF and CR, with A-Z
lower-cased.  Fewer words than a shingle: the whole sequence is the only
shingle; none (null and empty texts): fingerprint zero, linked like any other.
Rows with a null id get a fingerprint and the smallest known id of their
group.  Repeated rows share a group; empty tables give no rows; other columns
are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialize, neutral, prepare, text_bytes
from tessera.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # (first bit, bits)
GENERATOR = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1, the Golay code's polynomial
SMALL_RUN = 8
LONG_RUN = 16_384
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = ends - [len(w) + 1 for w in words]
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[:len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit integer."""
    def run(col: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in text_bytes(col)], np.uint64).view(np.int64))
    return F.arrow_udf(run, "bigint").asNondeterministic()(text)


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word; error patterns (-1: none) by syndrome."""
    low = np.array([_syndrome(x) for x in range(1 << 12)], np.int32)
    high = np.array([_syndrome(x << 12) for x in range(1 << 11)], np.int32)
    errors = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            errors[low[e & 0xFFF] ^ high[e >> 12]].append(e)
    table = np.full((1 << 11, 6), -1, np.int32)
    for s, found in enumerate(errors):
        table[s, :len(found)] = found
    return low, high, table


def codewords(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4 of 23-bit words, -1 where there are fewer."""
    low, high, table = _tables()
    e = table[low[segment & 0xFFF] ^ high[segment >> 12]]
    return np.where(e >= 0, (segment[:, None] ^ np.maximum(e, 0)) >> 11, -1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row numbers) of unsigned fingerprints: every key that an accepted partner may share."""
    segs = [codewords(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    keys, rows = [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = segs[i][:, :, None], segs[j][:, None, :]
        ok = (a >= 0) & (b >= 0)
        key = (pair << 24) | (np.where(ok, a, 0) << 12) | np.where(ok, b, 0)
        r, _, _ = np.nonzero(ok)
        keys.append(key[ok])
        rows.append(r)
    return np.concatenate(keys).astype(np.int64), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 2048):
            part = fps[at:at + 2048]
            keys, rows = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among distinct fingerprints."""
    if len(fps) > LONG_RUN:
        out = []
        for at, n in BLOCKS:
            block = (fps >> np.uint64(at)) & np.uint64((1 << n) - 1)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for part in np.split(fps[order], cuts):
                out += _search(part, max_bits)
        return out
    return _search(fps, max_bits)


def _search(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            u = frontier.pop()
            near = np.bitwise_count(rest ^ u) <= max_bits
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), u, np.uint64), found))
                frontier.extend(found)
                rest = rest[~near]
    return out


def _run_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of complete runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    out = []
    small = np.repeat(sizes <= SMALL_RUN, sizes)
    for d in range(1, SMALL_RUN):
        same = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not len(same):
            break
        near = same[np.bitwise_count(fps[same] ^ fps[same + d]) <= max_bits]
        out.append((fps[near], fps[near + d]))
    for k in np.flatnonzero(sizes > SMALL_RUN):
        out += _forest(fps[starts[k]:starts[k] + sizes[k]], max_bits)
    return out


def _verify(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # an unfinished run of one key

        def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = _run_links(keys, fps, max_bits) if len(keys) > 1 else []
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if held and keys[-1] == held[0][0][0]:
                held.append((keys, fps))
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            done = [*held, (keys[:cut], fps[:cut])]
            held = [(keys[cut:], fps[cut:])]
            yield from links(*(np.concatenate(x) for x in zip(*done)))
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held)))
    return run


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect what all links within ``max_bits`` connect, of distinct ``fp``."""
    if not 0 <= max_bits <= 4:
        raise ValueError("three Golay segments cover at most 4 differing bits")
    keyed = arrow_map(fingerprints.select("fp"), _emit_keys, "key long, fp long")
    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartition(n, "key").sortWithinPartitions("key")
    return arrow_map(ordered, _verify(max_bits), "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, **extra: Column) -> DataFrame:
    """(id, fp, component_id) and further columns of every row."""
    prepare(docs.sparkSession)
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp"),
                                   *[c.alias(n) for n, c in extra.items()]), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id", *extra)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) of every row; ``component_id`` is the smallest id of the group."""
    return _grouped(docs, id_col, text_col, shingle, max_bits)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: that of the smallest id, with the input's columns.

    Rows that repeat an id and a text are one document.  Rows that repeat an id
    with different texts are judged one by one, and all of them stay whose group
    has no smaller id.  Rows with a null id cannot be told apart by id and all stay.
    """
    names = docs.columns
    docs, (id_col, text_col) = neutral(docs, id_col, text_col)
    docs = docs.withColumn("text_hash", F.xxhash64(text_col))
    found = _grouped(docs, id_col, text_col, shingle, max_bits, text_hash=F.col("text_hash"))
    kept = found.where("id = component_id").select(F.col("id").alias(id_col), "text_hash").distinct()
    named = docs.join(kept, [id_col, "text_hash"], "left_semi").dropDuplicates([id_col, "text_hash"])
    return named.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull())).drop("text_hash").toDF(*names)
