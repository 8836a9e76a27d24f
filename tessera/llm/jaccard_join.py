"""N-gram Jaccard self-join by rare-first prefix filtering, and its components.

A document's set holds the hashes of its distinct word n-grams.  Under one
global order of all n-grams, two sets of Jaccard ``percent`` or more share the
first of their common n-grams inside both *prefixes* (the first
``n - ceil(percent * n / 100) + 1`` of a set of n).  The order is rare first:
by the document frequency's power of two, then by hash.  Prefixes of rare
n-grams meet few others, and an n-gram of one document meets none.

1. Documents are cut into blocks, a packed row each: a word list and the word
   codes of the block's distinct sets, which are smaller than n-gram hashes.
   Equal sets of a block are kept once.
2. Blocks send their distinct n-grams, with counts, to ranges of hash space;
   ranges answer with frequency classes.  A common n-gram is one entry a block,
   however many documents hold it.
3. Blocks order their sets and emit prefix entries: n-gram, set, size, position
   and how the rest of the set is spread over eight parts of hash space.
4. Sets that share a prefix n-gram meet if sizes (length filter), what is left
   after the match (positional filter) and the spread of what is left (suffix
   filter, a lower bound of the Hamming distance of the suffixes) allow it.
   First every set meets only its n-gram's *hub*, the set that holds it
   earliest; then sets outside the hub's component meet all others of the
   n-gram that are not yet in their component.  So a group of copies costs a
   star of links, not all pairs, and no link between components is lost.
   Each pair is verified once, by counting the common hashes of whole sets.

Sets are compared by 64-bit hashes of n-grams (two given sets of 10^4 n-grams
hold a false common one with a chance of 10^-11); equal sets are found by 128
bits.  Fewer words than ``size`` make one n-gram of the whole sequence.  Null,
empty and blank texts have no set and are linked with nothing.  Repeated rows
and equal ids are documents of their own; ids are cast to ``long`` and a null
id never becomes a component's id (null where a component has none other).  An
empty table gives no rows, texts of any length are used whole, and other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, arrow_map, rolling, slices, text_bytes, written
from tessera.llm.components import connected_components

SIZE = 3
PERCENT = 90
BLOCK_BYTES = 16 << 20  # text of one block
RANGE_TOKENS = 1 << 22  # n-grams that one range of hash space answers for
PLACE_BITS = 27  # an n-gram's place in its range
PARTS = 8  # parts of hash space for the suffix filter
SIDE = 512  # pairs that read one copy of a set

_SHIFT = np.uint64(61)  # hash -> part


def prefix_length(n, percent: int):
    return n + (percent * n) // -100 + 1


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The set of a text's word hashes: sorted distinct hashes of its word n-grams."""
    return np.unique(rolling(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def _key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


# ---- blocks ----

_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("refs", pa.list_(pa.int32())),
                    ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())),
                    ("words", pa.binary()), ("codes", pa.binary()), ("lengths", pa.binary()), ("n_tokens", pa.int64())])
_BLOCK_DDL = ("block long, ids array<long>, refs array<int>, keys array<binary>, sizes array<long>, least array<long>, "
              "words binary, codes binary, lengths binary, n_tokens long")


class _Block:
    """The documents of one block and their distinct sets, as word codes."""

    def __init__(self):
        self.bytes, self.ids, self.refs, self.known, self.codes = 0, [], [], {}, {}
        self.keys, self.sizes, self.least, self.coded = [], [], [], []

    def add(self, doc_id: int | None, text: bytes, size: int, hashes: WordHashes) -> None:
        self.ids.append(doc_id)
        self.bytes += len(text) + 64
        words = text.lower().split()
        if not words:
            self.refs.append(-1)
            return
        tokens = _shingles(hashes.of(words), size)
        ref = self.known.setdefault(_key(tokens), len(self.keys))
        self.refs.append(ref)
        if ref < len(self.keys):
            if doc_id is not None and (self.least[ref] is None or doc_id < self.least[ref]):
                self.least[ref] = doc_id
            return
        self.keys.append(_key(tokens))
        self.sizes.append(len(tokens))
        self.least.append(doc_id)
        codes = self.codes
        self.coded.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), "<u4", len(words)))

    def row(self, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "block": number, "ids": self.ids, "refs": self.refs, "keys": self.keys, "sizes": self.sizes, "least": self.least,
            "words": b" ".join(self.codes), "codes": np.concatenate([np.empty(0, "<u4"), *self.coded]).tobytes(),
            "lengths": np.array([len(c) for c in self.coded], "<u4").tobytes(), "n_tokens": sum(self.sizes)}], schema=_BLOCK)


def _to_blocks(size: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block, number = WordHashes(), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("id").to_pylist(), text_bytes(part.column("text"))):
                    block.add(doc_id, text, size, hashes)
                    if block.bytes >= block_bytes:
                        yield block.row(number)
                        block, number = _Block(), number + 1
        if block.ids:
            yield block.row(number)
    return run


def _block_sets(row: dict, size: int) -> list[np.ndarray]:
    """The sets of a block, from its codes."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, row["words"].split()), np.uint64)
    coded = hashes[np.frombuffer(row["codes"], "<u4")] if len(hashes) else hashes
    ends = np.cumsum(np.frombuffer(row["lengths"], "<u4"), dtype=np.int64)
    return [_shingles(h, size) for h in np.split(coded, ends[:-1])] if len(ends) else []


# ---- document frequencies ----

def _reduced(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of hashes: the range, and an n-gram's place in it."""
    return tokens >> np.uint64(64 - PLACE_BITS - bits)


_ASK = pa.schema([("slot", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("wide", pa.bool_()), ("counts", pa.binary())])


def _ask(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.concatenate([np.empty(0, np.uint64), *_block_sets(row, size)])
                places, counts = np.unique(_reduced(tokens, bits), return_counts=True)
                counts = np.minimum(counts, 255).astype(np.uint8)
                slots = (places >> np.uint64(PLACE_BITS)).astype(np.int64)
                places &= np.uint64((1 << PLACE_BITS) - 1)
                cuts = np.flatnonzero(np.diff(slots)) + 1
                rows = []
                for s, p, c in zip(np.split(slots, cuts), np.split(places, cuts), np.split(counts, cuts)):
                    if len(s):
                        steps = np.diff(p, prepend=np.uint64(0))
                        wide = bool(steps.max() > 0xFFFF)
                        rows.append({"slot": int(s[0]), "block": row["block"], "wide": wide,
                                     "places": steps.astype("<u4" if wide else "<u2").tobytes(), "counts": c.tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=_ASK)
    return run


def _answer(group: pa.Table) -> pa.Table:
    """Frequency classes (power of two; 0: one set) of every block's n-grams in one range."""
    asked = [np.cumsum(np.frombuffer(p.as_buffer(), "<u4" if w else "<u2"), dtype=np.uint32)
             for p, w in zip(group.column("places"), group.column("wide").to_pylist())]
    counts = np.concatenate([np.frombuffer(c.as_buffer(), np.uint8) for c in group.column("counts")])
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    classes = np.log2(np.bincount(at, counts)).astype(np.uint8)[at]
    parts = np.split(classes, np.cumsum([len(a) for a in asked])[:-1])
    return pa.table({"block": group.column("block"), "slot": group.column("slot"),
                     "classes": pa.array([p.tobytes() for p in parts], pa.binary())})


# ---- prefix entries ----

_ENTRY = pa.schema([("token", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("pos", pa.int64()),
                    *[(f"s{i}", pa.int32()) for i in range(PARTS)]])
_ENTRY_DDL = "token long, key binary, n long, pos long, " + ", ".join(f"s{i} int" for i in range(PARTS))


def _entries(size: int, bits: int, percent: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _block_sets(row := blocks.to_pylist()[0], size) if len(blocks) else []
        if not sets:
            return _ENTRY.empty_table()
        by_slot = sorted(zip(answers.column("slot").to_pylist(), answers.column("classes").to_pylist()))
        classes = np.frombuffer(b"".join(c for _, c in by_slot), np.uint8)
        places = np.unique(_reduced(np.concatenate(sets), bits))
        out = []
        for key, tokens in zip(row["keys"], sets):
            rank = classes[np.searchsorted(places, _reduced(tokens, bits))].astype(np.uint64)
            # rare first, then by hash; sets are sorted, so the order of equal upper bits is the same everywhere
            order = np.argsort((rank << np.uint64(58)) | (tokens >> np.uint64(6)), kind="stable")[:prefix_length(len(tokens), percent)]
            rank, prefix = rank[order], tokens[order]
            shared = np.flatnonzero(rank)
            if len(shared):
                part = np.zeros((len(prefix), PARTS), np.int32)
                part[np.arange(len(prefix)), (prefix >> _SHIFT).astype(np.int64)] = 1
                whole = np.bincount((tokens >> _SHIFT).astype(np.int64), minlength=PARTS).astype(np.int32)
                left = (whole - np.cumsum(part, axis=0, dtype=np.int32))[shared]
                out.append((prefix[shared].view(np.int64), key, len(tokens), shared, left))
        if not out:
            return _ENTRY.empty_table()
        times = [len(o[0]) for o in out]
        left = np.concatenate([o[4] for o in out])
        return pa.table([pa.array(np.concatenate([o[0] for o in out])),
                         pa.array([o[1] for o, k in zip(out, times) for _ in range(k)], pa.binary()),
                         pa.array(np.repeat([o[2] for o in out], times)), pa.array(np.concatenate([o[3] for o in out])),
                         *[pa.array(np.ascontiguousarray(left[:, i])) for i in range(PARTS)]], schema=_ENTRY)
    return run


# ---- pairs ----

def _may_reach(percent: int):
    """Length, positional and suffix filter for entries ``a`` and ``b`` of one n-gram.

    ``common >= percent * (n + m) / (100 + percent)`` is the same as Jaccard
    ``percent``.  The bounds hold where the n-gram is the first common one; a
    pair that reaches the limit passes there, whatever its other n-grams say.
    """
    col = lambda s, c: F.col(f"{s}.{c}")
    n, m = col("a", "n"), col("b", "n")
    rest = F.least(n - col("a", "pos"), m - col("b", "pos"))
    apart = sum((F.abs(col("a", f"s{i}") - col("b", f"s{i}")) for i in range(PARTS)), col("a", "pos") + col("b", "pos"))
    need = percent * (n + m)
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= need)
            & ((100 + percent) * (n + m - apart) >= 2 * need))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Every pair once, smaller key first."""
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _with_set(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """The pairs with the set of one side; a set that many pairs need is read in several copies."""
    copies = pairs.groupBy(side).agg(F.ceil(F.count("*") / SIDE).cast("int").alias("copies"))
    dealt = pairs.join(copies, side).withColumn("copy", F.pmod(F.xxhash64("x", "y"), F.col("copies")).cast("int")).drop("copies")
    copied = sets.join(copies.withColumnRenamed(side, "key"), "key").select(
        F.col("key").alias(side), F.col("set").alias(f"{side}_set"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return dealt.join(copied, [side, "copy"]).drop("copy")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("x_set"), batch.column("y_set")):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                common = int((b[at] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["x", "y"]).append_column("linked", pa.array(keep, pa.bool_()))
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [_shingles(hashes.of(t.lower().split()), size) for t in text_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])
    return run


def _links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A forest and more of the links (x, y) between different sets: enough for the components."""
    fields = F.struct("pos", "key", "n", *[f"s{i}" for i in range(PARTS)])
    hubs = written(entries.groupBy("token").agg(F.min(fields).alias("hub"), F.count("*").alias("m")).where("m > 1")
                   .select("token", "hub.*"), "jaccard-hubs")
    verified = lambda pairs: written(arrow_map(
        _with_set(_with_set(pairs, sets, "x"), sets, "y").select("x", "y", "x_set", "y_set"), _verify(percent),
        "x binary, y binary, linked boolean"), "jaccard-verified")
    met = entries.alias("a").join(hubs.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.key") != F.col("b.key")))
    first = verified(_ordered(met.where(_may_reach(percent)).select(F.col("a.key").alias("x"), F.col("b.key").alias("y"))))
    near = connected_components(first.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))

    root = lambda df, key: df.join(
        near.select(F.col("node").alias(key), "root"), key, "left").withColumn("root", F.coalesce("root", key))
    placed = written(root(entries, "key").join(root(hubs, "key").select("token", F.col("root").alias("hub_root")), "token"),
                     "jaccard-placed")
    a, b = placed.where("root <> hub_root").alias("a"), placed.alias("b")
    both_out = F.col("b.root") != F.col("b.hub_root")
    other = (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & (~both_out | (F.col("a.key") < F.col("b.key")))
    late = _ordered(a.join(b, other & _may_reach(percent)).select(F.col("a.key").alias("x"), F.col("b.key").alias("y")))
    second = verified(late.join(first, ["x", "y"], "left_anti"))
    return first.union(second).where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(id, n, component_id): size of a document's set and the smallest id it is linked with, directly or not."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = written(arrow_map(rows, _to_blocks(size, block_bytes), _BLOCK_DDL), "jaccard-blocks")
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = min(64 - PLACE_BITS, int(total // range_tokens).bit_length())

    asked = arrow_map(blocks.select("block", "words", "codes", "lengths"), _ask(size, bits),
                      "slot long, block long, places binary, wide boolean, counts binary")
    answers = asked.groupBy("slot").applyInArrow(_answer, "block long, slot long, classes binary")
    entries = blocks.select("block", "keys", "words", "codes", "lengths").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _entries(size, bits, percent), _ENTRY_DDL)
    entries = written(entries.distinct(), "jaccard-entries")  # sets that several blocks hold

    shared = entries.select("token", "key").join(
        entries.groupBy("token").count().where("count > 1").select("token"), "token", "left_semi").select("key").distinct()
    own = blocks.select("block", F.explode(F.arrays_zip("keys", "sizes", "least", F.sequence(
        F.lit(0), F.greatest(F.size("keys") - 1, F.lit(0))).alias("ref"))).alias("s")).where("s.keys IS NOT NULL").select(
        "block", "s.ref", F.col("s.keys").alias("key"), F.col("s.sizes").alias("n"), F.col("s.least").alias("least"))
    least = own.groupBy("key").agg(F.min("least").alias("least"))
    chosen = least.join(shared, "key", "left_semi").select(F.col("least").alias("id")).distinct()
    texts = rows.alias("r").join(chosen.alias("c"), F.col("r.id").eqNullSafe(F.col("c.id")), "left_semi")
    sets = written(arrow_map(texts.select("text"), _sets(size), "key binary, set binary").join(shared, "key", "left_semi")
                   .dropDuplicates(["key"]), "jaccard-sets")

    grouped = connected_components(_links(entries, sets, percent))
    placed = least.join(grouped.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    classes = own.join(named, "key").select("block", "ref", "n", "component_id")  # one row a block for a group of copies
    members = blocks.select("block", F.explode(F.arrays_zip("ids", "refs")).alias("d")).select(
        "block", F.col("d.refs").alias("ref"), F.col("d.ids").alias("id"))
    return members.join(classes, ["block", "ref"], "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component_id"))
        .alias("component_id"))
