"""Phrase collocations: frequent word n-grams by Misra-Gries summaries, counted exactly, scored by their weakest cut.

Texts are lower-cased (A-Z), split at punctuation into pieces and pieces at
spaces and tabs into words; no n-gram crosses a piece.  Everything is counted
per language.

1. Documents become blocks: a packed row of word codes by language, with the
   block's own word list.
2. For n = 1 to ``longest`` a block sends the hashes of its distinct n-grams
   with their counts to ranges of hash space.  A range merges what comes as
   Misra-Gries summaries: counters are added, and when there are more than
   its capacity, the largest counter beyond the capacity is taken off all.  With
   a capacity above the range's mass divided by the threshold, less than the
   threshold is ever taken off a counter, so every n-gram that reaches it
   survives; memory is bounded by the range's mass, which the number of ranges
   keeps alike at every corpus size.  Blocks are told which of theirs survive.
3. Blocks count the survivors exactly, by their words, and send words and counts
   packed to the same ranges, which sum them: a false survivor (error or equal
   hash) falls below the threshold.
4. A phrase inside a longer one of the same count is dropped; the others get the
   lowest of the scores of their cuts, in exact decimal arithmetic.

Null texts count as empty, a null language as ``und``.  Repeated rows count
again.  Equal scores are ordered by count, then by the phrase's UTF-8 bytes.
An empty table, or one without frequent phrases, gives no rows.  Texts of any
length are used whole, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, mix64, slices, text_bytes, written

LONGEST = 5
THRESHOLD = 100
TOP = 2000
BLOCK_BYTES = 16 << 20  # text of one block
RANGE_MASS = 1 << 22  # n-gram occurrences of one range of hash space
PLACE_BITS = 27  # an n-gram's place in its range

_BREAK = b"\xff"  # in no UTF-8 text
_TO_BREAK = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = 40  # slot = level << 40 | range


# ---- blocks ----

class _Codes(dict):
    """word -> its code in a block, from 1; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


_BLOCK_DDL = "block long, langs array<string>, lengths array<long>, n_words array<long>, words binary, codes binary"
_BLOCK = pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())),
                    ("n_words", pa.list_(pa.int64())), ("words", pa.binary()), ("codes", pa.binary())])


def _row(number: int, codes: _Codes, by_lang: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    runs = {lang: np.concatenate(parts) for lang, parts in by_lang.items()}
    return pa.RecordBatch.from_pylist([{
        "block": number, "langs": list(runs), "lengths": [len(r) for r in runs.values()],
        "n_words": [int(np.count_nonzero(r)) for r in runs.values()], "words": b" ".join(list(codes)[1:]),
        "codes": np.concatenate(list(runs.values())).tobytes()}], schema=_BLOCK)


def _to_blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        codes, by_lang, held = _Codes({_BREAK: 0}), {}, 0
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), text_bytes(part.column("text"))):
                    words = (text.lower().translate(_TO_BREAK) + _BREAK).replace(_BREAK, b" " + _BREAK + b" ").split()
                    by_lang.setdefault(lang, []).append(np.fromiter(map(codes.__getitem__, words), "<u4", len(words)))
                    held += len(text) + 64
                    if held >= block_bytes:
                        yield _row(number, codes, by_lang)
                        codes, by_lang, held, number = _Codes({_BREAK: 0}), {}, 0, number + 1
        if by_lang:
            yield _row(number, codes, by_lang)
    return run


class _Grams:
    """The n-grams of a block row: where they start and the keys they are known by."""

    def __init__(self, row: dict, bits: int):
        self.words = [b"", *row["words"].split(b" ")]
        self.codes = np.frombuffer(row["codes"], "<u4")
        self.shift = np.uint64(64 - PLACE_BITS - bits)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.hashes = hashes[self.codes]
        self.lang_at = np.repeat(np.arange(len(row["lengths"])), row["lengths"])
        self.lang_hash = np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in row["langs"]), np.uint64, len(row["langs"]))

    def levels(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, starts, reduced keys) for n = 1 .. longest."""
        rolled, starts = np.zeros(len(self.codes) + 1, np.uint64), np.arange(len(self.codes))
        for n in range(1, longest + 1):
            starts = starts[starts + n <= len(self.codes)]
            starts = starts[self.codes[starts + n - 1] != 0]
            with np.errstate(over="ignore"):
                rolled = rolled[:-1] * _BASE
                rolled += self.hashes[n - 1:]
                keys = mix64(rolled[starts] ^ self.lang_hash[self.lang_at[starts]])
            yield n, starts, keys >> self.shift


# ---- pass one: which n-grams may be frequent ----

_ASK = pa.schema([("slot", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("wide", pa.bool_()), ("counts", pa.binary())])
_ASK_DDL = "slot long, block long, places binary, wide boolean, counts binary"


def _slots(n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every (sorted) key and the cuts between slots."""
    slots = (keys >> np.uint64(PLACE_BITS)).astype(np.int64)
    return slots + (n << _LEVEL), np.flatnonzero(np.diff(slots)) + 1


def _ask(longest: int, threshold: int, bits: int):
    kind = np.min_scalar_type(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for n, _, keys in _Grams(row, bits).levels(longest):
                    if not len(keys):
                        break
                    keys, counts = np.unique(keys, return_counts=True)
                    counts = np.minimum(counts, threshold).astype(kind)  # as many say as much as more
                    slots, cuts = _slots(n, keys)
                    places = keys & np.uint64((1 << PLACE_BITS) - 1)
                    rows = []
                    for s, p, c in zip(np.split(slots, cuts), np.split(places, cuts), np.split(counts, cuts)):
                        steps = np.diff(p, prepend=np.uint64(0))
                        wide = bool(steps.max() > 0xFFFF)
                        rows.append({"slot": int(s[0]), "block": row["block"], "wide": wide,
                                     "places": steps.astype("<u4" if wide else "<u2").tobytes(), "counts": c.tobytes()})
                    yield pa.RecordBatch.from_pylist(rows, schema=_ASK)
    return run


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters; ``taken`` was taken off each."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counters (keys may repeat)."""
        self.keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, counts])).astype(np.int64)
        if len(self.keys) > self.capacity:
            place = len(self.counts) - self.capacity - 1  # of the largest counter beyond the capacity
            least = int(np.partition(self.counts, place)[place])
            keep = self.counts > least
            self.keys, self.counts, self.taken = self.keys[keep], self.counts[keep] - least, self.taken + least

    def reaching(self, threshold: int) -> np.ndarray:
        """Sorted keys of every item that may occur ``threshold`` times, all that do among them."""
        return self.keys[self.counts + self.taken >= threshold]


def _places(steps: pa.BinaryScalar, wide: bool) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps.as_buffer(), "<u4" if wide else "<u2"), dtype=np.uint32)


def _answer(threshold: int):
    kind = np.min_scalar_type(threshold)

    def run(group: pa.Table) -> pa.Table:
        """For every block's n-grams of one range, a bit: may be frequent."""
        counts = [np.frombuffer(c.as_buffer(), kind) for c in group.column("counts")]
        wide = group.column("wide").to_pylist()
        summary = Summary(sum(int(c.sum(dtype=np.int64)) for c in counts) // threshold + 1)
        keys, held = [], 0
        for i, (steps, w) in enumerate(zip(group.column("places"), wide)):
            keys.append(_places(steps, w))
            held += len(keys[-1])
            if held > summary.capacity + (1 << 20) or i == len(wide) - 1:
                summary.merge(np.concatenate(keys), np.concatenate(counts[i + 1 - len(keys):i + 1]))
                keys, held = [], 0
        alive = summary.reaching(threshold)
        bits = []
        for steps, w in zip(group.column("places"), wide):
            places = _places(steps, w)
            at = np.searchsorted(alive, places)
            at[at == len(alive)] = 0
            bits.append(np.packbits(alive[at] == places if len(alive) else np.zeros(len(places), bool)).tobytes())
        return pa.table({"block": group.column("block"), "slot": group.column("slot"), "bits": pa.array(bits, pa.binary())})
    return run


# ---- pass two: exact counts ----

_COUNT = pa.schema([("slot", pa.int64()), ("lang", pa.string()), ("phrases", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_TOTAL = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _count(longest: int, bits: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(blocks):
            return _COUNT.empty_table()
        row = blocks.to_pylist()[0]
        grams = _Grams(row, bits)
        told = dict(zip(answers.column("slot").to_pylist(), answers.column("bits").to_pylist()))
        size = np.uint64(len(grams.words))
        ids = grams.lang_at.astype(np.uint64)  # of the n-gram that starts at a place: equal where language and words are
        known = np.ones(len(grams.codes) + 1, bool)
        out = []
        for n, starts, keys in grams.levels(longest):
            if not len(keys):
                break
            keys, at = np.unique(keys, return_inverse=True)
            slots, cuts = _slots(n, keys)
            alive = np.concatenate([np.unpackbits(np.frombuffer(told[int(s[0])], np.uint8), count=len(s)).astype(bool)
                                    for s in np.split(slots, cuts)])
            may = alive[at]
            if n > 1:  # a frequent n-gram begins and ends with frequent ones
                may &= known[starts] & known[starts + 1]
            starts, at = starts[may], at[may]
            known = np.zeros(len(grams.codes) + 1, bool)
            known[starts] = True
            if not len(starts):
                break
            pair = ids[starts] * size + grams.codes[starts + n - 1]
            _, first, same, counts = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            ids = np.zeros(len(grams.codes), np.uint64)
            ids[starts] = same
            slot, first = slots[at[first]], starts[first]
            lang = grams.lang_at[first]
            order = np.lexsort((lang, slot))
            first, slot, lang, counts = first[order], slot[order], lang[order], counts[order]
            words = [[grams.words[c] for c in grams.codes[first + j].tolist()] for j in range(n)]
            phrases = list(map(b" ".join, zip(*words)))
            cuts = [0, *(np.flatnonzero((np.diff(slot) != 0) | (np.diff(lang) != 0)) + 1).tolist(), len(first)]
            offsets = pa.array(cuts, pa.int32())
            out.append(pa.table([slot[cuts[:-1]], pa.array(row["langs"], pa.string()).take(pa.array(lang[cuts[:-1]])),
                                 pa.ListArray.from_arrays(offsets, pa.array(phrases, pa.binary()).cast(pa.string())),
                                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], schema=_COUNT))
        return pa.concat_tables(out) if out else _COUNT.empty_table()
    return run


def _sum(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        """The totals of one range and language that reach the threshold."""
        flat = pa.table({c: pc.list_flatten(group.column(c).combine_chunks()) for c in ("phrases", "counts")})
        total = flat.group_by("phrases").aggregate([("counts", "sum")])
        total = total.filter(pc.greater_equal(total.column("counts_sum"), threshold))
        size = len(total)
        return pa.table([pa.array([group.column("lang")[0].as_py()] * size, pa.string()),
                         pa.array([group.column("slot")[0].as_py() >> _LEVEL] * size, pa.int32()),
                         total.column("phrases"), total.column("counts_sum")], schema=_TOTAL)
    return run


def frequent(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, lang_col: str = "lang", text_col: str = "text",
             block_bytes: int = BLOCK_BYTES, range_mass: int = RANGE_MASS) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f): every phrase of 1 to ``longest`` words found ``threshold`` times or more; and (lang, n): words in all."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    blocks = written(arrow_map(rows, _to_blocks(block_bytes), _BLOCK_DDL), "phrase-blocks")
    words = blocks.select(F.explode(F.arrays_zip("langs", "n_words")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(
        F.sum("w.n_words").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(64 - PLACE_BITS, int(total // range_mass).bit_length())
    asked = arrow_map(blocks, _ask(longest, threshold, bits), _ASK_DDL)
    answers = asked.groupBy("slot").applyInArrow(_answer(threshold), "block long, slot long, bits binary")
    counts = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _count(longest, bits), "slot long, lang string, phrases array<string>, counts array<long>")
    found = counts.groupBy("slot", "lang").applyInArrow(_sum(threshold), "lang string, k int, phrase string, f long")
    return written(found, "phrase-counts"), words


# ---- phrases ----

def maximal(found: DataFrame) -> DataFrame:
    """Phrases of two words or more that are inside no longer one of the same count.

    It is enough to look one word further: counts only fall with length.
    """
    w = F.split("phrase", " ")
    longer = found.where("k > 2").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(w, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return found.where("k > 1").join(most, ["lang", "phrase"], "left").where("longer IS NULL OR longer < f").drop("longer")


def scored(phrases: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, cut): the cut of lowest score, the first of equal ones."""
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(w, F.lit(1), F.col("cut")), " "),
                             "rest": F.array_join(F.slice(w, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    parts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]) \
        .join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(words, "lang")
    score = F.expr("(1000 * cast(a AS decimal(17, 0)) * cast(n AS decimal(17, 0))) div (cast(l AS decimal(18, 0)) * cast(r AS decimal(18, 0)))")
    best = parts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut")


def collocations(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, top: int = TOP, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): every language's ``top`` phrases."""
    found, words = frequent(docs, longest, threshold, **options)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored(maximal(found), found, words).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
