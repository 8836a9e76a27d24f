"""Benchmark decontamination: BM25 with block-max pruning, then overlap checks.

The benchmark's items are the indexed documents; every training passage is a
query.  A passage is a window of ``2 * step`` words at every multiple of
``step``, with ``step`` at least the item's length, so any item-long span lies
inside one passage and whole texts are covered.  ``step`` is the item's length
class (``STEP`` doubled as often as needed), so it depends on no other item.

Scores are BM25 with the item's score against itself scaled to 1, so one
threshold holds for all items.  Items are kept in blocks, and every (term,
block) posting has its largest impact.  As in block-max WAND, terms are split
at a pivot: the most common terms, which together can add at most half the
threshold to any item, are never traversed on their own.  Of the others, a
passage's longest lists that cannot reach the threshold together are not walked
either, only looked up in the (passage, block) pairs that its other terms
open; a pair is scored in full only when its bound reaches the threshold.
Passages go through in groups of a bounded number of postings.  Nothing above
the threshold is missed.

Every passage that reaches the threshold is verified: the share of the question's
5-word shingles and of the answer's words that it holds; the best of those that
pass is reported.  An item's answer is its
last sentence, its question what stands before (a single sentence is both).

Words are cut at Unicode white space (no-break and thin spaces too) in items and
documents, and compared with case folded and without punctuation at either end.
Null and empty texts have no passage; items without words are skipped;
repeated items and documents are reported each; empty tables give no rows.
An index is built from at most ``PART_BYTES`` of item texts at a time; a larger
benchmark is cut by item hash into parts that all documents are run against.
Item count, mean length and document frequencies are those of the whole
benchmark in every part, so the parts change no score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_WORDS, arrow_map, materialize, neutral, slices, text_bytes

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION, ANSWER = 0.6, 0.6
SHINGLE = 5
BLOCK = 4
STEP = 64
BROADCAST_HASHES = 1 << 21  # 16 MB of text hashes; more are joined by a shuffle
PART_BYTES = 8 << 20
POSTINGS = 1 << 21  # postings that are looked at together


_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"
_ASCII_EDGE = _EDGE.encode("ascii", "ignore")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# Unicode white space that bytes.split() does not know: U+001C-1F in ASCII; U+0085 A0 1680 2000-200A 2028 2029 202F 205F 3000
_ASCII_SPACE = bytes(32 if 0x1C <= c <= 0x1F else c for c in range(256))
_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def words(text: bytes) -> list[bytes]:
    """Words of items and documents alike: runs without Unicode white space."""
    return (text.translate(_ASCII_SPACE) if text.isascii() else _SPACE.sub(b" ", text)).split()


def fold(word: str) -> str:
    """Case folded, without punctuation at either end."""
    return word.strip(_EDGE).casefold()


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Folded words of question and answer."""
    parts = [p for p in (
        [x for x in (fold(w.decode()) for w in words(s.encode())) if x] for s in _SENTENCE.split(text.strip())) if p]
    if not parts:
        return [], []
    return ([w for p in parts[:-1] for w in p] or parts[-1]), parts[-1]


def _whole(question: list, answer: list) -> list:
    return question if question == answer else question + answer


class Stats(NamedTuple):
    """What BM25 needs of the whole benchmark: items with words, their words, and in how many of them a term is."""

    items: int
    words: int
    df: dict[str, int]

    @classmethod
    def of(cls, wholes: list[list[str]]) -> Stats:
        return cls(len(wholes), sum(map(len, wholes)), Counter(t for w in wholes for t in set(w)))


class Index:
    """Block-max inverted index of some items of the benchmark.

    ``stats`` are those of the whole benchmark (default: of ``items``);
    indexes of one ``terms`` number their terms alike.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, block: int = BLOCK,
                 stats: Stats | None = None, terms: dict[str, int] | None = None):
        self.threshold = threshold
        split = [(i, *split_item(t or "")) for i, t in items]
        split = sorted((x for x in split if x[1]), key=lambda x: (len(x[1]) + len(x[2]), x[0]))
        stats = stats or Stats.of([_whole(q, a) for _, q, a in split])
        self.ids = [x[0] for x in split]
        self.terms: dict[str, int] = {} if terms is None else terms
        num = lambda words: [self.terms.setdefault(w, len(self.terms)) for w in words]
        self.questions, self.answers = [num(x[1]) for x in split], [num(x[2]) for x in split]
        whole = [_whole(q, a) for q, a in zip(self.questions, self.answers)]
        df = {self.terms[t]: stats.df[t] for _, q, a in split for t in q + a}
        mean = stats.words / max(1, stats.items)
        self.block = block
        self.impacts: list[dict[int, float]] = []  # per item: term -> share of the item's own score
        for w in whole:
            norm = K1 * (1 - B + B * len(w) / mean)
            raw = {t: math.log(1 + (stats.items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm)
                   for t, f in Counter(w).items()}
            own = sum(raw.values())
            self.impacts.append({t: v / own for t, v in raw.items()})
        # pivot: the commonest terms, as long as they add at most half the threshold to any item
        light: set[int] = set()
        common = np.zeros(len(whole))
        holders = defaultdict(list)
        for k, imp in enumerate(self.impacts):
            for t in imp:
                holders[t].append(k)
        for t, _ in sorted(df.items(), key=lambda x: (-x[1], x[0])):
            more = common.copy()
            for k in holders[t]:
                more[k] += self.impacts[k][t]
            if more.max(initial=0) > threshold / 2:
                break
            common = more
            light.add(t)
        self.n_blocks = -(-len(whole) // block)
        self.floor = np.array([common[b * block:(b + 1) * block].max(initial=0) for b in range(self.n_blocks)])
        best: dict[tuple[int, int], float] = {}  # (term, block) -> largest impact, of traversed terms
        for k, imp in enumerate(self.impacts):
            for t, v in imp.items():
                if t not in light:
                    best[t, k // block] = max(best.get((t, k // block), 0.0), v)
        posts = sorted(best.items())
        self.post_block = np.array([b for (_, b), _ in posts], np.int64)
        self.post_impact = np.array([v for _, v in posts])
        counts = np.bincount([t for (t, _), _ in posts], minlength=len(self.terms)) if posts else np.zeros(len(self.terms), int)
        self.post_start = np.r_[0, np.cumsum(counts)].astype(np.int64)
        self.post_key = np.array([t * self.n_blocks + b for (t, b), _ in posts], np.int64)
        self.most = np.zeros(len(self.terms))  # largest impact of a term in any block
        np.maximum.at(self.most, self.post_key // max(1, self.n_blocks), self.post_impact)
        self.shingles = [_shingles(q) for q in self.questions]


def by_length(items: list[tuple[int, str]], threshold: float = THRESHOLD, stats: Stats | None = None) -> list[tuple[int, Index]]:
    """(step, index) per length class of the items."""
    classes: dict[int, list[tuple[int, str]]] = defaultdict(list)
    wholes, terms = [], {}
    for i, t in items:
        w = _whole(*split_item(t or ""))
        if w:
            step = STEP
            while step < len(w):
                step *= 2
            classes[step].append((i, t))
            wholes.append(w)
            for x in w:
                terms.setdefault(x, len(terms))
    stats = stats or Stats.of(wholes)
    return [(step, Index(classes[step], threshold, BLOCK, stats, terms)) for step in sorted(classes)]


def _shingles(terms: list[int]) -> set[tuple[int, ...]]:
    n = min(SHINGLE, len(terms))
    return {tuple(terms[i:i + n]) for i in range(len(terms) - n + 1)}


class _TermNumbers(dict):
    """raw word bytes -> number of its folded form in the index; -1: in no item, -2: bare punctuation."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        # in ASCII, lower case is all there is to folding
        folded = word.lower().strip(_ASCII_EDGE).decode() if word.isascii() else fold(word.decode("utf-8", "replace"))
        n = self[word] = self.terms.get(folded, -1) if folded else -2
        return n


def _numbered(texts: list[bytes], numbers: _TermNumbers) -> list[np.ndarray]:
    docs = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in map(words, texts)]
    return [d[d != -2] for d in docs]


def _hits(texts: list[bytes], index: Index, numbers: _TermNumbers, step: int) -> Iterator[tuple]:
    """(row, item position, score, question share, answer share, first word) of verified hits, best verified passage each."""
    return _matches(_numbered(texts, numbers), index, step)


def _matches(docs: list[np.ndarray], index: Index, step: int) -> Iterator[tuple]:
    sizes = np.array([len(d) for d in docs])
    n_windows = np.maximum(1, -(-sizes // step))
    base = np.r_[0, np.cumsum(n_windows)]
    flat = np.concatenate(docs) if docs else np.empty(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(flat >= 0)
    terms = flat[at]
    held = index.post_start[terms + 1] - index.post_start[terms]
    at, terms, held = at[held > 0], terms[held > 0], held[held > 0]
    if not len(at):
        return
    doc = np.searchsorted(starts, at, side="right") - 1
    inner = (at - starts[doc]) // step
    # a word lies in the window that starts in its step and in the one before
    w = np.r_[base[doc] + inner, (base[doc] + inner - 1)[inner > 0]]
    t = np.r_[terms, terms[inner > 0]]
    pairs = np.unique(w * len(index.terms) + t)  # a term counts once per window
    w, t = np.divmod(pairs, len(index.terms))
    best: dict[tuple[int, int], tuple] = {}
    for c in _cells(w, t, index):
        window, block = divmod(int(c), index.n_blocks)
        d = int(np.searchsorted(base, window, side="right")) - 1
        first = (window - int(base[d])) * step
        passage = docs[d][first:first + 2 * step].tolist()
        held_terms = set(passage)
        grams: dict[int, set] = {}
        for k in range(block * index.block, min((block + 1) * index.block, len(index.ids))):
            score = sum(v for term, v in index.impacts[k].items() if term in held_terms)
            if score < index.threshold:
                continue
            size = min(SHINGLE, len(index.questions[k]))
            if size not in grams:
                grams[size] = set(zip(*(passage[i:] for i in range(size))))
            q = len(index.shingles[k] & grams[size]) / len(index.shingles[k])
            a = sum(x in held_terms for x in index.answers[k]) / len(index.answers[k])
            if q < QUESTION or a < ANSWER:
                continue
            old = best.get((d, k))
            if old is None or (q, a, score) > old[:3]:
                best[d, k] = (q, a, score, first)
    for (d, k), (q, a, score, first) in sorted(best.items()):
        yield d, k, score, q, a, first


def _cells(w: np.ndarray, t: np.ndarray, index: Index) -> Iterator[int]:
    """Cells (window * blocks + block) whose bound reaches the threshold, of windows ``w`` with terms ``t``.

    In each window the terms of the longest lists, as long as they cannot reach
    the threshold together, open no cell: their lists are not walked, they are
    looked up in the cells that the other terms have opened and that may still
    reach the threshold.  Windows go through in groups of ``POSTINGS`` postings,
    at least one window at a time, so memory does not grow with the benchmark's lists.
    """
    reach = index.threshold - 1e-9
    n = index.post_start[t + 1] - index.post_start[t]
    order = np.lexsort((t, -n, w))
    w, t, n = w[order], t[order], n[order]
    starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])  # of the windows
    ends = np.r_[starts[1:], len(w)]
    run = np.cumsum(index.most[t])
    run -= np.repeat((run - index.most[t])[starts], ends - starts)
    opens = run + index.floor.max() >= reach  # from the first such term on, lists are walked
    splits = ends - np.add.reduceat(opens, starts)
    rest = np.where(splits > starts, run[splits - 1], 0.0)  # what the looked-up terms add at most
    walked = np.add.reduceat(np.where(opens, n, 0), starts)
    group = (np.cumsum(walked) - walked) // POSTINGS
    cuts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(starts)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        mine = slice(starts[lo], ends[hi - 1])
        go = opens[mine]
        gw, gt, gn = w[mine][go], t[mine][go], n[mine][go]
        post = np.repeat(index.post_start[gt] - (np.cumsum(gn) - gn), gn) + np.arange(gn.sum())
        cell, back = np.unique(np.repeat(gw, gn) * index.n_blocks + index.post_block[post], return_inverse=True)
        bound = np.bincount(back, index.post_impact[post], len(cell)) + index.floor[cell % index.n_blocks]
        at = lo + np.searchsorted(w[starts[lo:hi]], cell // index.n_blocks)
        alive = bound + rest[at] >= reach
        cell, bound, at = cell[alive], bound[alive], at[alive]
        for k in range(0, len(cell), POSTINGS >> 8):
            some = slice(k, k + (POSTINGS >> 8))
            yield from cell[some][_looked_up(cell[some], bound[some], starts[at[some]], splits[at[some]], t, index) >= reach].tolist()


def _looked_up(cell: np.ndarray, bound: np.ndarray, first: np.ndarray, last: np.ndarray, t: np.ndarray, index: Index) -> np.ndarray:
    """The cells' bounds with the impacts of the terms t[first:last] in them."""
    n = last - first
    term = t[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    of = np.repeat(np.arange(len(cell)), n)
    key = term * index.n_blocks + cell[of] % index.n_blocks
    place = np.minimum(np.searchsorted(index.post_key, key), len(index.post_key) - 1)
    return bound + np.bincount(of, np.where(index.post_key[place] == key, index.post_impact[place], 0.0), len(cell))


_HIT = "id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _search(indexes: list[tuple[int, Index]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _TermNumbers(indexes[0][1].terms if indexes else {})
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id").to_pylist()
                docs = _numbered(text_bytes(part.column("text")), numbers) if indexes else []
                rows = [(ids[d], index.ids[k], s, q, a, f) for step, index in indexes
                        for d, k, s, q, a, f in _matches(docs, index, step)]
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=[x.split()[0] for x in _HIT.split(", ")])
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term, words) of every distinct term of an item; one row without a term counts the item and its words."""
    for batch in batches:
        rows = []
        for part, text in zip(batch.column("part").to_pylist(), batch.column("t").to_pylist()):
            whole = _whole(*split_item(text))
            if whole:
                rows.append((part, None, len(whole)))
                rows += [(part, t, 0) for t in set(whole)]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()))],
                                         names=["part", "term", "words"])


def _part_stats(items: DataFrame) -> tuple[int, int, DataFrame]:
    """Item count and words of the whole benchmark, and (part, term, df): its document frequencies for the terms of a part."""
    found = materialize(arrow_map(items.select("part", "t"), _item_terms, "part long, term string, words long")
                        .groupBy("part", "term").agg(F.count("*").alias("n"), F.sum("words").alias("words")), "benchmark-terms")
    total = found.where("term IS NULL").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    terms = found.where("term IS NOT NULL")
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    return total["n"] or 0, total["words"] or 0, materialize(terms.select("part", "term").join(df, "term"), "benchmark-df")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap, first_word), one row per verified leak."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // PART_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if parts == 1:
        return arrow_map(rows, _search(by_length([(r["item"], r["t"]) for r in items.collect()], threshold)), _HIT)
    items = items.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(parts)))
    n_items, n_words, df = _part_stats(items)
    out = None
    for p in range(parts):  # item texts of one part: PART_BYTES on average
        part = [(r["item"], r["t"]) for r in items.where(F.col("part") == p).select("item", "t").collect()]
        stats = Stats(n_items, n_words, {r["term"]: r["df"] for r in df.where(F.col("part") == p).select("term", "df").collect()})
        hits = arrow_map(rows, _search(by_length(part, threshold, stats)), _HIT)
        out = hits if out is None else out.unionByName(hits)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with the input's columns.

    A document is found again by a 64-bit hash of its text, so null ids, ids of
    any type and ids that repeat with different texts are judged by their texts.
    The hashes found are written and counted: up to ``BROADCAST_HASHES`` of them
    are broadcast, so that no text is shuffled; more are joined by a shuffle.
    """
    names = docs.columns
    docs, (text_col,) = neutral(docs, text_col)
    docs = docs.withColumn("text_hash", F.xxhash64(text_col))
    found = materialize(leaks(docs, benchmark, "text_hash", text_col).select(F.col("id").alias("text_hash")).distinct(),
                        "leak-hashes")
    if found.count() <= BROADCAST_HASHES:
        found = F.broadcast(found)
    return docs.join(found, "text_hash", "left_anti").drop("text_hash").toDF(*names)
