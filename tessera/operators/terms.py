"""Word lists matched in texts by an automaton over tokens.

The list's terms are sequences of tokens.  Written with a space on either side
they go into an Aho-Corasick automaton, which finds every occurrence of every
term in one pass over a text's tokens, whatever the number and length of the terms.
The list is measured first: up to ``PART_BYTES`` of term text make one broadcast
part; a longer list is dealt by hash into as many parts as that takes, each with
an automaton of its own.  Texts are never shuffled.  A task goes through an Arrow
batch text by text and hands its rows on in pieces of bounded size, so its memory
does not grow with the rows of a batch.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ship_package

TOKEN = re.compile(r"([^\W_]+)")  # letters and digits
PART_BYTES = 64 << 20  # term text of one automaton
PIECE_BYTES = 1 << 20  # text of the rows that a task takes up at once, a longer text by itself


def _pieces(batches: Iterator[pa.RecordBatch], column: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces with up to ``size`` bytes of text in ``column``."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
        first, before = 0, 0
        while first < batch.num_rows:
            until = max(first + 1, int(np.searchsorted(ends, before + (size or PIECE_BYTES), "right")))
            yield batch.slice(first, until - first)
            first, before = until, ends[until - 1]


class Automaton:
    """Terms (tokens joined by single spaces), matched as whole tokens."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.sizes = [t.count(" ") + 1 for t in terms]
        self._found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(terms):
            self._found.add_word(f" {term} ", k)
        self._found.make_automaton()

    def occurrences(self, text: str) -> Iterator[tuple[int, int]]:
        """(where its last token ends, number of the term) of every occurrence in tokens joined by single spaces."""
        return ((end - 1, k) for end, k in self._found.iter(f" {text} ")) if self.terms else iter(())

    def by_token(self, text: str) -> list[tuple[int, int]]:
        """(place of its last token, number of the term) of every occurrence."""
        found, place, at = [], 0, 0
        for end, k in self.occurrences(text):  # ends never go back
            place += text.count(" ", at, end)
            at = end
            found.append((place, k))
        return found


class Part:
    """One broadcast part of a list; a worker builds its automaton once for all its tasks."""

    _built: dict[str, Automaton] = {}  # of this worker, the last two

    def __init__(self, broadcast):
        self.name, self.broadcast = uuid.uuid4().hex, broadcast

    def automaton(self) -> Automaton:
        if self.name not in self._built:
            for old in list(self._built)[:-1]:
                del self._built[old]
            self._built[self.name] = Automaton([row[0] for row in self.broadcast.value])
        return self._built[self.name]


def _parts(terms: DataFrame, part_bytes: int) -> list[Part]:
    """The rows of ``terms`` (term first) in broadcast parts of bounded size."""
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0]
    count = -(-int(size or 0) // part_bytes)
    sc = terms.sparkSession.sparkContext
    dealt = terms.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(count or 1)))
    return [Part(sc.broadcast([tuple(r)[:-1] for r in dealt.where(F.col("_part") == p).collect()])) for p in range(count)]


def count_terms(texts: DataFrame, key: str, tokens: Column, terms: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, term, n): occurrences, overlapping ones too, of each of ``terms(term)`` in each row's
    ``tokens`` (a string of tokens with single spaces between them).

    Null texts and empty lists find nothing; rows are counted apart, also
    where their keys are equal.
    """
    ship_package(texts.sparkSession)
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("term", T.StringType()),
                           T.StructField("n", T.LongType())])

    def run(part: Part):
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches, "_tokens"):
                found = part.automaton()
                rows, hits, counts = [], [], []
                for row, text in enumerate(batch.column(1)):
                    for term, n in Counter(t for _, t in found.occurrences(text.as_py() or "")).items():
                        rows.append(row)
                        hits.append(found.terms[term])
                        counts.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string()),
                                                  pa.array(counts, pa.int64())], names=[key, "term", "n"])
        return counted

    out = None
    for part in _parts(terms.select("term").distinct(), part_bytes):
        one = texts.select(key, tokens.alias("_tokens")).mapInArrow(run(part), schema)
        out = one if out is None else out.unionByName(one)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


def _chosen(found: list[tuple[int, int, int, str]]) -> dict[int, str]:
    """Notes by the last token of their term: from left to right, of those that begin together the longest text."""
    notes, free = {}, 0
    for first, _, last, note in sorted(found):
        if first >= free:
            notes[last] = note
            free = last + 1
    return notes


def _earlier(place: bytes, notes: list[str]) -> list[tuple[int, int, int, str]]:
    return [(*p, note) for p, note in zip(np.frombuffer(place, "<i4").reshape(-1, 3).tolist(), notes)]


def annotate(texts: DataFrame, text: str, terms: DataFrame, mark, part_bytes: int = PART_BYTES) -> DataFrame:
    """``texts`` with ``mark(note)`` behind the occurrences of ``terms(term, note)`` in column ``text``.

    Tokens are runs of letters and digits in lower case, and so are the terms'.  Every part of the list but the
    last adds what it finds to the row; the last one adds its own, chooses among
    all and joins the text.
    """
    ship_package(texts.sparkSession)
    plain = texts.toDF(*[f"c{i}" for i in range(len(texts.columns))])  # no name can clash
    kept = plain.columns
    col = kept[texts.columns.index(text)]
    rows = plain

    def found_in(part: Part, batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[str], list[tuple[int, int, int, str]]]]:
        """Of each row in turn: text, what is between its tokens and the tokens, and (first token, -length
        of the term, last token, note) of its occurrences so far."""
        auto, listed = part.automaton(), part.broadcast.value
        held = "place" in batch.schema.names
        for row, value in enumerate(batch.column(col)):
            now = value.as_py()
            cut = TOKEN.split(now or "")
            own = _earlier(batch.column("place")[row].as_py(), batch.column("notes")[row].as_py()) if held else []
            own += [(last - auto.sizes[k] + 1, -len(auto.terms[k]), last, listed[k][1])
                    for last, k in auto.by_token(" ".join(cut[1::2]).lower())]
            yield now, cut, own

    def search(part: Part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches, col):
                place, notes = [], []
                for _, _, found in found_in(part, batch):
                    place.append(np.array([f[:3] for f in found], "<i4").tobytes())
                    notes.append([f[3] for f in found])
                own = [n for n in batch.schema.names if n not in ("place", "notes")]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in own], pa.array(place, pa.binary()), pa.array(notes, pa.list_(pa.string()))],
                                                 names=[*own, "place", "notes"])
        return run

    def finish(part: Part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches, col):
                now = []
                for text, cut, found in found_in(part, batch):
                    if found:
                        for last, note in _chosen(found).items():
                            cut[2 * last + 1] += mark(note)
                        text = "".join(cut)
                    now.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(now, pa.string()) if n == col else batch.column(n) for n in kept], names=kept)
        return run

    parts = _parts(terms.groupBy("term").agg(F.min("note").alias("note")), part_bytes)
    if not parts:
        return texts
    wide = T.StructType([*rows.schema.fields, T.StructField("place", T.BinaryType()), T.StructField("notes", T.ArrayType(T.StringType()))])
    for part in parts[:-1]:
        rows = rows.mapInArrow(search(part), wide)
    return rows.mapInArrow(finish(parts[-1]), plain.schema).toDF(*texts.columns)
