"""Concatenate and cut: documents' token ids packed into windows of fixed length.

Pass one tokenizes every document once and writes its ids (plus the end mark)
with the number of ids before it in its partition.  The per-partition totals
(one row per task) give every partition's offset in the global stream.  Pass
two cuts the stream every ``length`` ids; each piece is a boundary record that
tells its window, its place there and whether the document goes on before or
after it.  Only the very last window is not full.

The tokenizer (lower case; white space dropped) works inside white space and
parts letters and digits from signs.  So texts are cut at both, the distinct
words of a slice of texts are numbered, new ones are tokenized many at a time,
and the ids of the slice are gathered by number.  A worker keeps a bounded
number of words.  Only tokenizers of that kind fit; ``check`` tells.

Null and empty texts have only the end mark.  Repeated rows are packed again;
an empty table gives no pieces; texts of any length are cut as often as
needed; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, partition_starts, slices, text_bytes, written

LENGTH = 4096
END_ID = 2
CACHE_WORDS = 1 << 20  # words whose ids a worker keeps; beyond them the older half goes

_MARK = b"\x01"  # stands between words that are tokenized together
_TOGETHER, _AT_ONCE = 128, 64  # words in one string, strings in one call
_END = b""  # no word is empty: stands for the end id

_SPACE, _SIGN, _WORD = 1, 2, 3  # kinds of bytes; 0: control characters, parts of other characters
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = _WORD
_KIND[list(b" \t\n\v\f\r")] = _SPACE
_LATIN = np.zeros(256, bool)  # behind the byte C3: the letters U+00C0 to U+00FF, all but the signs U+00D7 and U+00F7
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts, one text after the other, and how many stand before the end of each text.

    A-Z go to lower case.  A word ends at white space, between a letter or
    digit and a sign behind it, and between a sign (but no apostrophe, which
    may begin a contraction) and a letter or digit behind it; only ASCII and
    Latin-1 letters count, since no mark behind a sign changes those.  Texts
    that may hold a special token stay as they are and are cut at white space alone.
    """
    special = [b"<|" in t for t in texts]
    data = np.frombuffer(b" ".join([b"", *(t if odd else t.lower() for t, odd in zip(texts, special)), b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)  # the byte behind a text's last one
    kind = _KIND[data]
    space, sign, opens = kind == _SPACE, kind == _SIGN, kind == _WORD
    closes, latin = opens.copy(), (data[:-1] == 0xC3) & _LATIN[data[1:]]
    opens[:-1] |= latin
    closes[1:] |= latin
    cut = (closes[:-1] & sign[1:]) | (sign[:-1] & (data[:-1] != ord("'")) & opens[1:])
    for k in np.flatnonzero(special):
        cut[ends[k] - len(texts[k]) - 1:ends[k]] = False
    begins = ~space
    begins[1:] &= space[:-1] | cut
    held = data[~space]
    starts = np.append(np.flatnonzero(begins[~space]), len(held))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(held)])
    return words, np.searchsorted(np.flatnonzero(begins), ends)


class _Numbers(dict):
    """word -> its number, given when it is first met; ``new`` lists those without ids yet."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids by word: the numbered words' ids stand one after the other in ``flat``."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        # a word's ids do not depend on its neighbours, so words go through in
        # strings of many, cut again at the id of a mark that is a word of its own
        mark = self.encode(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.check()
        self.numbers = _Numbers()
        self.numbers[_END] = 0
        self.flat, self.starts = np.array([end_id], self.dtype), np.array([0, 1])  # a word's ids end where the next one's begin

    def encode(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def check(self) -> None:
        """Raise when the tokenizer does not work word by word and in lower case."""
        for text in (b"Ab cd", "(Abc), \u00c9t\u00e9. x--12;".encode(), b"a\n\tB %%c", "it's 'tis \"x'll\" a.b,##\u00fc 3%$4'd".encode()):
            if self.encode(text) != [i for w in _words([text])[0].to_pylist() for i in self.encode(w)]:
                raise ValueError("this tokenizer keeps case, or does not split at white space and between letters and signs")

    def tokenize(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        ids, counts = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        between, joined = b" " + _MARK + b" ", [words[i:i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        for i in range(0, len(joined), _AT_ONCE):
            texts = [between.join([*ws, b""]).decode("utf-8", "replace") for ws in joined[i:i + _AT_ONCE]]  # a mark after each
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                found = np.array(e.ids, self.dtype)
                marks = found == self.mark
                ids.append(found[~marks])
                counts.append(np.diff(np.flatnonzero(marks), prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, words: list[bytes]) -> None:
        """Add the ids of new words, which have the numbers that follow."""
        alone = set()  # special tokens, the mark
        if self.mark is None or any(x in b" ".join(words) for x in (b"<|", _MARK)):
            alone = {k for k, w in enumerate(words) if self.mark is None or b"<|" in w or _MARK in w}
        ids, counts = self.tokenize([w for k, w in enumerate(words) if k not in alone] if alone else words)
        if alone:
            rest, sizes, at = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []), [], []
            for k, w in enumerate(words):
                at.append(np.array(self.encode(w), self.dtype) if k in alone else next(rest))
                sizes.append(len(at[-1]))
            ids, counts = np.concatenate(at), np.array(sizes, np.int64)
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def evict(self) -> None:
        """Forget the older half of the words."""
        kept = [_END, *list(self.numbers)[len(self.numbers) // 2:]]
        old = np.array([self.numbers[w] for w in kept])
        self.numbers = _Numbers()
        for w in kept:
            self.numbers.setdefault(w, len(self.numbers))
        self.flat, self.starts = self.gather(old)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, and where each word's begin, the end as last."""
        counts = (self.starts[1:] - self.starts[:-1])[numbers]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[np.repeat(self.starts[numbers] - ends[:-1], counts) + np.arange(ends[-1])], ends

    def of_all(self, texts: list[bytes], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other (each with the end id behind it, if asked for), and
        where each text's begin, the end as last."""
        if len(self.numbers) > CACHE_WORDS:
            self.evict()
        words, ends = _words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        if end:
            numbers, ends = np.insert(numbers, ends, self.numbers[_END]), ends + np.arange(1, len(ends) + 1)
        self.learn(self.numbers.new)
        self.numbers.new.clear()
        ids, starts = self.gather(numbers)
        return ids, starts[np.concatenate([[0], ends])]


@lru_cache(1)
def _word_ids(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pid, before = _word_ids(path, end_id), TaskContext.get().partitionId(), 0
        width = words.dtype.itemsize
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = words.of_all(text_bytes(part.column("text")), end=True)
                size = part.num_rows
                tokens = pa.Array.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(starts * width), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.full(size, pid, np.int32)), pa.array(before + starts[:-1]),
                     pa.array(np.diff(starts)), tokens.cast(pa.binary()), pa.array(np.full(size, width, np.int32))],
                    names=["id", "pid", "at", "n", "tokens", "width"])
                before += int(starts[-1])
    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, at, n, tokens, width in zip(*(batch.column(c).to_pylist() for c in ("id", "at", "n", "tokens", "width"))):
                ids = np.frombuffer(tokens, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    window, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    rows.append((i, start, size, n, window, offset, start > 0, start + size < n,
                                 ids[start:start + size].tobytes()))
                    start += size
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, r)) for r in rows], schema=_PIECE)
    return run


_PIECE = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("from_previous", pa.bool_()),
                    ("to_next", pa.bool_()), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset,
    from_previous, to_next, ids), ``ids`` as little-endian 32-bit bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tokens = written(arrow_map(rows, _tokenize(tokenizer_path, end_id),
                               "id long, pid int, at long, n long, tokens binary, width int"), "pack-tokens")
    starts = partition_starts(tokens.groupBy("pid").agg(F.sum("n").alias("ids")), "pid", "ids")
    placed = tokens.join(F.broadcast(starts), "pid").select(  # one row per task: bounded by the partition count
        "id", (F.col("at") + F.col("ids_before")).alias("at"), "n", "tokens", "width")
    return arrow_map(placed, _cut(length), "id long, start long, length long, doc_tokens long, sequence_id long, "
                     "offset long, from_previous boolean, to_next boolean, ids binary")
