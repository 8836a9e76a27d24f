"""Fill-in-middle documents by Arrow's column functions, a batch at a time.

A text is cut into units (white space with the word that follows it; white
space at the end is a unit of its own).  Spark's SHA-256 of seed and id gives
each document its form and two cuts among its units.  Inside a batch the texts
become lists of units, the units are flattened beside the number of their
document, their ordinals against the two cuts tell their role (prefix, middle,
suffix), the units of each role are made lists again, and ``binary_join`` puts
the pieces and marks together.  No Python loop runs over rows or units.

Forms: ``plain`` is the text itself; ``psm`` is <P>prefix<S>suffix<M>middle;
``spm`` is <S>suffix<P>prefix<M>middle.  A text that holds a mark is plain, so
``restored`` reads every text back from output and form alone.

Null texts count as empty, and empty texts are plain with no units.  Repeated
rows and equal ids get equal forms and cuts; a null id is hashed as an empty
string.  An empty table gives no rows, texts of any length are cut whole, and
other columns are ignored.  Texts are UTF-8, so the byte FF, which marks cuts
inside a batch, is in none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, slices

P, S, M = "<P>", "<S>", "<M>"
CUT = b"\xff"
_BYTES = pa.large_binary()
_OUT = ("id", "n", "form", "prefix", "middle", "output")


def _draws(seed: int, id_col: Column) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:id`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _remainder(x: pa.Array, m: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, m), m))


def _text(col: pa.Array) -> pa.Array:
    return pc.fill_null(col.cast(pa.large_string()).cast(_BYTES), b"")


def _units(texts: pa.Array) -> pa.Array:
    """A list of units per text: cuts are where white space follows a word."""
    marked = pc.replace_substring_regex(texts, pattern=rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])", replacement=rb"\1" + CUT + rb"\2")
    return pc.split_pattern(marked, pattern=CUT)


def _pieces(texts: pa.Array, draws: list[pa.Array]) -> tuple[pa.Array, list[pa.Array]]:
    """Units per text, and prefix, middle and suffix of every text."""
    units = _units(texts)
    parent = pc.list_parent_indices(units)  # an empty text has one empty unit
    n = pc.if_else(pc.equal(pc.binary_length(texts), 0), 0, pc.list_value_length(units).cast(pa.int64()))
    places = pc.add(n, 1)
    cuts = [_remainder(h, places) for h in draws]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    flat = pc.list_flatten(units)
    sizes = pc.list_value_length(units).cast(pa.int64())
    firsts = pc.subtract(pc.cumulative_sum(sizes), sizes)
    at = pc.subtract(pa.array(np.arange(len(flat))), firsts.take(parent))
    in_prefix, before_suffix = pc.less(at, low.take(parent)), pc.less(at, high.take(parent))
    roles = (in_prefix, pc.and_not(before_suffix, in_prefix), pc.invert(before_suffix))
    lengths = (low, pc.subtract(high, low), pc.subtract(sizes, high))
    pieces = []
    for role, length in zip(roles, lengths):
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(length)])
        lists = pa.LargeListArray.from_arrays(offsets, flat.filter(role))
        pieces.append(pc.binary_join(lists, pa.scalar(b"", _BYTES)))
    return n, pieces


def _transform(rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = {m: pa.scalar(m.encode(), _BYTES) for m in (P, S, M, "")}
        for batch in batches:
            for part in slices(batch, "text"):
                texts = _text(part.column("text"))
                h = [part.column(f"h{i}") for i in (1, 2, 3, 4)]
                n, (prefix, middle, suffix) = _pieces(texts, h[:2])
                plain = pc.equal(n, 0)
                for m in (P, S, M):
                    plain = pc.or_(plain, pc.match_substring(texts, m.encode()))
                of_100 = [_remainder(x, pa.array([100] * len(x), pa.int64())) for x in h[2:]]
                plain = pc.or_(plain, pc.greater_equal(of_100[0], rate))
                form = pc.if_else(plain, "plain", pc.if_else(pc.less(of_100[1], spm_rate), "spm", "psm"))
                psm = pc.binary_join_element_wise(mark[P], prefix, mark[S], suffix, mark[M], middle, mark[""])
                spm = pc.binary_join_element_wise(mark[S], suffix, mark[P], prefix, mark[M], middle, mark[""])
                output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
                none = pa.scalar(None, _BYTES)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), n, form,
                     *[x.cast(pa.large_string()).cast(pa.string())
                       for x in (pc.if_else(plain, none, prefix), pc.if_else(plain, none, middle), output)]], names=list(_OUT))
    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix, middle, output): units, form and text of every document.

    ``rate`` of 100 documents are transformed and ``spm_rate`` of 100 of those
    put the suffix first; ``prefix`` and ``middle`` are null for plain ones.
    """
    draws = _draws(seed, F.col(id_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[d.alias(f"h{i + 1}") for i, d in enumerate(draws)])
    return arrow_map(rows, _transform(rate, spm_rate),
                     f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix string, middle string, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: marks are found in it, not remembered."""
    between = lambda a, b: F.split_part(F.split_part(output, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    last = F.split_part(output, F.lit(M), F.lit(2))
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(between(P, S), last, between(S, M)))
            .otherwise(F.concat(between(P, M), last, between(S, P))))
