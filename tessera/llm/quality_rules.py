"""Rule bitmask ledger: every rule is evaluated once; policies only read bits.

``measure`` adds one struct column of measurements, taken in one pass over the
whole text.  ``ledger`` turns them into ``fail_bits`` (bit i set: rule i
failed).  A *policy* is a versioned bit mask: a document is rejected when it
fails any rule of the mask, so changing a policy never reads a text again.
``ablations`` aggregates the ledger by its bits and reports, for a policy,
what every rule rejects, what it alone rejects, and what would be kept
without it.

Words are runs of bytes other than space, tab, LF, VT, FF and CR.  Null and
empty texts have zero words (so they fail ``short``); texts of any length are
read whole; repeated rows are judged alike; an empty table gives no rows.
Input columns are never dropped; a column that has the name of an added one
is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CACHE_WORDS, neutral, prepare, rolling, text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words",
            "n_plain_words")
_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

_SPACES = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def _rules(m: Column) -> list[tuple[str, Column]]:
    """(name, failed) in bit order; bits are never reused, new rules are appended."""
    n = m["n_words"]
    return [
        ("short", n < 50),
        ("repeated_words", 100 * m["n_repeat_words"] > 50 * n),
        ("symbols", 10 * m["n_symbols"] > n),
        ("repeated_lines", (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
        ("word_length", (m["word_chars"] < 2 * n) | (m["word_chars"] > 20 * n)),
        ("shouting", 10 * m["n_upper_words"] > 3 * n),
        ("no_letters", 10 * m["n_plain_words"] < 7 * n),
    ]


RULES = ("short", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting", "no_letters")
POLICIES = {
    "base": ("short", "repeated_words"),
    "v1": ("short", "repeated_words", "symbols", "repeated_lines"),
    "v2": RULES,
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


class _Words(dict):
    """word bytes -> its hash with two flag bits, once per distinct word.

    Bit 0: shouted (two capitals or more and no small letter); bit 1: mostly letters.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        s = word.decode("utf-8", "replace")
        upper = sum(c.isupper() for c in s)
        shouted = upper > 1 and not any(c.islower() for c in s)
        plain = 2 * sum(c.isalpha() for c in s) > len(s)
        got = self[word] = xxhash.xxh64_intdigest(word) & ~3 | plain << 1 | shouted
        return got


def _measure(text: bytes, cache: _Words) -> tuple[int, ...]:
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(hist.sum() - hist[0x80:0xC0].sum())
    words = text.split()
    n = len(words)
    facts = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    tri = rolling(facts, 3)
    repeated = 0
    if len(tri) > 1:
        _, back, counts = np.unique(tri, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:k + len(tri)] |= twice
            repeated = int(covered.sum())
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return (n, points - int(hist[_SPACES].sum()), int(hist[_SYMBOLS].sum()), len(lines), len(lines) - len(set(lines)),
            repeated, int((facts & np.uint64(1)).sum()), int((facts >> np.uint64(1) & np.uint64(1)).sum()))


def measure(text: Column) -> Column:
    """The measurements of a text as one struct (Arrow batches, one pass)."""
    cache = _Words()  # each task gets its own copy and keeps it from batch to batch

    def run(col: pa.Array) -> pa.Array:
        rows = [_measure(t, cache) for t in text_bytes(col)]
        cols = list(zip(*rows)) or [()] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(MEASURES))

    # nondeterministic: the optimizer must not evaluate it again above a filter
    return F.arrow_udf(run, _TYPE).asNondeterministic()(text)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``measures`` (struct) and ``fail_bits`` (bigint)."""
    prepare(docs.sparkSession)
    out = docs.withColumn("measures", measure(F.col(text_col)))
    bits = sum((F.when(failed, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
                for i, (_, failed) in enumerate(_rules(F.col("measures")))), F.lit(0).cast("long"))
    return out.withColumn("fail_bits", bits)


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def keep(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that the policy accepts, with the input's columns."""
    plain, (text,) = neutral(docs, text_col)
    return ledger(plain, text).where(passes(policy)).select(*plain.columns).toDF(*docs.columns)


def ablations(ledger_df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(policy, rule, fails, fails_alone, kept, kept_without): one row per rule of the policy.

    The ledger is first counted by its bits (at most ``2**len(RULES)`` rows),
    so the texts and rows are read once for all rules and policies.
    """
    m = mask(policy)
    counts = (ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("b"))
              .agg(F.count("*").alias("n")))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
                                for r in POLICIES[policy]]))
    c = counts.select("b", "n", rules.alias("r")).select("b", "n", "r.*")
    n_if = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return c.groupBy(F.lit(policy).alias("policy"), "rule").agg(
        n_if(F.col("b").bitwiseAND(F.col("bit")) != 0).alias("fails"),
        n_if(F.col("b") == F.col("bit")).alias("fails_alone"),
        n_if(F.col("b") == 0).alias("kept"),
        n_if(F.col("b").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"))
