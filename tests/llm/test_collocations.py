"""Collocations against plain counting in Python integers; the summaries' guarantee; scores past 64 bits."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import collocations

SCHEMA = "lang string, text string, phrase string, n long, k int, f string, block long"


def plain_collocations(rows, longest, threshold, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    candidates = {key: c for key, c in f.items() if len(key[1]) > 1 and c >= threshold}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and c >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (g, q), c in candidates.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]], n[lang], cut))
    return {(lang, k + 1, p.decode(), -a, left, right, total, -s, cut)
            for lang, found in out.items() for k, (s, a, p, left, right, total, cut) in enumerate(sorted(found)[:top])}


def rows():
    rng = random.Random(8)
    vocab = ["a", "B", "é", "É", "ß", "x\x00y", "漢", "d", "E1", "-", "\x1c", " "]
    seps = [" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\r", "\x0b", "?!"]
    text = lambda n: "".join(rng.choice(vocab[:rng.randint(2, 12)]) + rng.choice(seps) for _ in range(n))
    made = [(rng.choice(["en", "en", "en", "de", None, ""]), text(rng.randint(0, 40))) for _ in range(300)]
    made += [("en", "New York City is big. " * 30), ("en", "the same line\n" * 50), ("fr", None), ("xx", ""), (None, None), ("en", " . ")]
    return made + made[:20] + [("de", text(20_000))]


@pytest.mark.parametrize("threshold,top,block_bytes,range_mass", [(20, 2000, 1 << 24, 1 << 22), (4, 7, 3000, 800)])
def test_collocations_equal_plain_counting(spark, threshold, top, block_bytes, range_mass):
    data = rows()
    docs = spark.createDataFrame([(x, t, "p", 1, 2, "f", 3) for x, t in data], SCHEMA).repartition(4)
    got = collocations.collocations(docs, 5, threshold, top, block_bytes=block_bytes, range_mass=range_mass).collect()
    want = plain_collocations(data, 5, threshold, top)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_empty_table_and_nothing_frequent(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([("en", "one two three"), (None, None)], "lang string, text string")
    assert collocations.collocations(docs).collect() == []


def test_summary_keeps_every_item_that_reaches_the_threshold_in_bounded_memory():
    rng = np.random.default_rng(3)
    items = np.concatenate([rng.integers(0, 1 << 30, 60_000), np.repeat(rng.integers(0, 1 << 30, 40), 100), rng.integers(0, 50, 5000)])
    rng.shuffle(items)
    threshold, true = 100, Counter(items.tolist())
    summary = collocations.Summary(len(items) // threshold + 1)
    for part in np.array_split(items.astype(np.uint32), 90):
        summary.merge(*np.unique(part, return_counts=True))
        assert len(summary.keys) <= summary.capacity
    found = set(summary.reaching(threshold).tolist())
    assert {x for x, c in true.items() if c >= threshold} <= found and len(found) <= summary.capacity
    assert 0 < summary.taken < threshold


def test_scores_are_exact_past_64_bits(spark):
    n, a, left, rest = 9_007_199_254_740_993, 3_000_000_000_001, 3_000_000_000_007, 4_000_000_000_009
    found = spark.createDataFrame([("en", 2, "p q", a), ("en", 1, "p", left), ("en", 1, "q", rest)], "lang string, k int, phrase string, f long")
    words = spark.createDataFrame([("en", n)], "lang string, n long")
    (row,) = collocations.scored(collocations.maximal(found), found, words).collect()
    assert row["score"] == 1000 * a * n // (left * rest)
