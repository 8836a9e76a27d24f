"""The Jaccard join against all pairs by plain sets: near copies, chains, hubs, short, null and repeated texts."""

import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id long, n int, key string, token string, root string"


def plain_sets(texts, size=3):
    out = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(size, len(w))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def plain_components(rows, percent=90):
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def rows(seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    made = [" ".join(prose(rng.randint(1, 150))) for _ in range(80)]
    for length, copies in ((60, 12), (120, 25), (200, 40), (25, 15), (9, 10)):  # near copies of one base, some linked, some not
        base = prose(length)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 1 + length // 30)):
                w[rng.randrange(length)] = rng.choice(vocab) if rng.random() < 0.5 else f"x{rng.randrange(6)}"
            made.append(" ".join(w))
    chain = prose(100)  # neighbours alike, ends not
    for k in range(20):
        chain = chain[2:] + prose(2)
        made.append(" ".join(chain))
    front = prose(40)  # a passage that many hold
    made += [" ".join(front + prose(rng.randint(3, 60))) for _ in range(40)]
    made += [" ".join(front + [f"end{k}"]) for k in range(8)]
    made += [None, "", " \n", "one", "ONE", "one two", "One\ttwo", "one two three", "one two three four", "É x y", "é x y"]
    made += ["again " * 500, "again " * 9, " ".join(prose(9000))]
    made += [made[-1] + " tail"]
    ids = rng.sample(range(10_000), len(made))
    data = list(zip(ids, made))
    return data + data[:4] + [(ids[90], "one two"), (None, made[100]), (None, None), (None, "only null ids here"), (None, "only null ids here")]


@pytest.mark.parametrize("percent,block_bytes,range_tokens", [(90, 1 << 24, 1 << 21), (80, 4000, 500)])
def test_components_equal_those_of_all_pairs(spark, percent, block_bytes, range_tokens):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, 2, "k", "t", "r") for i, t in data], SCHEMA).repartition(3)
    got = jaccard_join.components(docs, percent=percent, block_bytes=block_bytes, range_tokens=range_tokens).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(plain_components(data, percent), key=order)


def test_empty_table_and_table_without_words(spark):
    assert jaccard_join.components(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.components(docs).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_prefix_is_long_enough_and_no_longer():
    for percent in (80, 90, 100):
        for n in range(1, 400):
            need = next(c for c in range(n + 1) if 100 * c >= percent * n)  # fewest n-grams a partner must share
            assert jaccard_join.prefix_length(n, percent) == n - need + 1
            assert (jaccard_join.prefix_length(np.array([n]), percent) == n - need + 1).all()


def test_one_group_of_near_copies_is_a_star_not_all_pairs(spark):
    """Copies of a base with one word changed: every one is verified against few others."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    data = [(0, " ".join(base))]
    for k in range(1, 400):
        w = list(base)
        w[rng.randrange(300)] = f"c{k}"
        data.append((k, " ".join(w)))
    seen = []
    original, jaccard_join.written = jaccard_join.written, lambda df, name: seen.append((name, original(df, name))) or seen[-1][1]
    try:
        got = jaccard_join.components(spark.createDataFrame(data, "doc_id long, text string")).collect()
    finally:
        jaccard_join.written = original
    assert {r["component_id"] for r in got} == {0}
    assert sum(df.count() for name, df in seen if name == "jaccard-verified") < 10 * len(data)
