"""Plain versions of the pipeline's stages over lists of document dicts."""

import re

import pyarrow.parquet as pq

from tessera.llm import quality_rules
from .test_text_operators import brute_cut, brute_fingerprint, brute_groups, brute_measures, words_of


def quality(docs, sf_dir):
    out = []
    for d in docs:
        n, chars, symbols, dups, repeats = brute_measures(d["text"])
        w = words_of(d["text"])
        lines = sum(bool(words_of(x)) for x in (d["text"] or "").split("\n"))
        upper = sum(sum(c.isupper() for c in x) > 1 and not any(c.islower() for c in x) for x in w)
        plain = sum(2 * sum(c.isalpha() for c in x) > len(x) for x in w)
        failed = (n < 50 or 2 * repeats > n or 10 * symbols > n or (dups >= 3 and 10 * dups > 3 * lines)
                  or chars < 2 * n or chars > 20 * n or 10 * upper > 3 * n or 10 * plain < 7 * n)
        if not failed:
            out.append(d)
    assert len(quality_rules.RULES) == 7
    return out


def near(docs, sf_dir):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    groups = brute_groups([brute_fingerprint(d["text"]) for d in docs])
    return [d for k, d in enumerate(docs) if groups[k] == k]


def substrings(docs, sf_dir):
    cut = {i: (gone, kept) for i, _, gone, kept in brute_cut([(d["doc_id"], d["text"]) for d in docs])}
    return [d | {"text": cut[d["doc_id"]][1], "n_chars": len(cut[d["doc_id"]][1])} if cut[d["doc_id"]][0] else d for d in docs]


def leaks(docs, sf_dir):
    norm = lambda t: " " + " ".join(x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", y).casefold() for y in t.split()) if x) + " "
    items = [norm(t) for t in pq.read_table(f"{sf_dir}/benchmark.parquet").column("text").to_pylist()]
    return [d for d in docs if not any(t in norm(d["text"]) for t in items)]


STAGES = {"quality_rules": quality, "near_dedup": near, "substring_dedup": substrings, "decontamination": leaks}
