"""Quality rules, sharding, near-dedup, packing, classifier, substring dedup, decontamination
against brute force on small tables with nulls, empty and long texts, ties, repeated rows
and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import (
    components, decontaminate, golay_simhash, packing, quality_classifier, quality_rules, sharding, substring_dedup)
from tessera.llm.common import slices, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = prose(30)
    rows = [(i, prose(rng.randint(1, 120))) for i in range(60)]
    rows += [(100 + i, prose(20) + "\n" + passage + "\t" + prose(rng.randint(0, 30))) for i in range(12)]
    rows += [(200 + i, rows[3][1]) for i in range(5)]  # exact copies
    near = prose(200).split()
    for i in range(8):
        words = list(near)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((300 + i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "a b c"), (404, "a b c"), (405, "one"), (406, "A B\x0bC")]
    rows += [(500, prose(30_000)), (501, "rep " * 300), (502, "Same line here\n" * 9 + prose(60)), (None, rows[5][1]), (None, "q")]
    rows += [rows[7], rows[7], (410, "Ünïcode space  em <|endoftext|>x don't 12,5")]
    return rows


SCHEMA = "doc_id long, text string, id long, fp string, n_words int, _chunk string, size double, measures string, pid int"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "fp", 1, "c", 0.5, "m", 3) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


# ---- quality rules ----

def brute_measures(text):
    text = text or ""
    w = words_of(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_ledger_matches_brute_force(docs, rows, empty):
    led = quality_rules.ledger(docs)
    m = "measures"
    got = Counter((r["doc_id"], r[m].n_words, r[m].word_chars, r[m].n_symbols, r[m].n_dup_lines, r[m].n_repeat_words)
                  for r in led.collect())
    assert got == Counter((i, *brute_measures(t)) for i, t in rows)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.where("measures <> 'm'").count() == 0
    assert quality_rules.keep(empty).count() == 0 and quality_rules.ledger(empty).count() == 0


def test_ablations_recount_the_ledger(docs):
    led = quality_rules.ledger(docs)
    bits = [r["fail_bits"] for r in led.select("fail_bits").collect()]
    m = quality_rules.mask("v2")
    for r in quality_rules.ablations(led, "v2").collect():
        bit = 1 << quality_rules.RULES.index(r["rule"])
        assert r["fails"] == sum(b & m & bit != 0 for b in bits)
        assert r["fails_alone"] == sum(b & m == bit for b in bits)
        assert r["kept"] == sum(b & m == 0 for b in bits)
        assert r["kept_without"] == sum(b & m & ~bit == 0 for b in bits)


# ---- sharding ----

def test_shards_are_balanced_gapless_and_whole(docs, rows, empty):
    got = sharding.shard_by_bytes(docs, 7).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["id"], r["size"], r["crc"]) for r in got) == want
    for s in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(empty, 7).count() == 0


def test_shard_sizes_and_groups_at_scale(spark):
    rows = [(i, "t" * (20 + i % 50) + str(i // 3)) for i in range(6000)] + [(10_000 + i, "copy " * 12) for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 10).collect()
    by = Counter()
    for r in got:
        by[r["shard"]] += r["size"]
    mean = sum(by.values()) / 10
    assert len(by) == 10 and all(abs(v - mean) <= 0.05 * mean for v in by.values())


# ---- near-dedup ----

def brute_fingerprint(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_groups(fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_match_brute_force(docs, rows, empty):
    got = golay_simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(fps)
    least = {}
    for g, (i, _) in zip(groups, rows):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, f, least.get(g)) for (i, _), f, g in zip(rows, fps, groups))
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert golay_simhash.near_duplicates(empty).count() == 0
    kept = golay_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter(set(least.values()))
    assert ids.count(None) == 2  # rows without an id all stay


def test_rows_that_share_an_id_are_kept_by_their_texts(spark):
    """Of equal rows one stays; a text goes only if its own group has a smaller id."""
    a, b, c = ("one two three four five six", "red green blue black white grey", "north south east west up down")
    docs = spark.createDataFrame([(7, a, 0), (7, a, 0), (7, b, 1), (7, c, 2), (3, c, 3), (None, c, 4), (8, None, 5), (8, None, 5)],
                                 "doc_id long, text string, text_hash int")
    kept = golay_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(7, a), (7, b), (3, c), (None, c), (8, None)])


def test_golay_keys_cover_every_pair_within_four_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    keys = [set(zip(*map(np.ndarray.tolist, golay_simhash.fuzzy_keys(v)))) for v in (x, y)]
    assert {r for _, r in keys[0] & keys[1]} == set(range(len(x)))
    per = np.bincount((golay_simhash._tables()[2] >= 0).sum(1))
    assert per[1] == 277 and per[6] == 1771


def test_runs_of_any_length_connect_what_links_connect(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = np.unique(base[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
                    ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    want = brute_groups([int(f) for f in fps])
    for long_run in (10_000, 50):
        monkeypatch.setattr(golay_simhash, "LONG_RUN", long_run)
        root = list(range(len(fps)))
        at = {int(f): k for k, f in enumerate(fps)}
        for a, b in golay_simhash._run_links(np.zeros(len(fps), np.int64), fps, 4):
            for u, v in zip(a.tolist(), b.tolist()):
                r, s = at[u], at[v]
                while root[r] != r:
                    r = root[r]
                while root[s] != s:
                    s = root[s]
                root[max(r, s)] = min(r, s)
        found = []
        for k in range(len(fps)):
            while root[k] != k:
                k = root[k]
            found.append(k)
        assert len({*zip(found, want)}) == len(set(found)) == len(set(want))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299), (300, 299)]
    got = {r["node"]: r["root"] for r in
           components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 299: 299, 300: 299}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- packing ----

def test_pieces_rebuild_every_document(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS)
    got = packing.pack(docs, TOKENS, length=512).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    places = {}
    stream = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and any(ids == w[r["start"]:r["start"] + r["length"]] for w in want[r["id"]])
        assert r["from_previous"] == (r["start"] > 0) and r["to_next"] == (r["start"] + r["length"] < r["doc_tokens"])
        stream[r["sequence_id"] * 512 + r["offset"]] = ids
        places[r["sequence_id"]] = places.get(r["sequence_id"], 0) + r["length"]
    total = sum(len(w) for ws in want.values() for w in ws)
    at = 0
    for k in sorted(stream):
        assert k == at
        at += len(stream[k])
    assert at == total and all(n == 512 for s, n in places.items() if s != max(places))
    assert packing.pack(empty, TOKENS).count() == 0


def test_word_ids_equal_the_tokenizer_on_odd_texts(monkeypatch):
    ids = packing.WordIds(TOKENS)
    rng = random.Random(1)
    odd = "abAB.,'\u2019!%e\u0301\u0338=\u00c9\u00df\u00d7\u00f7std'#\u03a3\u03c21\u0663\u00b2\u4e2d \u00a0\u3000<|>\x01\x85-_`$\u0130\u0131\u01c5\u0345\u0958\u2126"
    texts = ["".join(rng.choices(odd, k=rng.randint(1, 14))) + rng.choice(["", "", "<|endoftext|>", "<|ENDOFTEXT|>"]) for _ in range(6000)]
    monkeypatch.setattr(packing, "CACHE_WORDS", 900)  # words are forgotten on the way
    for k in range(0, len(texts), 100):
        got, starts = ids.of_all([t.encode() for t in texts[k:k + 100]])
        for t, g in zip(texts[k:k + 100], np.split(got, starts[1:-1]), strict=True):
            assert g.tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_tokenizer_of_another_kind_is_refused():
    with pytest.raises(ValueError, match="white space"):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


# ---- classifier ----

def test_classifier_learns_and_scores_everything(spark, empty):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    good = lambda: " ".join(rng.choices(vocab, k=60))
    junk = lambda: " ".join(w.upper() + "!!" for w in rng.choices(vocab, k=60))
    rows = [(i, good() if i % 4 else junk()) for i in range(800)] + [(900, None), (901, ""), (1, "copy"), (None, good())]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(2, None), (None, 1), (399, 1)],
                                   "doc_id long, quality int")
    w = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, w).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and 400 <= r["doc_id"] < 800]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.98 * len(held)
    nothing = quality_classifier.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(docs, nothing).collect()} == {0.5}
    assert quality_classifier.score(empty, w).count() == 0
    assert (quality_classifier.train(docs, labels) == w).all()


# ---- substring dedup ----

def brute_cut(rows, n=13):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k:k + n])] = min(first.get(tuple(w[k:k + n]), i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = {j for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k:k + n])] < i for j in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


@pytest.mark.parametrize("chunk", [substring_dedup.CHUNK, 2000])
def test_substring_dedup_matches_brute_force(docs, rows, empty, chunk, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "RANGE_WORDS", 3000 if chunk == 2000 else 1 << 20)
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept_text", "removed_spans"]
    got = cut.collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute_cut(rows)
    for r in got:
        assert sum(s["len"] for s in r["removed_spans"]) == r["n_removed"]
    assert {r["fp"] for r in got} == {"fp"}
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_packed_hashes_round_trip():
    v = np.sort(np.random.default_rng(1).integers(0, 2**40, 999, dtype=np.uint64))
    assert (substring_dedup._unpack(substring_dedup._pack(v, 5), 5) == v).all()


def test_slices_cover_the_batch():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 9, 3)] + [None])], names=["text"])
    parts = list(slices(b, "text", 8))
    assert [t for p in parts for t in text_bytes(p.column(0))] == text_bytes(b.column(0)) and len(parts) > 1


# ---- decontamination ----

def test_leaks_are_found_and_clean_documents_left_alone(spark, empty, monkeypatch):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, prose(rng.randint(15, 40)).capitalize() + ". " + prose(8).capitalize() + ".") for i in range(50)]
    items += [(50, None), (51, ""), (52, "one two"), (3, items[3][1])]
    docs, want = [], set()
    for d in range(120):
        text = prose(rng.randint(0, 400))
        if d % 3 == 0:
            i, t = items[d % 50]
            text = prose(rng.randint(0, 300)) + " " + (t.upper() if d % 2 else t.replace(". ", ".\n")) + "### " + text
            want.add((d, i))
        docs.append((d, text))
    docs += [(500, None), (501, ""), (0, docs[0][1]), (None, items[4][1]), (502, prose(20_000) + " " + items[6][1])]
    want |= {(None, 4), (502, 6)}
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(frame, bench).collect()
    assert {(r["id"], r["item_id"]) for r in found} == want
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}  # the null id leaks too
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    assert sorted(map(str, decontaminate.keep_clean(frame, bench).collect())) == sorted(map(str, clean.collect()))
    named = decontaminate.keep_clean(frame.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), bench)
    assert {r["doc_id"] for r in named.collect()} == {f"d{d}" for d, _ in docs if d is not None} - {f"d{d}" for d, _ in want}
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0


def test_long_posting_lists_in_bounded_memory(monkeypatch):
    """10,000 items of few words against long texts: groups of windows give the same cells as all pairs do, in little memory."""
    import tracemalloc

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=14)) + "? " + " ".join(rng.choices(vocabulary, k=6)) + ".") for k in range(10_000)]
    index = decontaminate.Index(items)
    texts = [" ".join(rng.choices(vocabulary, k=3000)) + " " + items[7][1] + " " + items[9_999][1]]
    docs = decontaminate._numbered([t.encode() for t in texts], decontaminate._TermNumbers(index.terms))
    whole = list(decontaminate._matches(docs, index, decontaminate.STEP))
    monkeypatch.setattr(decontaminate, "POSTINGS", 1 << 16)
    tracemalloc.start()
    grouped = list(decontaminate._matches(docs, index, decontaminate.STEP))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert grouped == whole and {index.ids[k] for _, k, *_ in whole} >= {7, 9_999}
    assert peak < 60 << 20, peak
    w, t = np.repeat(np.arange(3), 40), np.concatenate([np.sort(np.array(rng.sample(range(len(index.terms)), 40))) for _ in range(3)])
    want = []
    for window in range(3):
        bound = index.floor.copy()
        for term in t[w == window]:
            of = slice(index.post_start[term], index.post_start[term + 1])
            bound[index.post_block[of]] += index.post_impact[of]
        want += [window * index.n_blocks + int(b) for b in np.flatnonzero(bound >= index.threshold - 1e-9)]
    assert sorted(decontaminate._cells(w, t, index)) == want


def test_block_max_pruning_misses_nothing_above_the_threshold():
    rng = random.Random(11)
    vocab = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 40))) + ".") for i in range(90)]
    index = decontaminate.Index(items, threshold=0.3, block=8)
    texts = [" ".join(rng.choices(vocab, k=100) + items[k % 90][1].split()[:rng.randint(3, 30)]) for k in range(60)]
    numbers = decontaminate._TermNumbers(index.terms)
    orig = decontaminate.QUESTION, decontaminate.ANSWER
    decontaminate.QUESTION = decontaminate.ANSWER = 0.0
    try:
        got = {(d, k) for d, k, *_ in decontaminate._hits([t.encode() for t in texts], index, numbers, 64)}
    finally:
        decontaminate.QUESTION, decontaminate.ANSWER = orig
    want = set()
    for d, t in enumerate(texts):
        w = [decontaminate.fold(x) for x in t.split()]
        for s in range(0, max(1, len(w)), 64):
            held = {index.terms.get(x) for x in w[s:s + 128]}
            want |= {(d, k) for k, imp in enumerate(index.impacts) if sum(v for x, v in imp.items() if x in held) >= 0.3}
    assert got == want and want


def _found(texts, items):
    index = decontaminate.Index(items)
    found = decontaminate._hits([t.encode() for t in texts], index, decontaminate._TermNumbers(index.terms), decontaminate.STEP)
    return [(d, index.ids[k], round(q, 2), round(a, 2), first) for d, k, _, q, a, first in found]


def test_every_retrieved_passage_is_verified_not_only_the_one_that_holds_most_of_the_question():
    question, answer = [f"q{i}" for i in range(24)], [f"a{i}" for i in range(8)]
    items = [(1, " ".join(question) + ". " + " ".join(answer) + ".")]
    items += [(2 + i, " ".join(f"z{i}x{j}" for j in range(30)) + ".") for i in range(20)]
    filler = lambda n: [f"f{i}" for i in range(n)]
    quoted = question + filler(300)  # the question alone
    near = question[:21] + ["other"] + question[22:] + answer  # near copy of the whole item
    assert [x[:2] for x in _found([" ".join(quoted)], items)] == []
    (hit,) = _found([" ".join(quoted + near + filler(90))], items)
    assert hit[:2] == (0, 1) and hit[2] < 1 and hit[3] == 1 and hit[4] >= 256
    (hit,) = _found([" ".join(filler(10) + question + filler(90) + answer[:3] + filler(20) + question[4:] + answer)], items)
    assert hit[:2] == (0, 1) and hit[3] == 1


def test_items_and_documents_are_cut_into_words_by_one_rule():
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    for c in spaces:
        assert decontaminate.words(f"a{c}b".encode()) == [b"a", b"b"], hex(ord(c))
        assert decontaminate.words(f"é{c}b".encode()) == ["é".encode(), b"b"], hex(ord(c))
    assert decontaminate.words("à\u200b\u2010 Ā\u3001".encode()) == ["à\u200b\u2010".encode(), "Ā\u3001".encode()]
    plain = "Quel est le prix de 12 500 litres d'eau « pure » à 20 °C en France ? Le prix est de 3 euros !"
    for c in ("\u00a0", "\u2009", "\u202f", "\u3000"):
        item = re.sub(r" (?=[?!»°0-9a-f])|(?<=«) ", c, plain)
        items = [(1, item)] + [(2 + i, " ".join(f"z{i}x{j}" for j in range(30)) + ".") for i in range(20)]
        got = _found([f"avant {item} après", f"avant {plain} après", "rien d'autre"], items)
        assert [(x[0], x[1], x[2], x[3]) for x in got] == [(0, 1, 1, 1), (1, 1, 1, 1)], c


def test_parts_of_the_benchmark_and_long_items_change_no_result(spark, monkeypatch):
    rng = random.Random(5)
    vocab = ["w%d" % int(rng.paretovariate(0.5)) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, f"{prose(rng.randint(8, 30))}. {prose(6)}.") for i in range(60)] + [(60, prose(150) + ". " + prose(20) + ".")]
    items += [(61, items[4][1]), (62, " "), (63, None)]
    texts = []
    for d in range(80):
        w = items[d % 61][1].split()
        texts.append((d, " ".join([prose(rng.randint(0, 90))] + [x if rng.random() > 0.12 else "other" for x in w] + [prose(80)])))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    found = lambda rows: {(r["id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.leaks(docs, bench(rows)).collect()}
    whole = found(items)
    monkeypatch.setattr(decontaminate, "PART_BYTES", 1500)
    assert found(items) == whole and len(whole) > 20 and any(i == 60 for _, i in whole)
    # a passage is as long as its item asks for, whatever other items there are
    (question, answer), other = (" ".join(f"q{i}" for i in range(24)), " ".join(f"a{i}" for i in range(8))), " ".join(f"l{i}" for i in range(900))
    far = [question + " " + " ".join(f"f{i}" for i in range(300)) + " " + answer]
    short = [(1, f"{question}. {answer}.")] + [(3 + i, prose(20) + ".") for i in range(20)]
    for rows in (short, [*short, (2, other + ".")]):
        indexes = decontaminate.by_length(rows)
        numbers = decontaminate._TermNumbers(indexes[0][1].terms)
        assert not [h for step, index in indexes for h in decontaminate._hits([t.encode() for t in far], index, numbers, step)]
