"""Card merge rules on hand-made cards."""

from tessera.operators import cards as C

SCHEMA = ("file string, idx long, direction string, cue_spanish string, target_en array<string>, "
          "example_sentence_es string, notes string, mandatory_level string, tag string")


def merged(spark, rows):
    out = C.merge_cards(spark.createDataFrame(rows, SCHEMA))
    return out, {r.key: r for r in out["merged"].collect()}


def test_fold_against_accumulated_value(spark):
    rows = [("f1", i, "spanish_to_target", "w", ["a"], s, "", "A1", "t")
            for i, s in enumerate(["A", "b", "a", "A"])]
    _, m = merged(spark, rows)
    assert m["spanish_to_target|w||"].example_sentence_es == "A\nb\na\nA"


def test_leading_case_duplicates_skipped_and_empty_append(spark):
    rows = [("f1", 0, "spanish_to_target", "w", ["a"], "Hola", "", "A1", "t"),
            ("f1", 1, "spanish_to_target", "w", ["a"], "hola", "X", "B2", "t"),
            ("f2", 0, "spanish_to_target", "w", ["a"], "HOLA", "x", "C1", "T")]
    out, m = merged(spark, rows)
    r = m["spanish_to_target|w||"]
    assert r.example_sentence_es == "Hola"
    assert r.notes == "\nX\nx"         # "" -> "\nX"; "x" differs from the accumulated "\nX"
    assert r.mandatory_level == "A1"   # level: first wins, silently
    assert r.tag == "t" and out["conflicts"].count() == 0  # 'T' equals 't' ignoring case


def test_notes_second_append(spark):
    rows = [("f1", 0, "spanish_to_target", "w", ["a"], "s", "", "A1", "t"),
            ("f1", 1, "spanish_to_target", "w", ["a"], "s", "X", "A1", "t"),
            ("f1", 2, "spanish_to_target", "w", ["a"], "s", "y", "A1", "u")]
    out, m = merged(spark, rows)
    assert m["spanish_to_target|w||"].notes == "\nX\ny"
    c = out["conflicts"].collect()
    assert [(x.field, x.kept, x.other) for x in c] == [("tag", "t", "u")]


def test_array_append_keeps_inner_duplicates(spark):
    rows = [("f1", 0, "spanish_to_target", "w", ["a"], "s", "", "A1", "t"),
            ("f1", 1, "spanish_to_target", "w", ["b", "b", "a"], "s", "", "A1", "t"),
            ("f2", 0, "spanish_to_target", "w", ["b", "c"], "s", "", "A1", "t")]
    _, m = merged(spark, rows)
    assert m["spanish_to_target|w||"].target_en == ["a", "b", "b", "c"]


def test_missing_field_rejects_card_only(spark):
    rows = [("f1", 0, "spanish_to_target", "w", ["a"], "s", "", "A1", "t"),
            ("f1", 1, "spanish_to_target", "w", None, "z", "", "A1", "t"),
            ("f1", 2, "spanish_to_target", "w", ["q"], "s", "", "A1", "t")]
    out, m = merged(spark, rows)
    r = m["spanish_to_target|w||"]
    assert r.target_en == ["a", "q"] and r.example_sentence_es == "s" and r.n_cards == 3
    assert [x.idx for x in out["rejected"].collect()] == [1]


def test_totals_and_faces(spark):
    rows = [("f1", 0, "spanish_to_target", "w", ["a", "b"], "s", "", "A1", "t"),
            ("f1", 1, "spanish_to_target", "w", ["a"], "s", "", "A1", "t"),
            ("f1", 2, "bogus", "v", ["a"], "s", "", None, "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    t = C.merge_totals(df).first()
    assert (t.unique_cards, t.duplicates) == (2, 1)
    faces = C.card_faces(C.merge_cards(df)["merged"]).collect()
    assert len(faces) == 1 and faces[0].front_sentence == '"s"'
    assert faces[0].back_word.endswith("a, b<br><span class='lang-label'>DE:</span> ")
    assert C.deck_title("x/spanish_core_2k") == "Spanish Core 2K"


def test_level_distribution_zero_fill(spark):
    df = spark.createDataFrame([("A1", "B2"), ("", "B2"), (None, "Z9")],
                               "earliest_level string, mandatory_level string")
    got = {(r.kind, r.level): (r.n, r.standard) for r in C.level_distribution(df).collect()}
    assert got[("earliest", "A1")] == (1, True) and got[("earliest", "C2")] == (0, True)
    assert got[("mandatory", "B2")] == (2, True) and got[("mandatory", "Z9")] == (1, False)
    assert ("earliest", "") not in got


def _py_fold(vals):
    acc = vals[0]
    for y in vals[1:]:
        if acc.lower() != y.lower():
            acc += "\n" + y
    return acc


def test_fold_exact_path_with_multiline_values(spark):
    vals = ["a", "B", "a\nb", "c"]          # "a\nb" equals the accumulated "a\nB" -> kept
    rows = [("f1", i, "spanish_to_target", "w", ["a"], v, "", "A1", "t") for i, v in enumerate(vals)]
    _, m = merged(spark, rows)
    assert m["spanish_to_target|w||"].example_sentence_es == _py_fold(vals) == "a\nB\nc"


def test_fold_block_path_many_files(spark):
    import random
    from tessera.operators import cards as C
    rnd = random.Random(5)
    rows, by_key = [], {}
    for f in range(6):
        for i in range(300):
            k = rnd.choice(["w1", "w2", "w3"])
            v = rnd.choice(["Hola", "hola", "adios", "", "x"])
            rows.append((f"f{f}", i, "spanish_to_target", k, ["a"], v, v, "A1", "t"))
            by_key.setdefault(k, []).append(((f"f{f}", i), v))
    old = C.FOLD_BLOCK
    C.FOLD_BLOCK = 7
    try:
        _, m = merged(spark, rows)
    finally:
        C.FOLD_BLOCK = old
    for k, items in by_key.items():
        want = _py_fold([v for _, v in sorted(items)])
        r = m[f"spanish_to_target|{k}||"]
        assert r.example_sentence_es == want and r.notes == want


def test_conflicts_alone_equal_those_of_the_merge(spark):
    import random
    rnd = random.Random(8)
    pick = lambda *v: rnd.choice(v)
    rows = [(f"f{rnd.randrange(3)}", i, "spanish_to_target", pick("a", "b"), pick("x", "X", "y", None), pick(["p"], None),
             pick("s1", None), pick("A1", None)) for i in range(120)]
    cards = spark.createDataFrame(rows, "file string, idx long, direction string, cue_spanish string, tag string, "
                                  "words array<string>, sentence string, mandatory_level string")
    both = [sorted(map(str, f.collect())) for f in (C.merge_cards(cards)["conflicts"], C.card_conflicts(cards))]
    assert both[0] == both[1] and both[0]
