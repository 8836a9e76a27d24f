"""Card operators: identity, ordered merge of duplicates, faces, levels, checks.

Input: a DataFrame in the wide card schema (FIXTURES 1.5) plus ``file`` and
``idx`` that give the merge order (deviation V1: the source uses directory
listing order, which is unspecified; we use (file, idx)).

Merge semantics (per card key, cards in (file, idx) order, the first card
fixes the set of merged fields):

* array field: append the items of a later array that are not yet in the
  accumulated array; duplicates inside that later array survive;
* string field whose name contains ``sentence`` or ``notes``: keep when equal
  to the accumulated string ignoring case, else append ``"\\n" + value``;
* string field whose name contains ``level``: first value wins;
* any other string field: first value wins, differences are reported as
  conflicts;
* a later card missing a field the first card has is rejected on its own
  (deviation V8: the source drops the rest of that file).

Scale: every step is a shuffle-aggregate with map-side partial aggregation or
an equi-join on the key; no step collects all cards of a key.  Array merge is
decided per (key, item) by the first card holding the item, and a string fold
only collects the values from the first differing card on, i.e. what ends up
in the output row anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
FORWARD = ["spanish_to_target", "spanish_sentence_to_target"]
REVERSE = ["target_to_spanish", "target_sentence_to_spanish"]
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
LABEL_EN = "<span class='lang-label'>EN:</span> "
LABEL_DE = "<span class='lang-label'>DE:</span> "
LABEL_ES = "<span class='lang-label'>ES:</span> "
# ---------------------------------------------------------------------------

ORDER = ("file", "idx")


def card_key(df: DataFrame) -> Column:
    """``direction|cue_spanish|cue_en|cue_de``; missing direction prints None."""
    def part(c):
        return F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    d = F.coalesce(F.col("direction"), F.lit("None")) if "direction" in df.columns else F.lit("None")
    return F.concat_ws("|", d, part("cue_spanish"), part("cue_en"), part("cue_de"))


def field_kinds(df: DataFrame, exclude=ORDER + ("key",)) -> dict[str, str]:
    """Classify card fields: array / fold / level / first."""
    kinds = {}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, ArrayType):
            kinds[f.name] = "array"
        elif isinstance(f.dataType, StringType):
            if "sentence" in f.name or "notes" in f.name:
                kinds[f.name] = "fold"
            elif "level" in f.name:
                kinds[f.name] = "level"
            else:
                kinds[f.name] = "first"
        else:
            kinds[f.name] = "unsupported"
    return kinds


def _ord() -> Column:
    return F.struct(*[F.col(c) for c in ORDER])


def with_key(cards: DataFrame) -> DataFrame:
    return cards.withColumn("key", card_key(cards))


def first_cards(cards: DataFrame) -> DataFrame:
    """First card per key and the number of cards with that key.

    ``min(struct(file, idx, ...))`` is a partial aggregate: each map task
    keeps one candidate per key, so a hot key never sits in one task whole.
    """
    fields = [c for c in cards.columns if c not in ("key",) + ORDER]
    first = F.min(F.struct(*[F.col(c) for c in ORDER + tuple(fields)])).alias("f")
    return cards.groupBy("key").agg(first, F.count(F.lit(1)).alias("n_cards"))


def later_cards(cards: DataFrame, firsts: DataFrame, keep_first: bool = False) -> DataFrame:
    """Cards joined with the first card ``f`` of their key and ``n_cards``;
    ``is_first`` marks the first card itself, ``accepted`` the later cards
    that have every field the first card has."""
    kinds = field_kinds(cards)
    j = cards.join(firsts.select("key", "f", "n_cards"), "key")
    j = j.withColumn("is_first", (F.col("file") == F.col("f.file")) & (F.col("idx") == F.col("f.idx")))
    if not keep_first:
        j = j.filter(~F.col("is_first"))
    missing = F.lit(False)
    for name, kind in kinds.items():
        if kind == "unsupported":
            continue
        missing = missing | (F.col(f"f.{name}").isNotNull() & F.col(name).isNull())
    return j.withColumn("accepted", ~missing)


def _array_merge(cards_ok: DataFrame, names: list[str]) -> DataFrame:
    """(key, merged array per field) for all array fields in one pass.

    Each card contributes (field, distinct item, positions) rows (row-local);
    the first card holding an item keeps all of its occurrences, decided by a
    partial-aggregating ``min`` per (key, field, item); the survivors are put
    back in (file, idx, position) order per key.
    """
    def entries(n):
        arr = F.col(n)
        return F.transform(F.array_distinct(arr), lambda x: F.struct(
            F.lit(n).alias("field"), x.alias("item"),
            F.filter(F.sequence(F.lit(1), F.size(arr)), lambda i: F.element_at(arr, i) == x).alias("pos")))
    all_entries = F.flatten(F.array(*[F.coalesce(entries(n), F.array().cast(
        "array<struct<field:string,item:string,pos:array<int>>>")) for n in names]))
    per_card = cards_ok.select("key", *ORDER, F.explode(all_entries).alias("e"))
    first_holder = per_card.groupBy("key", F.col("e.field").alias("field"), F.col("e.item").alias("item")).agg(
        F.min(F.struct(*[F.col(c) for c in ORDER], F.col("e.pos").alias("pos"))).alias("h"))
    occ = first_holder.select("key", "field", "item", F.col("h.file").alias("file"),
                              F.col("h.idx").alias("idx"), F.explode("h.pos").alias("pos"))
    return occ.groupBy("key").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == n, F.struct("file", "idx", "pos", "item")))),
                    lambda s: s["item"]).alias(n) for n in names])


FOLD_BLOCK = 4096  # cards per partial string in the two-level fold


def _fold_tails(tail_rows: DataFrame, folds: list[str]) -> DataFrame:
    """Tails of all string folds per key, one row per key with, per field,
    ``_text_<n>`` (ordered join of the tail) or ``_items_<n>`` (the tail in
    order, for keys that need the sequential fold).

    Cards from the first one that differs (ignoring case) from the first
    card's value on are all that matter.  If no later card of the key
    contains a newline in that field (``_nl_<n>``, a superset of the tail),
    each tail value is appended (the accumulated string then holds a newline
    they cannot equal), so the tail is an ordered join built in two levels -
    blocks of ``FOLD_BLOCK`` cards per (key, field, file), then per key.
    Otherwise the key keeps the exact sequential fold over its tail.  All
    fold fields share the same passes.
    """
    t = tail_rows.select("key", *ORDER, F.explode(F.array(*[F.struct(
        F.lit(n).alias("field"), F.col(n).alias("v"), F.col(f"_nl_{n}").alias("nl"),
        (F.col(f"_j_{n}").isNotNull() & (_ord() >= F.col(f"_j_{n}"))).alias("keep")) for n in folds])).alias("x"))
    t = t.filter("x.keep").select("key", *ORDER, "x.field", "x.v", "x.nl")
    fast = t.filter(~F.col("nl"))
    blocks = fast.groupBy("key", "field", "file", F.floor(F.col("idx") / FOLD_BLOCK).alias("_b")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda x: x["v"]),
                     "\n").alias("part"))
    fast_tail = blocks.groupBy("key", "field").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("file", "_b", "part"))), lambda x: x["part"]), "\n").alias("text"))
    slow_tail = t.filter(F.col("nl")).groupBy("key", "field").agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ORDER], "v"))).alias("items"))
    both = fast_tail.select("key", "field", "text", F.lit(None).cast(slow_tail.schema["items"].dataType)
                            .alias("items")).unionByName(
        slow_tail.select("key", "field", F.lit(None).cast("string").alias("text"), "items"))
    return both.groupBy("key").agg(*[x for n in folds for x in (
        F.max(F.when(F.col("field") == n, F.col("text"))).alias(f"_text_{n}"),
        F.first(F.when(F.col("field") == n, F.col("items")), ignorenulls=True).alias(f"_items_{n}"))])


def merge_cards(cards: DataFrame, materialize_join: bool = True) -> dict[str, DataFrame]:
    """A1/A2/A3/V8: returns ``merged``, ``conflicts`` and ``rejected`` frames.

    ``merged`` has one row per key: the merged card, ``n_cards`` (all cards of
    the key) and the first card's ``file``/``idx``.

    The cards joined with the first card of their key feed five branches
    (base row, arrays, fold starts, fold tails, conflicts); that join is
    written once to the shared checkpoint folder (``materialize_join``), so the
    input is scanned twice in total instead of once per branch.
    """
    cards = with_key(cards)
    kinds = field_kinds(cards)
    firsts = first_cards(cards)
    joined = later_cards(cards, firsts, keep_first=True)
    if materialize_join:
        from tessera.session import materialize
        joined = materialize(joined, "card-merge")
    first_rows = joined.filter("is_first")
    later = joined.filter(~F.col("is_first"))
    ok_later = later.filter("accepted")

    out = first_rows.select("key", "n_cards", "file", "idx",
                            *[F.col(n) for n, k in kinds.items() if k in ("first", "level")])

    # Arrays: first card + accepted later cards, all array fields in one pass.
    arrays = [n for n, k in kinds.items() if k == "array"]
    if arrays:
        accepted = joined.filter(F.col("is_first") | F.col("accepted")).select("key", *ORDER, *arrays)
        merged = _array_merge(accepted, arrays)
        present = first_rows.select("key", *[F.col(n).isNotNull().alias(f"_has_{n}") for n in arrays])
        arr = present.join(merged, "key", "left").select("key", *[
            F.when(F.col(f"_has_{n}"), F.coalesce(F.col(n), F.array().cast("array<string>"))).alias(n)
            for n in arrays])
        out = out.join(arr, "key")

    # String folds: only the values from the first differing card on matter.
    folds = [n for n, k in kinds.items() if k == "fold"]
    if folds:
        # first differing card per field, and whether any later card has a
        # newline in that field (then the key needs the sequential fold)
        starts = ok_later.groupBy("key").agg(*[
            F.min(F.when(F.lower(F.col(n)) != F.lower(F.col(f"f.{n}")), _ord())).alias(f"_j_{n}")
            for n in folds], *[F.max(F.col(n).contains("\n")).alias(f"_nl_{n}") for n in folds])
        tail_rows = ok_later.join(starts, "key")
        fold_df = first_rows.select("key", *folds).join(_fold_tails(tail_rows, folds), "key", "left")
        out = out.join(fold_df.select("key", *[
            F.when(F.col(n).isNull(), F.lit(None).cast("string"))
            .when(F.col(f"_items_{n}").isNotNull(), F.aggregate(
                F.col(f"_items_{n}"), F.col(n),
                lambda acc, y: F.when(F.lower(acc) == F.lower(y["v"]), acc)
                .otherwise(F.concat(acc, F.lit("\n"), y["v"]))))
            .when(F.col(f"_text_{n}").isNotNull(), F.concat(F.col(n), F.lit("\n"), F.col(f"_text_{n}")))
            .otherwise(F.col(n)).alias(n)
            for n in folds]), "key")

    conflicts = _conflicts(ok_later, [n for n, k in kinds.items() if k == "first"])
    rejected = later.filter(~F.col("accepted")).select("key", *ORDER)
    return {"merged": out, "conflicts": conflicts, "rejected": rejected}


def _conflicts(ok_later: DataFrame, fields: list[str]) -> DataFrame | None:
    if not fields:
        return None
    return ok_later.select(
        "key", *ORDER,
        F.explode(F.filter(
            F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"f.{n}").alias("kept"),
                               F.col(n).alias("other")) for n in fields]),
            lambda s: s["kept"].isNotNull() & (F.lower(s["kept"]) != F.lower(s["other"])))).alias("c")
    ).select("key", *ORDER, "c.field", "c.kept", "c.other")


def card_conflicts(cards: DataFrame) -> DataFrame | None:
    """A3 on its own: what ``merge_cards`` gives as ``conflicts``, from one
    narrow join.  Of the fields that cannot conflict only their presence is
    carried (a card without a field that the first card has is rejected)."""
    cards = with_key(cards)
    kinds = field_kinds(cards)
    fields = [n for n, k in kinds.items() if k == "first"]
    narrow = cards.select("key", *ORDER, *fields, *[
        F.when(F.col(n).isNotNull(), F.lit("")).alias(n) for n, k in kinds.items() if k not in ("first", "unsupported")])
    return _conflicts(later_cards(narrow, first_cards(narrow)).filter("accepted"), fields)


def merge_totals(cards: DataFrame) -> DataFrame:
    """A2: unique keys (incl. directions rejected later) and duplicates."""
    per_key = with_key(cards).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.count(F.lit(1)).alias("unique_cards"),
                       (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def _fmt_list(c: Column) -> Column:
    return F.array_join(c, ", ")


def card_faces(merged: DataFrame) -> DataFrame:
    """E18 + F4: note faces for known directions; other directions dropped."""
    d = F.col("direction")
    fwd, rev = d.isin(FORWARD), d.isin(REVERSE)

    cols = set(merged.columns)

    def s(c):
        return F.coalesce(F.col(c), F.lit("")) if c in cols else F.lit("")

    def lst(c):
        return F.coalesce(_fmt_list(F.col(c)), F.lit("")) if c in cols else F.lit("")

    front_word = F.when(fwd, s("cue_spanish")).when(
        rev, F.concat(F.lit(LABEL_EN), s("cue_en"), F.lit("<br>"), F.lit(LABEL_DE), s("cue_de")))
    front_sentence = F.when(fwd, F.concat(F.lit('"'), s("example_sentence_es"), F.lit('"'))).when(
        rev, F.concat(F.lit(LABEL_EN + '"'), s("example_sentence_en"), F.lit('"<br>' + LABEL_DE + '"'),
                      s("example_sentence_de"), F.lit('"')))
    back_word = F.when(fwd, F.concat(F.lit(LABEL_EN), lst("target_en"), F.lit("<br>" + LABEL_DE),
                                     lst("target_de"))).when(
        rev, F.concat(F.lit(LABEL_ES), lst("target_es")))
    back_sentence = F.when(fwd, F.concat(F.lit(LABEL_EN), s("example_sentence_en"), F.lit("<br>" + LABEL_DE),
                                         s("example_sentence_de"))).when(
        rev, F.concat(F.lit(LABEL_ES), s("example_sentence_es")))
    return merged.filter(fwd | rev).select(
        "key", F.coalesce(F.col("mandatory_level"), F.lit("Uncategorized")).alias("level"),
        front_word.alias("front_word"), front_sentence.alias("front_sentence"),
        back_word.alias("back_word"), back_sentence.alias("back_sentence"))


def deck_title(folder: str) -> str:
    """E20 deck base name: a job parameter (one string), so Python's title()."""
    import os
    return os.path.basename(folder.rstrip("/")).replace("_", " ").title()


def stable_ids(faces: DataFrame, folder: str) -> DataFrame:
    """Note guid from the key, deck name and id from name + level.

    Same key -> same id across runs (content hash, not a random sequence).
    """
    base = deck_title(folder)
    return faces.select(
        "*",
        F.substring(F.sha2(F.col("key"), 256), 1, 16).alias("note_guid"),
        F.concat(F.lit(base + "::level"), F.col("level")).alias("deck_name"),
        F.substring(F.sha2(F.concat(F.lit(base + "_"), F.col("level")), 256), 1, 16).alias("deck_id"))


def level_distribution(cards: DataFrame) -> DataFrame:
    """A4: cards per (kind, level); fixed levels zero-filled, others listed.

    Blank and null levels are skipped.  Output: kind, level, n, standard.
    """
    long = cards.select(F.explode(F.array(
        F.struct(F.lit("earliest").alias("kind"), F.col("earliest_level").alias("level")),
        F.struct(F.lit("mandatory").alias("kind"), F.col("mandatory_level").alias("level")))).alias("x")
    ).select("x.kind", "x.level").filter(F.col("level").isNotNull() & (F.col("level") != ""))
    counts = long.groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"))
    spark = cards.sparkSession
    domain = spark.createDataFrame(
        [(k, lv, i) for k in ("earliest", "mandatory") for i, lv in enumerate(LEVELS)],
        "kind string, level string, ord int")
    # ``domain`` has 12 rows by construction: broadcasting it is bounded.
    std = domain.join(counts, ["kind", "level"], "left").select(
        "kind", "level", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
        F.lit(True).alias("standard"))
    other = counts.join(F.broadcast(domain), ["kind", "level"], "left_anti").select(
        "kind", "level", F.col("n").cast("bigint"), F.lit(False).alias("standard"))
    return std.unionByName(other)


def level_ord(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c)


def quality_levels(cards: DataFrame) -> DataFrame:
    """Q1: level outside the domain, or earliest later than mandatory."""
    c = with_key(cards)
    e, m = F.col("earliest_level"), F.col("mandatory_level")
    rules = F.array(
        F.when((e.isNull() | (e == "")) | (level_ord(e) == 0), F.lit("earliest_level_domain")),
        F.when((m.isNull() | (m == "")) | (level_ord(m) == 0), F.lit("mandatory_level_domain")),
        F.when((level_ord(e) > 0) & (level_ord(m) > 0) & (level_ord(e) > level_ord(m)),
               F.lit("earliest_after_mandatory")))
    return c.select("key", *ORDER, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def quality_prefix(cards: DataFrame) -> DataFrame:
    """Q2: infinitive cue -> English targets start with ``to ``;
    capitalised German targets (nouns) start with der/die/das."""
    c = with_key(cards)
    fwd = F.col("direction").isin(FORWARD)
    verb = F.col("cue_spanish").rlike("(ar|er|ir)$")
    bad_en = fwd & verb & ~F.forall(F.coalesce(F.col("target_en"), F.array()),
                                    lambda t: t.startswith("to "))
    bad_de = fwd & F.exists(F.coalesce(F.col("target_de"), F.array()),
                            lambda t: t.rlike("^\\p{Lu}") & ~t.rlike("^(der|die|das) "))
    rules = F.array(F.when(bad_en, F.lit("en_verb_to")), F.when(bad_de, F.lit("de_noun_article")))
    return c.select("key", *ORDER, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def card_word(c: DataFrame) -> Column:
    """The Spanish word a card is about: forward cue or first reverse target."""
    return F.when(F.col("direction").isin(REVERSE), F.element_at(F.col("target_es"), 1)
                  ).otherwise(F.col("cue_spanish"))


def quality_counts(cards: DataFrame, lo: int = 2, hi: int = 8) -> DataFrame:
    """Q3: words with fewer than ``lo`` or more than ``hi`` cards, or without
    both a forward and a reverse card (partial aggregation per word)."""
    g = cards.select(card_word(cards).alias("word"), "direction").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_cards"),
        (F.count_if(F.col("direction").isin(FORWARD)) > 0).alias("has_forward"),
        (F.count_if(F.col("direction").isin(REVERSE)) > 0).alias("has_reverse"))
    return g.filter((F.col("n_cards") < lo) | (F.col("n_cards") > hi)
                    | ~F.col("has_forward") | ~F.col("has_reverse"))


def quality_symmetry(cards: DataFrame) -> DataFrame:
    """Q4: reverse cue not among forward targets, forward cue not among
    reverse targets (explode + distinct + left-anti, both ways)."""
    c = with_key(cards)
    fwd = c.filter(F.col("direction").isin(FORWARD))
    rev = c.filter(F.col("direction").isin(REVERSE))
    fwd_targets = fwd.select(F.explode("target_en").alias("t")).distinct()
    rev_targets = rev.select(F.explode("target_es").alias("t")).distinct()
    a = rev.join(fwd_targets, rev["cue_en"] == fwd_targets["t"], "left_anti").select(
        "key", *ORDER, F.lit("reverse_cue_not_in_forward_targets").alias("rule"))
    b = fwd.join(rev_targets, fwd["cue_spanish"] == rev_targets["t"], "left_anti").select(
        "key", *ORDER, F.lit("forward_cue_not_in_reverse_targets").alias("rule"))
    return a.unionByName(b)
