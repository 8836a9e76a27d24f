"""Flash-card collection: notes, cards, models, decks, media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ustrip

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
FIELD_SEP = "\x1f"
DENY_FIELDS = ["Index", "word_audio", "sentence_audio"]
# ---------------------------------------------------------------------------


def note_deck(notes: DataFrame, cards: DataFrame, card_order: list[str]) -> DataFrame:
    """J1 + A6: one row per note that has cards; its deck is the deck of its
    first card in ``card_order`` (deviation V4: the source takes an arbitrary
    card).  Cards are reduced to one row per note *before* the join (partial
    aggregation), so the join is note-sized on both sides."""
    per_note = cards.groupBy("nid").agg(
        F.min(F.struct(*[F.col(c) for c in card_order], F.col("did"))).alias("_c"),
        F.count(F.lit(1)).alias("n_cards"))
    return notes.join(per_note, notes["id"] == per_note["nid"]).select(
        notes["*"], F.col("_c.did").alias("did"), "n_cards")


def split_fields(flds: Column) -> Column:
    """Fields split on U+001F (trailing empty fields kept, like Python)."""
    return F.split(flds, FIELD_SEP, -1)


def split_tags(tags: Column) -> Column:
    """``strip().split(" ")`` without blanks."""
    return F.filter(F.split(ustrip(F.coalesce(tags, F.lit(""))), " "), lambda t: t != "")


def note_text(field_names: Column, fields: Column, deny: list[str] = DENY_FIELDS) -> Column:
    """E15 + F7: ``name: value`` lines in model order; pairs beyond the
    shorter list are dropped (Python ``zip``), deny-listed names removed.
    Pass columns (e.g. the ``_names``/``_values`` staged by ``zip_fields``),
    not expressions: the lambda is interpreted and would re-evaluate them."""
    n = F.least(F.size(field_names), F.size(fields))
    pairs = F.arrays_zip(F.slice(field_names, 1, n).alias("name"), F.slice(fields, 1, n).alias("value"))
    kept = F.filter(pairs, lambda p: ~p["name"].isin(deny))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit(": "), p["value"])), "\n")


def with_model(notes: DataFrame, models: DataFrame) -> DataFrame:
    """Attach model field names; unknown models are dropped here and
    reported by ``collection_checks``."""
    return notes.join(models.select(F.col("mid").alias("_mid"), "field_names"),
                      notes["mid"] == F.col("_mid")).drop("_mid")


def collection_checks(notes: DataFrame, models: DataFrame, decks: DataFrame) -> DataFrame:
    """J2 + J3 + F6 as a violations table ``(note_id, rule)``: unknown model,
    unknown deck (left-anti joins) and notes that carry tags."""
    m = notes.join(models.select("mid"), "mid", "left_anti").select(
        F.col("id").alias("note_id"), F.lit("unknown_model").alias("rule"))
    d = notes.join(decks.select(F.col("deck_id").alias("did")), "did", "left_anti").select(
        F.col("id").alias("note_id"), F.lit("unknown_deck").alias("rule"))
    t = notes.filter(F.size(split_tags(F.col("tags"))) > 0).select(
        F.col("id").alias("note_id"), F.lit("has_tags").alias("rule"))
    return m.unionByName(d).unionByName(t)


def active_decks(notes_with_deck: DataFrame, decks: DataFrame) -> DataFrame:
    """F5 + A7: decks holding at least one note, with their note count."""
    counts = notes_with_deck.groupBy(F.col("did").alias("deck_id")).agg(F.count(F.lit(1)).alias("n_notes"))
    return decks.join(counts, "deck_id")


def media_manifest(collections: DataFrame, files: DataFrame) -> DataFrame:
    """J10 + M18: explode each collection's media map (id -> original name)
    and keep entries whose numbered file exists (equi-join on collection, id)."""
    m = collections.select("collection", F.explode("media").alias("id", "original_name"))
    return m.join(files.select("collection", "id"), ["collection", "id"])


def zip_fields(df: DataFrame, field_names: str = "field_names", flds: str = "flds") -> DataFrame:
    """Stage the zipped note fields as columns (Python ``zip`` truncates to
    the shorter side): ``_names``, ``_values`` and ``_rnames`` (names
    reversed).  Separate projections keep the interpreted lambdas of
    ``snapshot_fields`` / ``note_text`` from re-splitting the fields."""
    staged = df.withColumn("_vals", split_fields(F.col(flds)))
    n = F.least(F.size(field_names), F.size("_vals"))
    staged = staged.select("*", F.slice(field_names, 1, n).alias("_names"),
                           F.slice(F.col("_vals"), 1, n).alias("_values"))
    return staged.withColumn("_rnames", F.reverse("_names"))


def snapshot_fields(names: Column, values: Column, rnames: Column) -> Column:
    """``{name: value}`` in name order; a repeated name keeps its first
    position and its last value, like a Python dict built in order.  Takes
    the columns staged by ``zip_fields``."""
    keys = F.array_distinct(names)
    last = F.transform(keys, lambda k: F.element_at(
        values, F.size(names) - F.array_position(rnames, k).cast("int") + 1))
    return F.map_from_arrays(keys, last)


NOTE_PROMPT_MID = "\n\nHere is the note data:\n"   # fixed value
NOTE_PROMPT_END = "\n\nExtract the relevant information into a JSON format as per the instructions."


def note_prompt(rules: str, note_str: Column) -> Column:
    """E12 (note): extraction rules, the note text, closing instruction."""
    return F.concat(F.lit(rules + NOTE_PROMPT_MID), note_str, F.lit(NOTE_PROMPT_END))


DECKS_SCHEMA = "map<string, struct<id: bigint, name: string>>"
MODELS_SCHEMA = ("map<string, struct<id: bigint, name: string, flds: array<struct<name: string>>, "
                 "tmpls: array<struct<name: string, qfmt: string, afmt: string>>, css: string>>")


def collection_tables(col: DataFrame) -> dict[str, DataFrame]:
    """S4 + M16: decks and models from the collection's JSON maps.

    ``col(decks STRING, models STRING)``; one row per collection (a package),
    the maps are parsed with a typed schema and exploded, so each deck and
    model becomes a row.  Field names keep the order of ``flds``.
    """
    extra = [c for c in col.columns if c not in ("decks", "models")]
    decks = col.select(*extra, F.explode(F.from_json("decks", DECKS_SCHEMA)).alias("_k", "d")).select(
        *extra, F.col("d.id").alias("deck_id"), F.col("d.name").alias("deck_name"))
    models = col.select(*extra, F.explode(F.from_json("models", MODELS_SCHEMA)).alias("_k", "m")).select(
        *extra, F.col("m.id").alias("mid"), F.col("m.name").alias("model_name"),
        F.transform(F.coalesce(F.col("m.flds"), F.array()), lambda f: f["name"]).alias("field_names"),
        F.coalesce(F.col("m.css"), F.lit("")).alias("css"))
    return {"decks": decks, "models": models}
