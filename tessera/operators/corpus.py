"""Corpus jobs: compaction batches, hard words, line / document dedup,
sections, prompts (A10 W5 O1 J11 C1 C2 C3 E12 W4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ustrip
from tessera.operators import terms
from tessera.operators.ordering import global_rank, with_previous

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
BATCH_SIZE = 10
COMPACT_INSTRUCTION = (
    "\nNow, based on the combined content of these 10 cheatsheets, create a single, compact "
    "cheatsheet that summarizes all the key information. Follow the same formatting and structure "
    "rules as before, but focus on condensing the information while retaining all important "
    "details. The output should be in markdown format. Do not add any explanations or extra text, "
    "just the markdown content of the compacted cheatsheet.\n    ")
HARD_WORDS = ("suponiendo, sorprendente, discretas, medida busca protegerla, conquistaron, "
              "relacionados, fuente, dispositivo, los aliados, ofrecer, conocida, fronterizo, apoyo, "
              "aparcamiento, señalar, además")
TOKEN = r"[\p{L}\p{N}]+"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
HEADING = r"^(#+)\s+(.*)$"
VOCAB_INTRO = ("I am going to provide a transcript of two speakers learning Spanish. Read it carefully. "
               "I will give you extraction instructions after the transcript.\n\n")
VOCAB_AFTER = "Now, based on the transcript above, strictly follow these instructions:\n\n"
SHEET_PREV = "The cheatsheet from the previous transcript is below. \n\n"
NO_PREVIOUS = "<no previous cheatsheet - this is the first transcript>"
SHEET_OUTRO = ("Now output the new cheatsheet in markdown format, following the exact structure and "
               "formatting rules provided. Do not add any explanations or extra text, just the "
               "markdown content of the cheatsheet.")
# ---------------------------------------------------------------------------


def hard_word_list() -> list[str]:
    return [w.strip() for w in HARD_WORDS.split(",") if w.strip()]


def compact_batches(sheets: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """A10 + W5 + O1: sheets in code-point name order, batches of 10, each sheet
    wrapped as ``<name>\\n...\\n</>\\n\\n`` and the instruction appended.

    Batches are cut from the global rank, so no task sees more than the ten
    sheets of a batch.  Deviation: the source stops after nine batches; here
    every sheet is compacted.
    """
    ranked = global_rank(sheets.select(name, text), [name])
    block = F.concat(F.lit("<"), F.col(name), F.lit(">\n"), F.col(text), F.lit("\n</>\n\n"))
    numbered = ranked.select(((F.col("rank") - 1) / BATCH_SIZE).cast("bigint").alias("batch"), "rank", block.alias("b"))
    return numbered.groupBy((F.col("batch") + 1).alias("batch")).agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))),
                                          lambda s: s["b"]), ""), F.lit(COMPACT_INSTRUCTION)).alias("text"),
        F.count(F.lit(1)).alias("n_sheets")
    ).select(F.concat(F.lit("compacted_"), F.col("batch").cast("string"), F.lit(".md")).alias("out_name"),
             "batch", "text", "n_sheets")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def token_text(text: Column) -> Column:
    """Lower-cased tokens separated by single spaces (same tokens as ``tokens``)."""
    return F.trim(F.regexp_replace(F.lower(text), TOKEN_SPLIT, " "))


def hard_words(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, n): how often the terms of ``words(term)``, single words
    or phrases of any length, occur in each document (overlaps count).  Terms
    are compared as tokens, so case, punctuation and inner spaces do not
    matter.  An empty list and null texts find nothing."""
    listed = words.select(token_text(F.col("term")).alias("term")).filter(F.col("term") != "")
    return terms.count_terms(docs, key, token_text(F.col(text)), listed)


def gloss(docs: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """The text with ``||(gloss)||`` after every list term that has a gloss
    in ``words(term, gloss)``; of overlapping terms the first, and of those that
    begin together the longest, wins.  Documents without a term and null texts
    are returned unchanged; of several glosses of a term the smallest counts."""
    own = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    listed = words.filter(F.coalesce(ustrip(F.col("gloss")), F.lit("")) != "").select(
        F.array_join(F.transform(own(F.col("term")), lambda t: F.lower(t)), " ").alias("term"), F.col("gloss").alias("note"))
    return terms.annotate(docs, text, listed.filter(F.col("term") != ""), gloss_mark)


def gloss_mark(note: str) -> str:
    return f" ||({note})||"


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First occurrence of each normalised (stripped, lower-case) line and
    its copy count.  ``min``/``count`` aggregate map-side, so a line repeated
    in a third of the corpus costs one partial row per task."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    lines = lines.select(key, F.col("pos").cast("bigint").alias("pos"),
                         F.lower(ustrip(F.col("line"))).alias("norm")).filter(F.col("norm") != "")
    return lines.groupBy("norm").agg(F.min(F.struct(key, "pos")).alias("f"),
                                     F.count(F.lit(1)).alias("copies")) \
        .select("norm", F.col(f"f.{key}").alias("first_doc"), F.col("f.pos").alias("first_pos"), "copies")


def doc_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact duplicate texts: kept id (smallest) and number of copies.

    Grouped on SHA-256 of the text (32 bytes shuffled instead of the text; a
    64-bit hash would collide at billions of documents)."""
    return docs.groupBy(F.sha2(F.col(text), 256).alias("h")).agg(
        F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("copies")).drop("h")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Markdown sections per document: heading level and title, first line
    and number of lines; lines before the first heading form section 0.  All
    within the document's own row."""
    lines = docs.select(key, F.split(F.col(text), "\n").alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
                     lambda h: h["line"].rlike(HEADING))
    staged = lines.select(key, F.size("_lines").alias("_n"), heads.alias("_heads"))
    first = F.coalesce(F.get("_heads", F.lit(0))["at"], F.col("_n"))

    def section(at, level, title, until):
        return F.struct(at.cast("bigint").alias("start_line"), level.cast("bigint").alias("level"), title.alias("title"),
                        (until - F.greatest(at, F.lit(0))).cast("bigint").alias("n_lines"))

    headed = F.transform("_heads", lambda h, i: section(
        h["at"], F.length(F.regexp_extract(h["line"], HEADING, 1)), F.regexp_extract(h["line"], HEADING, 2),
        F.coalesce(F.get("_heads", i + 1)["at"], F.col("_n"))))
    before = F.filter(F.array(section(F.lit(-1), F.lit(0), F.lit(""), first)), lambda s: s["n_lines"] > 0)
    return staged.select(key, F.explode(F.concat(before, headed)).alias("s")).select(key, "s.*")


def vocab_prompt(transcript: Column, rules: str) -> Column:
    """E12 (vocabulary): the transcript sandwiched between intro and rules."""
    return F.concat(F.lit(VOCAB_INTRO + "<transcript>\n"), transcript,
                    F.lit("\n</transcript>\n\n" + VOCAB_AFTER + rules))


def sheet_prompt(transcript: Column, previous: Column, filename: Column, rules: str) -> Column:
    """E12 (chained cheatsheet): with the previous sheet or the first-sheet marker."""
    return F.concat(F.lit(VOCAB_INTRO + "<transcript>\n"), transcript,
                    F.lit("\n</transcript>\n\n" + SHEET_PREV + "<cheatsheet>\n"),
                    F.coalesce(previous, F.lit(NO_PREVIOUS)),
                    F.lit("\n</cheatsheet>\n\nNow, based on the transcript above (from "), filename,
                    F.lit(") and the current cheatsheet content, strictly follow these instructions:\n\n"
                          + rules + SHEET_OUTRO))


def prompts(files: DataFrame, rules: str, skip_vocab: str = "track01.txt") -> DataFrame:
    """E12 + W4 + S3: both prompts per file in name order; the vocabulary job
    skips ``track01.txt``; the previous sheet is the file before in name
    order (found by global rank + equi-join, not a one-task window)."""
    prev = with_previous(files, ["name"], ["sheet"])
    return prev.select(
        "name",
        F.when(F.col("name") != skip_vocab, vocab_prompt(F.col("text"), rules)).alias("vocab_prompt"),
        sheet_prompt(F.col("text"), F.col("prev_sheet"), F.col("name"), rules).alias("sheet_prompt"))
