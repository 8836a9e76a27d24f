"""Chat formatting with Spark expressions only.

One row per conversation.  The turns of a conversation are collected as
structs and sorted by (turn, role, text); null texts and roles count as empty.
Adjacent turns of one role are merged under a single header by an array
aggregation; a part mark keeps the seam, so nothing is lost.

Template::

    <|turn|>role<|text|>text[<|part|>text ...]<|end|> ...

Texts and roles are escaped: first every backslash is doubled, then a single
backslash is put after the first character of every control string (anything
starting ``<|``, and the foreign marks ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``).  Doubling leaves runs of even length, so a single backslash in
that place can only be an escape and unescaping is exact.

The loss mask is an array of (start, length) code point spans of the formatted
string that cover the assistant texts and nothing between them.

Ties on ``turn`` are ordered by role, then text; repeated rows stay repeated
turns.  A null conversation id is a conversation of its own; an empty table
gives no rows.  The output row *is* the conversation, so a conversation is
the unit that must fit a task, and its cost grows with its turns and its text,
not with their square; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
_CONTROL = r"\||s>|/s>|INST\]|/INST\]"  # what may follow < or [ in a control string
LOSS_ROLE = "assistant"
RUN = 256  # turns whose positions are summed in one go
PIECE = 1024  # code points of a piece of a formatted string


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])({_CONTROL})", r"$1\\$2")


def unescape(c: Column) -> Column:
    plain = F.regexp_replace(c, rf"([<\[])\\({_CONTROL})", "$1$2")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start:int,len:int>>), start from 1."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    chats = chats.withColumn("_escaped", F.transform("_turns", lambda t: F.struct(
        t["role"].alias("role"), escape(t["role"]).alias("head"), escape(t["text"]).alias("text"))))
    n = F.size("_escaped")

    def segment(t: Column, i: Column) -> Column:
        # the mark before a text: a part mark inside a run of one role, else a header
        first = (i == 0) | (F.get("_escaped", i - 1)["role"] != t["role"])
        last = (i == n - 1) | (F.get("_escaped", i + 1)["role"] != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(TURN), t["head"], F.lit(TEXT))).otherwise(F.lit(PART)).alias("before"),
            t["text"].alias("text"), F.when(last, F.lit(END)).otherwise(F.lit("")).alias("after"),
            (t["role"] == loss_role).alias("loss"))

    # Positions are sums over the turns before: first inside runs of RUN turns, then over
    # the runs, since an array that grows turn by turn is copied for every turn.  (Spark
    # keeps a column that is used twice apart, so a run does not repeat what made it.)
    chats = chats.select("conv_id", F.transform("_escaped", segment).alias("_parts")).select(
        "conv_id",
        F.array_join(F.transform("_parts", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.transform("_parts", lambda p: F.struct(F.length(p["before"]).alias("before"), F.length(p["text"]).alias("text"),
                                                 F.length(p["after"]).alias("after"), p["loss"])).alias("_sizes"))
    spans = "array<struct<start:int,len:int>>"
    run_type = f"struct<size:int,spans:{spans}>"
    empty = F.struct(F.lit(0).alias("size"), F.array().cast(spans).alias("spans")).cast(run_type)

    def add(acc: Column, p: Column) -> Column:
        at = acc["size"] + p["before"]
        span = F.array(F.struct(at.alias("start"), p["text"].alias("len")))
        return F.struct((at + p["text"] + p["after"]).alias("size"),
                        F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")).cast(run_type)

    last = F.floor((F.size("_sizes") - 1) / RUN).cast("int")
    chats = chats.withColumn("_runs", F.transform(F.sequence(F.lit(0), last), lambda r: F.aggregate(
        F.slice("_sizes", r * RUN + 1, RUN), empty, add)))
    starts = F.aggregate("_runs", F.array(F.lit(1)), lambda acc, r: F.concat(
        acc, F.array(F.element_at(acc, -1) + r["size"])))
    return chats.select("conv_id", "formatted", F.flatten(F.zip_with(
        F.slice(starts, 1, F.size("_runs")), "_runs", lambda at, r: F.transform(
            r["spans"], lambda s: F.struct((at + s["start"]).alias("start"), s["len"].alias("len"))))).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of every original turn, parsed from the formatted string."""
    def parts(block: Column) -> Column:
        role = F.substring_index(block, TEXT, 1)
        body = F.substring(block, F.length(role) + F.lit(len(TEXT) + 1), F.length(block))
        body = F.substring_index(body, END, 1)
        return F.transform(F.split(body, r"<\|part\|>", -1), lambda t: F.struct(
            unescape(role).alias("role"), unescape(t).alias("text")))
    pieces = F.split(formatted, r"<\|turn\|>", -1)
    blocks = F.slice(pieces, F.lit(2), F.size(pieces))
    return F.flatten(F.transform(blocks, parts))


def pieces(formatted: Column) -> Column:
    """The string in pieces of PIECE code points, to reach a position without walking there."""
    return F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), 0)


def loss_text(pieces: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order, with nothing between.

    ``pieces`` must be a column, not an expression, or every span cuts the string again."""
    def cut(s: Column) -> Column:
        first = F.floor((s["start"] - 1) / PIECE).cast("int")
        upto = F.least(F.ceil((s["start"] - 1 + s["len"]) / PIECE).cast("int"), F.size(pieces))
        held = F.array_join(F.slice(pieces, first + 1, F.greatest(upto - first, F.lit(0))), "")
        return unescape(F.substring(held, F.pmod(s["start"] - 1, F.lit(PIECE)) + 1, s["len"]))
    return F.array_join(F.transform(spans, cut), "")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what ``read_back`` and the loss mask give."""
    c = chats.withColumns({"_turns": read_back(F.col("formatted")), "_pieces": pieces(F.col("formatted"))}).withColumn(
        "_loss", loss_text(F.col("_pieces"), F.col("loss_spans")))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select("conv_id", F.size("_turns").cast("long").alias("n_turns"),
                    F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
