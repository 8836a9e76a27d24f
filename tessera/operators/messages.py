"""Payload texts: headline, message templates, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import cap, ustrip

# ---------------------------------------------------------------------------
# Emoji, template words and caps.
# ---------------------------------------------------------------------------
NEWS = "📰"
LINK = "🔗"
WEBHOOK_TITLE = "Nueva historia de BBC Mundo"
ORIGINAL = "Artículo original"
TEASER_TAIL = "Haz clic para recibir la historia."
MESSAGE_CAP = 2000
THREAD_NAME_CAP = 100
# ---------------------------------------------------------------------------


def headline(title: Column) -> Column:
    """``📰 **title**`` with the title stripped."""
    return F.concat(F.lit(NEWS + " **"), ustrip(F.coalesce(title, F.lit(""))), F.lit("**"))


def message_texts(p: DataFrame) -> DataFrame:
    """E10 + E11 over payload rows (headline, summary, bullets, url, topic_title)."""
    h, s, b, u = (F.col(c) for c in ("headline", "summary", "bullets", "url"))
    nl2 = F.lit("\n\n")
    plain = F.concat(F.lit(NEWS + " *"), h, F.lit("*"), nl2, s, nl2, b, nl2, F.lit(LINK + " "), u)
    webhook = cap(F.concat(F.lit(f"{NEWS} *{WEBHOOK_TITLE}*"), nl2, h, nl2, s, nl2, b, nl2,
                           F.lit(LINK + " "), u), MESSAGE_CAP)
    thread = F.concat(F.lit("> "), s, nl2, b, nl2, F.lit(f"{LINK} [{ORIGINAL}]("), u, F.lit(")"))
    teaser = F.concat(F.lit(NEWS + " *"), h, F.lit("*"), nl2, F.lit(TEASER_TAIL))
    name = cap(ustrip(F.replace(F.replace(F.col("topic_title"), F.lit("**"), F.lit("")),
                                F.lit("*"), F.lit(""))), THREAD_NAME_CAP)
    return p.select(*[c for c in p.columns if c not in ("headline", "summary", "bullets", "url",
                                                         "topic_title")],
                    plain.alias("plain_text"), webhook.alias("webhook_text"),
                    thread.alias("thread_body"), teaser.alias("teaser"), name.alias("thread_name"))


def fill_template(template: str, **values: Column) -> Column:
    """``template.format(**values)`` as a column: the template (a job
    parameter) is split once on the driver into literal parts and
    placeholders, so inserted text is never substituted again; ``{{`` and
    ``}}`` are literal braces."""
    import string

    parts = []
    for lit, field, spec, conv in string.Formatter().parse(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported")
            parts.append(values[field].cast("string"))
    return F.concat(*parts) if parts else F.lit("")
