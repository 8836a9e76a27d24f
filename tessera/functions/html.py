"""Article extraction and HTML-to-text cleaning as one JVM-side projection.

``article_text(html)`` = body extraction (E2/E3) -> tag and clutter removal
(E4) -> entity decoding (E5) -> whitespace / line normalisation (E6) -> block
skipping (W3) -> noise-line filter (E7) -> date/duration lines (F8).

The chain is pure Column expressions (regexes and SQL higher-order
functions over the line array of one page), so a page never leaves its task and
the whole thing runs inside whole-stage codegen; no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import py_regex, splitlines, ustrip

# ---------------------------------------------------------------------------
# These must equal the source behaviour for identical output.
# ---------------------------------------------------------------------------
# Body patterns, tried in this order; the first that matches wins.
BODY_PATTERNS = [
    r"<article[^>]*>(.*?)</article>",
    r'<div[^>]*data-component="article-body"[^>]*>(.*?)</div>',
    r'<section[^>]*id="body-content"[^>]*>(.*?)</section>',
]
FALLBACK_PATTERN = r"<main[^>]*>(.*?)</main>"
# Elements removed together with their content.
DROP_ELEMENTS = ["script", "style", "nav", "footer", "aside", "form"]
# Class names whose div (up to the first closing div) is removed.
DROP_CLASSES = ["sidebar", "related", "mas-leidas", "más-leídas", "recommended"]
# Block tags replaced by a line break.
BLOCK_TAGS = "p|div|br|h[1-6]|li|blockquote"
# Named entities, decoded in this order (``&amp;`` first).
ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&ntilde;", "ñ"), ("&Ntilde;", "Ñ"), ("&uuml;", "ü"), ("&aacute;", "á"),
    ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"),
    ("&iexcl;", "¡"), ("&iquest;", "¿"),
]
# A line containing any of these phrases is dropped.
SKIP_PHRASES = [
    "Fuente de la imagen", "Pie de foto", "Suscríbete aquí", "También puedes seguirnos",
    "Y recuerda que puedes recibir", "Haz clic aquí", "Más leídas", "Final de Más leídas",
    "Información del artículo", "Episodios", "Para ver este contenido", "Play video",
    "Título del video", "Duración", "Tiempo de lectura", "Actualizado",
]
# A line starting with any of these prefixes is dropped.
SKIP_PREFIXES = ["Autor,", "Título del autor,", "https://www.bbc.com/mundo/"]
# Block markers: (open, close) for the two skipped blocks.
MOST_READ_OPEN, MOST_READ_CLOSE = "Más leídas", "Final de Más leídas"
PODCAST_OPEN, PODCAST_CLOSE = "El nuevo podcast de BBC Mundo", "Fin de Podcast"
# Standalone date line and duration line.
DATE_LINE = r"^\d{1,2}\s+\w+\s+\d{4}$"
DURATION_LINE = r"^\d{1,2}:\d{2}$"
SALTAR = r"Saltar\s+\w+[\s\w]*y continuar leyendo"
PARA_VER = r"Para ver este contenido[^\n<]*"
# ---------------------------------------------------------------------------

# Java regex flags: (?s) dot-all, (?i) case-insensitive, (?u) Unicode case
# folding.  Python's Unicode \s \w \d are spelled out by ``py_regex``.
_IS = "(?isu)"


def extract_body(html: Column) -> Column:
    """First matching body pattern (even if its body is empty), else ``<main>``.

    Returns null when nothing usable is found (``fetch_article`` -> None).
    """
    chain = None
    for pat in BODY_PATTERNS:
        p = _IS + pat
        cond = html.rlike(p)
        val = F.regexp_extract(html, p, 1)
        chain = F.when(cond, val) if chain is None else chain.when(cond, val)
    body = chain.otherwise(F.lit(None).cast("string"))
    fb = _IS + FALLBACK_PATTERN
    fallback = F.when(html.rlike(fb), F.regexp_extract(html, fb, 1))
    return F.coalesce(F.nullif(body, F.lit("")), F.nullif(fallback, F.lit("")))


def strip_markup(body: Column) -> Column:
    """E4 + E5 + space collapse: remove clutter and tags, decode entities."""
    h = body
    h = F.regexp_replace(h, _IS + rf"<({'|'.join(DROP_ELEMENTS)})[^>]*>.*?</\1>", "")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", "")
    h = F.regexp_replace(h, _IS + r"<aside[^>]*>.*?</aside>", "")
    classes = "|".join(DROP_CLASSES)
    h = F.regexp_replace(h, _IS + rf'<div[^>]*class="[^"]*(?:{classes})[^"]*"[^>]*>.*?</div>', "")
    h = F.regexp_replace(h, "(?iu)" + py_regex(SALTAR), "")
    h = F.regexp_replace(h, "(?iu)" + PARA_VER, "")
    h = F.regexp_replace(h, rf"(?iu)<({BLOCK_TAGS})[^>]*>", "\n")
    h = F.regexp_replace(h, r"<[^>]+>", "")
    h = F.replace(h, F.lit("\u00a0"), F.lit(" "))
    for ent, ch in ENTITIES:
        h = F.replace(h, F.lit(ent), F.lit(ch))
    return F.regexp_replace(h, " {2,}", " ")


def _is_noise(t: Column) -> Column:
    """E7 + F8 + empty: phrase, prefix, date line, duration line."""
    cond = F.lit(False)
    for p in SKIP_PHRASES:
        cond = cond | t.contains(p)
    for p in SKIP_PREFIXES:
        cond = cond | t.startswith(p)
    return (cond | t.rlike(py_regex(DATE_LINE)) | t.rlike(py_regex(DURATION_LINE))
            | (t == F.lit("")))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (lambda bodies re-run what they mention)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(lines: Column, opens, closes) -> Column:
    """Blocks of a line array (structs ``i``, ``t``) as (first, last) line numbers.

    Only marker lines are folded.  A block runs from an opening line to the
    next closing line, both included, or to the end."""
    block = "array<struct<a:int,b:int>>"
    state = f"struct<open:int,out:{block}>"
    start = F.struct(F.lit(None).cast("int").alias("open"), F.array().cast(block).alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        shut = F.struct(F.lit(None).cast("int").alias("open"), F.concat(s["out"], F.array(
            F.struct(s["open"].alias("a"), x["i"].alias("b")))).alias("out")).cast(state)
        begin = F.struct(x["i"].alias("open"), s["out"].alias("out")).cast(state)
        return F.when(s["open"].isNull() & opens(x["t"]), begin).when(s["open"].isNotNull() & closes(x["t"]), shut).otherwise(s)

    def finish(s: Column) -> Column:
        return F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(
            F.struct(s["open"].alias("a"), F.lit(2 ** 31 - 1).alias("b")))))

    marks = F.filter(lines, lambda x: opens(x["t"]) | closes(x["t"]))
    return F.aggregate(marks, start, step, finish)


def _outside(lines: Column, opens, closes) -> Column:
    """The lines that are in no block."""
    return _let(_blocks(lines, opens, closes), lambda found: F.filter(
        lines, lambda x: ~F.exists(found, lambda k: (x["i"] >= k["a"]) & (x["i"] <= k["b"]))))


def clean_lines(text: Column) -> Column:
    """E6 + W3 + E7 + F8: split into lines, strip each, leave out the two kinds
    of blocks and noise, and return the kept lines (array<string>).

    The most-read blocks are found first; the podcast blocks only see the
    lines those let through.  Everything stays inside the row of one text.
    """
    stripped = F.transform(splitlines(text), ustrip)
    numbered = F.transform(stripped, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    first = _let(numbered, lambda lines: _outside(
        lines, lambda t: t.contains(MOST_READ_OPEN) & ~t.contains(MOST_READ_CLOSE), lambda t: t.contains(MOST_READ_CLOSE)))
    second = _let(first, lambda lines: _outside(
        lines, lambda t: t.contains(PODCAST_OPEN), lambda t: t.contains(PODCAST_CLOSE) & ~t.contains(PODCAST_OPEN)))
    skipped = F.transform(second, lambda x: x["t"])
    # a text without an opening marker has no block
    has_marker = text.contains(MOST_READ_OPEN) | text.contains(PODCAST_OPEN)
    return F.filter(F.when(has_marker, skipped).otherwise(stripped), lambda t: ~_is_noise(t))


def html_to_text(body: Column) -> Column:
    """``_clean_html``: markup removal, then the kept lines joined by newline."""
    return F.array_join(clean_lines(strip_markup(body)), "\n")


def article_text(html: Column) -> Column:
    """Full page -> readable text; null when no body or nothing is left."""
    body = extract_body(html)
    text = html_to_text(body)
    return F.when(body.isNull(), F.lit(None).cast("string")).otherwise(F.nullif(text, F.lit("")))
