"""Helpers to write the DuckDB oracle SQL.

The oracles restate the semantics in plain SQL with a *different* algorithm
where possible (e.g. window functions instead of folds), so a match is a real
cross-check of the Spark plan.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values of the oracle.  They restate what the output must be and are
# kept apart from the code under test on purpose: a wrong value there shows.
# ---------------------------------------------------------------------------
class H:
    BODY_PATTERNS = [
        '<article[^>]*>(.*?)</article>',
        '<div[^>]*data-component="article-body"[^>]*>(.*?)</div>',
        '<section[^>]*id="body-content"[^>]*>(.*?)</section>',
    ]
    DROP_ELEMENTS = [
        'script',
        'style',
        'nav',
        'footer',
        'aside',
        'form',
    ]
    DROP_CLASSES = [
        'sidebar',
        'related',
        'mas-leidas',
        'más-leídas',
        'recommended',
    ]
    ENTITIES = [
        ('&amp;', '&'),
        ('&lt;', '<'),
        ('&gt;', '>'),
        ('&quot;', '"'),
        ('&#39;', "'"),
        ('&ntilde;', 'ñ'),
        ('&Ntilde;', 'Ñ'),
        ('&uuml;', 'ü'),
        ('&aacute;', 'á'),
        ('&eacute;', 'é'),
        ('&iacute;', 'í'),
        ('&oacute;', 'ó'),
        ('&uacute;', 'ú'),
        ('&iexcl;', '¡'),
        ('&iquest;', '¿'),
    ]
    SKIP_PHRASES = [
        'Fuente de la imagen',
        'Pie de foto',
        'Suscríbete aquí',
        'También puedes seguirnos',
        'Y recuerda que puedes recibir',
        'Haz clic aquí',
        'Más leídas',
        'Final de Más leídas',
        'Información del artículo',
        'Episodios',
        'Para ver este contenido',
        'Play video',
        'Título del video',
        'Duración',
        'Tiempo de lectura',
        'Actualizado',
    ]
    SKIP_PREFIXES = [
        'Autor,',
        'Título del autor,',
        'https://www.bbc.com/mundo/',
    ]
    FALLBACK_PATTERN = '<main[^>]*>(.*?)</main>'
    BLOCK_TAGS = 'p|div|br|h[1-6]|li|blockquote'
    MOST_READ_OPEN = 'Más leídas'
    MOST_READ_CLOSE = 'Final de Más leídas'
    PODCAST_OPEN = 'El nuevo podcast de BBC Mundo'
    PODCAST_CLOSE = 'Fin de Podcast'
    DATE_LINE = '^\\d{1,2}\\s+\\w+\\s+\\d{4}$'
    DURATION_LINE = '^\\d{1,2}:\\d{2}$'
    SALTAR = 'Saltar\\s+\\w+[\\s\\w]*y continuar leyendo'
    PARA_VER = 'Para ver este contenido[^\\n<]*'


PY_SPACE_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}"
                  r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
PY_WORD_CLASS = r"[\p{L}\p{N}_]"
PY_LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
# ---------------------------------------------------------------------------


def py_regex(pattern: str) -> str:
    """Python's Unicode ``\\s``, ``\\w`` and ``\\d`` as explicit classes."""
    both = "[" + PY_SPACE_CLASS[1:-1] + PY_WORD_CLASS[1:-1] + "]"
    for short, long in ((r"[\s\w]", both), (r"\s", PY_SPACE_CLASS), (r"\w", PY_WORD_CLASS), (r"\d", r"\p{Nd}")):
        pattern = pattern.replace(short, long)
    return pattern



def lit(s: str) -> str:
    """DuckDB string literal (no backslash escapes in DuckDB strings)."""
    return "'" + s.replace("'", "''") + "'"


def sql_text(s: str) -> str:
    """A string that may contain newlines, as a DuckDB expression."""
    parts = s.split("\n")
    return " || chr(10) || ".join(lit(p) for p in parts) if len(parts) > 1 else lit(s)


def ustrip(expr: str) -> str:
    return f"regexp_replace({expr}, {lit('^' + PY_SPACE_CLASS + '+|' + PY_SPACE_CLASS + '+$')}, '', 'g')"


def split_lines(expr: str) -> str:
    """``str.splitlines()``: split, then drop the piece after a final break."""
    arr = f"regexp_split_to_array({expr}, {lit(PY_LINE_BREAK)})"
    return (f"(CASE WHEN regexp_matches({expr}, {lit('(?:' + PY_LINE_BREAK + ')$')}) "
            f"THEN {arr}[1:len({arr})-1] ELSE {arr} END)")


def extract_body(html: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({html}, {lit('(?is)' + p)}) THEN regexp_extract({html}, {lit('(?is)' + p)}, 1)"
        for p in H.BODY_PATTERNS)
    fb = lit("(?is)" + H.FALLBACK_PATTERN)
    main = f"(CASE WHEN regexp_matches({html}, {fb}) THEN regexp_extract({html}, {fb}, 1) END)"
    return f"coalesce(nullif(CASE {whens} END, ''), nullif({main}, ''))"


def strip_markup(body: str) -> str:
    # RE2 has no back-references: one alternative per paired element.
    drop = "|".join(f"<{t}[^>]*>.*?</{t}>" for t in H.DROP_ELEMENTS)
    classes = "|".join(H.DROP_CLASSES)
    steps = [
        ("(?is)" + drop, "''"),
        ("(?s)<!--.*?-->", "''"),
        ("(?is)<aside[^>]*>.*?</aside>", "''"),
        ("(?is)" + f'<div[^>]*class="[^"]*(?:{classes})[^"]*"[^>]*>.*?</div>', "''"),
        ("(?i)" + py_regex(H.SALTAR), "''"),
        ("(?i)" + H.PARA_VER, "''"),
        (f"(?i)<({H.BLOCK_TAGS})[^>]*>", "chr(10)"),
        ("<[^>]+>", "''"),
    ]
    e = body
    for pat, rep in steps:
        e = f"regexp_replace({e}, {lit(pat)}, {rep}, 'g')"
    e = f"replace({e}, chr(160), ' ')"
    for ent, ch in H.ENTITIES:
        e = f"replace({e}, {lit(ent)}, {lit(ch)})"
    return f"regexp_replace({e}, ' {{2,}}', ' ', 'g')"


def is_noise(t: str) -> str:
    conds = [f"contains({t}, {lit(p)})" for p in H.SKIP_PHRASES]
    conds += [f"starts_with({t}, {lit(p)})" for p in H.SKIP_PREFIXES]
    conds += [f"regexp_matches({t}, {lit(py_regex(H.DATE_LINE))})",
              f"regexp_matches({t}, {lit(py_regex(H.DURATION_LINE))})", f"{t} = ''"]
    return "(" + " OR ".join(conds) + ")"


def clean_text_ctes(src: str, key: str, text_expr: str, prefix: str = "ct") -> tuple[str, str]:
    """CTEs that turn ``text_expr`` of ``src`` into kept lines, window-based.

    Returns (cte_sql, name_of_final_cte) with columns (key, text) where text
    is null when nothing is kept.
    """
    mr_open = f"(contains(t, {lit(H.MOST_READ_OPEN)}) AND NOT contains(t, {lit(H.MOST_READ_CLOSE)}))"
    mr_close = f"contains(t, {lit(H.MOST_READ_CLOSE)})"
    pod_open = f"contains(t, {lit(H.PODCAST_OPEN)})"
    pod_close = f"contains(t, {lit(H.PODCAST_CLOSE)})"
    w = f"PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ctes = f"""
{prefix}_raw AS (SELECT {key}, {text_expr} AS raw FROM {src}),
{prefix}_arr AS (SELECT {key}, {split_lines('raw')} AS arr FROM {prefix}_raw WHERE raw IS NOT NULL),
{prefix}_lines AS (
  SELECT {key}, generate_subscripts(arr, 1) AS i, {ustrip('unnest(arr)')} AS t FROM {prefix}_arr),
{prefix}_mr AS (
  SELECT *, {mr_open} AS mo,
    coalesce(last_value(CASE WHEN {mr_open} THEN true WHEN {mr_close} THEN false END IGNORE NULLS)
             OVER ({w}), false) AS mr_before
  FROM {prefix}_lines),
{prefix}_pod AS (
  SELECT *, coalesce(last_value(CASE WHEN {pod_open} THEN true WHEN {pod_close} THEN false END IGNORE NULLS)
             OVER ({w}), false) AS pod_before
  FROM {prefix}_mr WHERE NOT (mo OR mr_before)),
{prefix}_kept AS (
  SELECT {key}, i, t FROM {prefix}_pod
  WHERE NOT ({pod_open} OR pod_before) AND NOT {is_noise('t')}),
{prefix}_text AS (
  SELECT r.{key}, nullif(string_agg(k.t, chr(10) ORDER BY k.i), '') AS text
  FROM {prefix}_raw r LEFT JOIN {prefix}_kept k ON r.{key} = k.{key}
  GROUP BY r.{key})"""
    return ctes, f"{prefix}_text"


def pages_text_ctes(prefix: str = "pt") -> tuple[str, str]:
    """CTEs producing (page_id, text) for the ``pages`` table."""
    body = f"{prefix}_body"
    ctes = f"{body} AS (SELECT page_id, {extract_body('html')} AS body FROM pages)"
    more, final = clean_text_ctes(body, "page_id", strip_markup("body"), prefix)
    # pages without a body keep a null text
    ctes += "," + more + f""",
{prefix}_out AS (SELECT b.page_id, x.text FROM {body} b LEFT JOIN {final} x ON b.page_id = x.page_id)"""
    return ctes, f"{prefix}_out"
