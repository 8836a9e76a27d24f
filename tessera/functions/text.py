"""Text column helpers that reproduce Python string semantics in JVM code.

All helpers return ``Column`` expressions (no UDFs), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's ``str.strip()`` removes (``str.isspace()``).  Spark's
# ``trim`` only removes U+0020, so it cannot be used for Python parity.  The
# ``\x{..}`` / ``\p{..}`` syntax is understood by Java regex and RE2 alike.
PY_SPACE_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}"
                  r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Python's Unicode ``\w`` and ``\d`` for str patterns.
PY_WORD_CLASS = r"[\p{L}\p{N}_]"
PY_DIGIT = r"\p{Nd}"
# Line boundaries of Python's ``str.splitlines()``.
PY_LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def py_regex(pattern: str) -> str:
    r"""Rewrite Python ``\s \w \d`` into explicit Unicode classes (Java + RE2).

    ``[\s\w]`` is flattened into one class (RE2 has no nested classes)."""
    flat = "[" + PY_SPACE_CLASS[1:-1] + PY_WORD_CLASS[1:-1] + "]"
    return (pattern.replace(r"[\s\w]", flat).replace(r"\s", PY_SPACE_CLASS)
            .replace(r"\w", PY_WORD_CLASS).replace(r"\d", PY_DIGIT))


# The same set as plain characters: exactly the 29 code points for which
# Python's ``str.isspace()`` is true.
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                  + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def ustrip(c: Column) -> Column:
    r"""Python ``str.strip()`` (Unicode whitespace incl. U+001C-U+001F).

    A character-set ``trim`` (no regex: a trailing ``\s+$`` regex rescans
    every whitespace run of a long text)."""
    return F.trim(c, F.lit(PY_SPACE_CHARS))


def splitlines(c: Column) -> Column:
    """Python ``str.splitlines()`` without the trailing empty element."""
    parts = F.split(c, PY_LINE_BREAK)
    # Python drops the piece after a final line break; Spark keeps it as ''.
    return F.when(
        c.rlike(f"(?:{PY_LINE_BREAK})$"), F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)


def first_line(c: Column) -> Column:
    """``s.splitlines()[0]`` (null for an empty string) without splitting the whole text."""
    line = F.regexp_extract(c, r"^([^\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]*)", 1)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(line)


def truncate_text(c: Column, max_chars: int = 20000,
                  marker: str = "\n[... texto truncado ...]") -> Column:
    """Cut text longer than ``max_chars`` code points and add a marker."""
    return F.when(F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit(marker))
                  ).otherwise(c)


def file_stem(c: Column) -> Column:
    """Last path element without its extension (``a/b/track01.txt`` -> ``track01``)."""
    base = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^(.*)\.[^.]*$", 1)
                  ).otherwise(base)


def output_key(c: Column, suffix: str) -> Column:
    """Output file name for an input file: stem + suffix (``_vocab.json``, ``_cheat.md``)."""
    return F.concat(file_stem(c), F.lit(suffix))


def urlsafe_b64(c: Column) -> Column:
    """URL-safe base64 of the UTF-8 bytes (``base64.urlsafe_b64encode``).

    Spark's ``base64`` wraps lines with CRLF every 76 characters; remove them.
    """
    b64 = F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "\\r\\n", "")
    return F.translate(b64, "+/", "-_")


def cap(c: Column, n: int) -> Column:
    """Python ``s[:n]``."""
    return F.substring(c, 1, n)
