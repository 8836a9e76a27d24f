"""Main text of web pages by equivalence-class template deduction.

**Tokens.** A page is read as containers (block elements that hold other
blocks, named by their path of tag and class, e.g. ``body/div.ad``) and text
blocks.  A token is a container path, or a text block together with its path.

**Classes.** A token's occurrence vector over the pages of its host is folded
into one number (two 30-bit sums of hash(page, count), in which repeated rows
do not cancel), so equal vectors are equal numbers and the vectors of a hot
host are built by a map-side aggregate; no task ever holds the pages of a host.
Tokens of equal vector form a class.

**Template.** A class is valid when it occurs on at least ``MIN_PAGES`` pages
of the host and nests: a text belongs to the template of its container when it
is in the container's own class, i.e. it stands in that container on every
page and as often.  What remains in a container are its slots.  The host's
main slot is the container whose slots hold the most words outside links.

Copies of one article are no evidence: pages of equal texts count as one, and
the class must hold a container with a slot, or one that stands on
``MIN_PAGES`` pages whose longest other texts (half of the page) differ.

**Extraction.** The slots of the page's article (``article``, else ``main`` or
an element classed as such, else the host's main container, else the body) are
returned without the template's texts and without anything inside menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts,
styles and hidden elements.  Class and id words mark an element when a whole
class is such a word or ends in one (``user-comments``, ``sidebar-left``; not
``has-sidebar``, ``comments-open``); they do not hold for html, body and main,
nor for an article or what holds it unless there is another.  A page of which nothing would be left keeps the
texts that the template claimed (a host of identical pages).

Blocks have character references decoded, white space turned into one space
and no space at the ends; empty blocks go, the others are joined by two
newlines.  Null and empty pages give an empty text; broken, cut off or very
long markup is read as far as it goes; a null url is the host ``''``.  Repeated
rows each get their text and are one page as evidence; empty tables give no
rows; other columns are kept.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialize, neutral, prepare
from tessera.llm.url_filter import host_of

MIN_PAGES = 5
REST = 16  # so many of the longest texts tell two articles apart
_30_BITS = (1 << 30) - 1

# HTML element names, and class or id words that mark what is not the article.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead title tr ul""".split())
CONTAINERS = frozenset("""article aside blockquote body center dialog div fieldset figure footer form head header html
main menu nav ol section table title ul""".split())
RAW = frozenset("script style textarea title xmp".split())  # text up to the closing tag, or to the end
SKIPPED = frozenset("iframe noscript template svg math object canvas select button".split())  # nest, and end with their parent
DROPPED = frozenset("aside dialog footer form head header menu nav title".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
UNWANTED = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist
consent cookie cookies disclaimer disqus feedback footer gdpr header login masthead menu modal nav navbar navigation
newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended
related replies reply respond reviews share sharing sidebar signup social sponsor sponsored subscribe subscription
toolbar topbar widget widgets""".split())
ITEMS = frozenset("""ad ads advert advertisement adverts comment comments commentlist disqus promo promoted promotion recommended
related replies reply respond reviews sponsor sponsored widget widgets""".split())  # such elements hold small articles of their own
STATES = frozenset("has have hide hides is no non not show shows with without".split())  # no-sidebar is no sidebar
PLACES = frozenset("""area areas article articles bar block bottom box button buttons container count form icons inner item items left
link links list message outer panel post posts right row section text title top wrap wrapper""".split())
# What becomes of a block: KEPT; in an article inside or marked as FRAME or ITEM, kept if there is no other; dropped
KEPT, FRAME_ARTICLE, ITEM_ARTICLE, FRAME, ITEM, GONE = range(6)
WANTED = frozenset("article articlebody content entry maincontent post story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in RAW}
_FOREIGN = frozenset(["svg", "math"])  # here "/>" closes an element
_HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


def _label(token: str) -> int:
    """KEPT, FRAME or ITEM by one class or id: its head word, before words of place, says what it is."""
    parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
    parts = [p.rstrip("0123456789") for p in parts if p and not p[0].isdigit()]
    if not parts or parts[0] in STATES:
        return KEPT
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    found = {parts[-1], "".join(parts)} & UNWANTED
    return KEPT if not found else ITEM if found & ITEMS else FRAME


@lru_cache(1 << 14)
def _describe(name: str, attrs: str) -> tuple[str, int, bool, bool]:
    """(path step, KEPT, FRAME, ITEM or GONE, wanted, article or main) of an element from its name and attributes."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
    label = f"{found.get('class', '')} {found.get('id', '')}"
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", label).lower()))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    state = max(map(_label, label.split()), default=KEPT)
    if name in ("html", "body", "main") or found.get("role") == "main":
        state = KEPT
    if name in DROPPED or hidden or found.get("role") in ROLES:
        state = GONE
    article = name in ("article", "main") or found.get("role") in ("main", "article")
    wanted = article or (state == KEPT and bool(words & WANTED))
    first = found.get("class", "").split()
    return (name + ("." + first[0] if first else "") + ("#" + re.sub(r"\d+", "0", found["id"]) if found.get("id") else ""),
            state, wanted and state != GONE, article)


def _state(inside: int, own: int, article: bool) -> int:
    """What becomes of the blocks of an element in another one."""
    if article and GONE not in (inside, own):
        soft = {FRAME: FRAME_ARTICLE, ITEM: ITEM_ARTICLE}
        return max(soft.get(inside, inside), soft.get(own, own))
    if inside in (FRAME_ARTICLE, ITEM_ARTICLE) and own:
        return GONE
    return max(inside, own)


class Block:
    """A text block: its container path, whether it is unwanted, how strongly it is the article's, words in links."""

    __slots__ = ("path", "unwanted", "rank", "text", "link_words")

    def __init__(self, path: str, unwanted: bool, rank: int, text: str, link_words: int):
        self.path, self.unwanted, self.rank, self.text, self.link_words = path, unwanted, rank, text, link_words


def _raw_end(page: str, at: int, name: str) -> int:
    close = _RAW_END[name].search(page, at)
    return close.end() if close else len(page)


def _skipped_ends(page: str) -> dict[int, int]:
    """Start -> end of the skipped elements of a page, in one pass.

    An element that is not closed before its parent ends at the next block,
    so a forgotten end tag takes no text of the article with it.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []  # open blocks and skipped elements
    count: Counter = Counter()
    at = foreign = 0
    waiting: list[int] = []  # skipped elements after which no block has begun or ended yet
    while m := _TAG.search(page, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        attrs = m[3] or m[6] or ""
        if not closing and attrs.endswith("/") and (name in _FOREIGN or foreign):
            continue
        if name in BLOCKS and not (foreign and name == "title"):
            for start in waiting:
                ends[start] = m.start()
            waiting.clear()
        if name in RAW and not closing:
            at = _raw_end(page, at, name)
        elif closing or (name in ("button", "select") and count[name]):  # these two end where another begins
            for k in range(len(stack) - 1, -1, -1) if count[name] else ():
                if stack[k][0] == name:
                    break
                if stack[k][0] in CONTAINERS and (not closing or name not in CONTAINERS and name not in SKIPPED):
                    k = -1  # it does not reach out of its container
                    break
            else:
                k = -1
            if k >= 0:
                start = stack[k][1]
                if name in SKIPPED:
                    if closing:
                        ends[start] = at
                    else:
                        ends.setdefault(start, m.start())
                    while waiting and waiting[-1] >= start:
                        waiting.pop()
                for gone, _ in stack[k:]:
                    count[gone] -= 1
                    foreign -= gone in _FOREIGN
                del stack[k:]
        if not closing and (name in SKIPPED or (name in BLOCKS and name not in RAW and name != "hr")):
            stack.append((name, m.start()))
            count[name] += 1
            foreign += name in _FOREIGN
            if name in SKIPPED:
                waiting.append(m.start())
    return ends


def read_page(page: str) -> tuple[list[Block], Counter]:
    """The text blocks of a page in order, and how often every container path opens."""
    blocks: list[Block] = []
    states: list[int] = []
    opened: Counter = Counter()
    # stack entries: (tag, path, state, rank); rank 2: inside article, 1: inside other wanted element
    stack: list[tuple[str, str, int, int]] = []
    parts: list[str] = []
    links = 0
    heading = in_link = False
    ends: dict[int, int] | None = None  # start -> end of skipped elements, when there are some

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                path, state, rank = stack[-1][1:] if stack else ("", KEPT, 0)
                if state and heading and rank == 2 and stack[-1][0] == "header":
                    state = stack[-2][2]  # the headline in an article's own header
                states.append(state)
                blocks.append(Block(path, False, rank, text, links))
            parts.clear()
        links = 0

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            parts.append(text)
            if in_link:
                links += len(text.split())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue  # comment or declaration
        closing = bool(m[1] or m[4])
        if name in RAW and not closing:
            if name in BLOCKS:
                end_block()
            at = _raw_end(page, at, name)
            continue
        if name in SKIPPED and not closing:
            if name not in _FOREIGN or not (m[3] or m[6] or "").endswith("/"):
                if ends is None:
                    ends = _skipped_ends(page)
                at = ends.get(m.start(), len(page))
            continue
        if name == "a":
            in_link = not closing
        if name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            continue
        end_block()
        heading = name in _HEADING and not closing
        if name not in CONTAINERS:
            if not closing and name not in _HEADING and name != "p":
                opened[(stack[-1][1] if stack else "") + "/" + name] += 1
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            in_link = False
            continue
        step, own, wanted, article = _describe(name, m[3] or m[6] or "")
        path, inside, rank = stack[-1][1:] if stack else ("", KEPT, 0)
        path = f"{path}/{step}" if len(stack) < 64 else path  # deeper nesting shares its ancestor's path
        opened[path] += 1
        rank = max(rank, 2 if name == "article" and own != GONE else int(wanted))
        stack.append((name, path, _state(inside, own, article), rank))
    end_block()
    keep = {KEPT}
    if not any(s == KEPT and b.rank == 2 for s, b in zip(states, blocks)):
        if FRAME_ARTICLE in states:
            keep.add(FRAME_ARTICLE)
        elif KEPT not in states:
            keep.add(ITEM_ARTICLE)
    for s, b in zip(states, blocks):
        b.unwanted = s not in keep
    return blocks, opened


def _text_key(block: Block) -> int:
    return xxhash.xxh64_intdigest(block.text) >> 1


_TOKEN = {"host": "string", "page": "long", "path": "string", "text_key": "long", "n": "long", "words": "long",
          "blocks": "long", "body": "long", "rest": "long"}


def _digest(keys: list[int]) -> int:
    return xxhash.xxh64_intdigest(b"".join(k.to_bytes(8, "little") for k in keys)) >> 1


def _longest_outside(longest: list[tuple[str, int, int]], path: str, size: int) -> list[int]:
    """Keys of the longest texts outside a container that make up half of the ``size`` that stands there (at most ``REST``)."""
    out: list[int] = []
    left = size / 2
    for at, key, n in longest:
        if left <= 0 or len(out) == REST:
            break
        if at != path and not at.startswith(path + "/"):
            out.append(key)
            left -= n
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, pages = batch.column("host").to_pylist(), batch.column("page").to_pylist()
        rows = []
        for host, page, markup in zip(hosts, pages, batch.column("html").to_pylist()):
            blocks, opened = read_page(markup or "")
            words: Counter = Counter()
            texts: Counter = Counter()
            sizes: dict[int, int] = {}
            for b in blocks:
                if not b.unwanted:
                    key = _text_key(b)
                    words[b.path] += len(b.text.split()) - b.link_words
                    texts[b.path, key] += 1
                    sizes[key] = len(b.text)
            longest = sorted(((path, key, sizes[key] * n) for (path, key), n in texts.items()), key=lambda t: (-t[2], t[1]))
            under: Counter = Counter()  # blocks in a container or in one inside it
            inside: Counter = Counter()  # and the size of their texts
            for path, key, size in longest:
                n = texts[path, key]
                while path:
                    under[path] += n
                    inside[path] += size
                    path = path.rpartition("/")[0]
            total = sum(size for _, _, size in longest)
            body = _digest(sorted(key for (_, key), n in texts.items() for _ in range(n)))
            for path, n in opened.items():
                held = under[path]
                rest = _digest(_longest_outside(longest, path, total - inside[path])) if held else None
                rows.append((host, page, path, None, n, words[path], held, body if held else None, rest))
            rows += [(host, page, path, key, n, 0, n, None, None) for (path, key), n in texts.items()]
        cols = list(zip(*rows)) or [()] * len(_TOKEN)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(cols, _TOKEN.values())],
                                         names=list(_TOKEN))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, main_path, template_texts): one row per host."""
    prepare(pages.sparkSession)
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(url_col, html_col).alias("page"), F.col(html_col).alias("html"))
    tokens = arrow_map(rows, _tokens, ", ".join(f"{c} {k}" for c, k in _TOKEN.items()))
    mark = F.xxhash64("page", "n")
    sums = [F.sum(c).alias(c) for c in ("low", "high", "words", "blocks")]
    # containers by distinct page texts, then by distinct surroundings; texts (that have the pages of their container) at once
    once = (tokens.groupBy("host", "path", "text_key", "body", "rest")
            .agg(F.count("*").alias("rows"), F.sum(mark.bitwiseAND(_30_BITS)).alias("low"),
                 F.sum(F.shiftrightunsigned(mark, 34)).alias("high"), F.sum("words").alias("words"), F.sum("blocks").alias("blocks"))
            .where(F.col("text_key").isNull() | (F.col("rows") >= min_pages))
            .groupBy("host", "path", "text_key", "rest").agg(F.count("body").alias("bodies"), *sums))
    seen = materialize(
        once.groupBy("host", "path", "text_key").agg(F.sum("bodies").alias("bodies"), F.count("rest").alias("rests"), *sums)
        .withColumn("vector", F.struct("low", "high")).drop("low", "high"), "page-tokens")
    holders = seen.where("text_key IS NULL")
    texts = seen.where("text_key IS NOT NULL").select("host", "vector", "text_key", F.col("path").alias("at"), "blocks")
    # the containers around a text that are in its class
    around = (texts.join(holders.where(F.col("bodies") >= min_pages)
                         .select("host", "vector", "path", F.col("blocks").alias("held"), "rests"), ["host", "vector"])
              .where((F.col("at") == F.col("path")) | F.col("at").startswith(F.concat("path", F.lit("/")))))
    # a slot: a container holds more than the texts of its class
    sound = (around.groupBy("host", "path", "held", "rests").agg(F.sum("blocks").alias("fixed"))
             .where((F.col("held") > F.col("fixed")) | (F.col("rests") >= min_pages))
             .select("host", "path", F.lit(True).alias("sound")))
    # a text nests in its container when both are in one class
    claimed = (around.join(sound, ["host", "path"], "left").groupBy("host", "at", "text_key")
               .agg(F.bool_or(F.col("at") == F.col("path")).alias("nests"), F.bool_or("sound").alias("sound")).where("nests AND sound")
               .groupBy("host").agg(F.sort_array(F.collect_set("text_key")).alias("template_texts")))
    main = holders.groupBy("host").agg(F.max(F.struct("words", "path"))["path"].alias("main_path"))
    return main.join(claimed, "host", "left")


def main_text(page: str, main_path: str | None, claimed: frozenset[int]) -> str:
    blocks = [b for b in read_page(page)[0] if not b.unwanted]
    best = max((b.rank for b in blocks), default=0)
    if best:
        chosen = [b for b in blocks if b.rank == best]
    else:
        inside = (main_path or "") + "/"
        chosen = [b for b in blocks if main_path and (b.path + "/").startswith(inside)] or blocks
    left = [b.text for b in chosen if not claimed or _text_key(b) not in claimed]
    return "\n\n".join(left or [b.text for b in chosen])


def _extract(markup: pa.Array, main_path: pa.Array, claimed: pa.Array) -> pa.Array:
    sets: dict[tuple, frozenset[int]] = {}
    out = []
    for page, path, keys in zip(markup.to_pylist(), main_path.to_pylist(), claimed.to_pylist()):
        known = tuple(keys or ())
        out.append(main_text(page or "", path, sets.setdefault(known, frozenset(known))))
    return pa.array(out, pa.string())


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``pages`` plus ``text`` (a column of that name is replaced)."""
    found = materialize(templates(pages, url_col, html_col, min_pages), "page-templates")
    run = F.arrow_udf(_extract, "string").asNondeterministic()
    plain, (url, markup) = neutral(pages, url_col, html_col)
    joined = plain.withColumn("host", host_of(F.col(url))).join(found, "host", "left")
    kept = [f"c{i}" for i, c in enumerate(pages.columns) if c != "text"]
    return joined.select(*kept, run(F.col(markup), "main_path", "template_texts").alias("text")).toDF(
        *[c for c in pages.columns if c != "text"], "text")
