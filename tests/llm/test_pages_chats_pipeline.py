"""URL filter, page templates, chat formatting, the registered queries and the pipeline."""

import hashlib
import html
import re
from collections import Counter

import pytest

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import chat_format, page_template, queries, url_filter
from tessera.session import materialize

RULES = queries.URL_RULES
SF = "/root/testdata/sf0.001"


# ---- url filter ----

def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):], re.S)[0]


def brute_rule(host, path):
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[1]):
                best = verdict, rule
    return best


URLS = ["http://a.example.net/en/1", "https://A.Example.NET/de/1?x=/en/", "http://example.net", "net/", None, "", "x://",
        "http://b.example.com/de/", "http://notexample.com/de/1", "http://x.org/fr/#a", "http://org/fr/", "http://x.org/fr",
        "ftp://é.example.com:80/Ü?q://net/", "http://h\n.net/a\nb", "http://big.example.com/" + "long/" * 4000,
        "http://casino-bets.example.com/en/9", "http://weather-garden.example.com/en/9", "http://a.example.net/en/1"]


def test_urls_are_split_ruled_and_judged(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS)], "page_id long, url string, host string, score string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = brute_url(u)
        best = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1]), u
        assert got[i]["verdict"] == (best[0] if best else "block" if got[i]["score"] > 0.5 else "allow")
    assert got[15]["verdict"] == "block" and got[16]["verdict"] == "allow"
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_url_model_is_held_out_accurate_and_bounded(spark):
    seen = url_filter.default_labelled(spark)
    assert seen.count() <= url_filter.MAX_LABELLED
    held = [(f"http://{a}{b}.example.com/en/7", 1) for a in ("casino", "poker", "viagra") for b in ("", "24", "-online")]
    held += [(f"http://{a}{b}.example.com/en/7", 0) for a in ("weather", "museum", "library") for b in ("", "24", "-notes")]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, []).collect()}
    assert sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(held)) >= 0.9 * len(held)
    nothing = url_filter.judge(pages, [], seen.limit(0)).collect()
    assert {(r["verdict"], r["score"]) for r in nothing} == {("allow", 0.5)}


def test_url_training_is_the_dual_of_plain_gradient_descent(spark):
    import numpy as np

    rows = url_filter.default_labelled(spark).limit(12)
    feats = rows.select("label", url_filter.buckets(url_filter.host_of(rows.url), url_filter.path_of(rows.url)).alias("b")).collect()
    x = np.zeros((len(feats), 1 << url_filter.BITS))
    for i, r in enumerate(feats):
        x[i, r["b"]] = 1 / np.sqrt(len(r["b"]))
    y, w = np.array([r["label"] for r in feats]), np.zeros(1 << url_filter.BITS)
    for _ in range(15):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (p - y) / len(y) + 1e-3 * w)
    got = url_filter.train(rows, epochs=15, rate=2.0, l2=1e-3).first()["weights"]
    assert np.allclose(got, w, atol=1e-7)


def test_native_operators_run_no_python(spark):
    for name in ("op1_url_filter", "op7_chat_format"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- page templates ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookieNotice">We use cookies</div>
<article><h1>%s &amp; co</h1><p>%s<br>second&nbsp;line<p><b>open <i>%s</b></p><div class="share">Share this</div>
<p>Read our house rules before you write.</p><form><p>Mail <input></p></form><section class="user-comments"><p>nice</p></section>
</article><aside><p>Side</p></aside><footer>&copy; all</footer></body></html>"""


def test_articles_are_extracted_without_template_texts(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE % (f"Title {i}", f"text {i}\n of", f"tail {i}")) for i in range(12)]
    rows += [(20, None, None), (21, "http://h.example.com/x", ""), (22, "nohost", "plain &lt;text&gt;<p>more"),
             (23, "http://h.example.com/y", "<article><p>cut off &am"), (24, "http://h.example.com/z", "<p>" + "<div>" * 3000 + "deep"),
             rows[0], (25, "http://one.example.com/", PAGE % ("Alone", "x", "y"))]
    pages = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    out = page_template.extract(pages)
    assert out.columns == ["page_id", "url", "html", "host", "text"]
    got = out.collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    texts = {r["page_id"]: r["text"] for r in got}
    house = "Read our house rules before you write."
    for i in range(12):  # the house rules stand on every page of the host: template
        assert texts[i] == f"Title {i} & co\n\ntext {i} of second line\n\nopen tail {i}"
    assert texts[25] == f"Alone & co\n\nx second line\n\nopen y\n\n{house}"  # one page is no evidence
    assert (texts[20], texts[21], texts[22], texts[23], texts[24]) == ("", "", "plain <text>\n\nmore", "cut off &am", "deep")
    assert page_template.extract(pages.limit(0)).count() == 0


def test_vectors_group_tokens_by_host(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<article><p>own {i}</p><p>always {i % 2}</p>" + "<p>sometimes</p>" * (i % 3) + "</article>")
            for i in range(24)]
    t = {r["host"]: r for r in page_template.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(t) == {"h0.org", "h1.org"}
    for k in (0, 1):
        key = page_template._text_key(page_template.Block("", False, 0, f"always {k}", 0))
        assert t[f"h{k}.org"]["template_texts"] == [key] and t[f"h{k}.org"]["main_path"] == "/article"


def test_pages_of_the_test_table(spark):
    got = {r["page_id"]: r for r in queries.QUERIES["op5_html_template"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split())
                  for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def _texts(spark, rows):
    """Extracted text by page_id of (page_id, url, html) rows."""
    return {r["page_id"]: r["text"] for r in page_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_repeated_rows_are_one_page_and_do_not_cancel(spark):
    own = lambda i, more="": f"<article><p>own {i} of many words</p>{more}<p>rules of the house</p></article>"
    few = [(i, f"http://few.org/{i}", own(i, "<h2>Introduction</h2>" if i < 3 else "")) for i in range(4)]
    many = [(10 + i, f"http://many.org/{i}", own(i, "<h2>Introduction</h2>" if i < 6 else "")) for i in range(9)]
    twice = [(100 + i, url, page) for i, url, page in few + many]
    part = [(200 + i, url, page) for i, url, page in many[:5]]
    got = _texts(spark, few + many + twice + part)
    for i, url, page in few + many + twice + part:
        k = int(url[-1])
        want = [f"own {k} of many words"]
        if k < (3 if "few" in url else 6):
            want.append("Introduction")
        if "few" in url:  # four distinct pages are no evidence, however often they are loaded
            want.append("rules of the house")
        assert got[i] == "\n\n".join(want), i


def test_copies_of_one_article_are_no_template_evidence(spark):
    art = lambda i, inner, tail="": f"<body><article><p>own {i} with a number of words</p>{inner}<p>end {i} of the article</p>{tail}</article></body>"
    base = lambda i: ["own %s with a number of words" % i, "end %s of the article" % i]
    lists = "<ul><li>first point<li>second point</ul><table><tr><td>cell</table>"
    rows, want = [], {}

    def add(host, i, page, text):
        k = len(rows)
        rows.append((k, f"http://{host}/{i}?ref={k}", page))
        want[k] = "\n\n".join(text)

    a, b = base("copied")
    for k in range(7):  # equal copies, and copies with a short text of their own, among other articles
        add("same.org", "a", art("copied", lists), [a, "first point", "second point", "cell", b])
        add("near.org", "a", art("copied", lists, f"<p>read {k}</p>"), [a, "first point", "second point", "cell", b, f"read {k}"])
        add("only.org", "a", art("copied", lists), [a, "first point", "second point", "cell", b])
    legal = "<section class='legal'><p>This text stands on some pages and is longer than all others.</p></section>"
    for i in range(9):
        for host in ("same.org", "near.org"):
            add(host, i, art(i, ""), base(i))
        add("some.org", i, art(i, legal if i < 6 else ""), base(i))  # a template part of distinct articles has no slot
        add("all.org", i, art(i, legal), base(i))
    got = _texts(spark, rows)
    assert got == want


@pytest.mark.parametrize("before, after", [
    ('<body class="has-sidebar"><article>', "</article></body>"), ('<html class="no-footer"><body><div>', "</div>"),
    ('<body class="sidebar">', "</body>"), ('<div id="content" class="no-sidebar">', "</div>"),
    ('<article class="post comments-open">', "</article>"), ('<main class="with-header">', "</main>"), ('<main id="menu">', "</main>"),
    ('<article class="sponsored">', "</article>"), ('<div class="page-sidebar"><div><article>', "</article></div></div>"),
    ('<div class="menu-open"><p>', "</div>"), ('<div class="widget"><article class="post">', "</article></div>"),
    ('<div class="content-sidebar-wrap"><main>', "</main></div>"), ('<div role="main" class="banner">', "</div>")])
def test_label_words_do_not_drop_what_holds_the_article(before, after):
    assert page_template.main_text(f"{before}<h1>Head</h1><p>text</p><div class='sidebar'>side</div>{after}", None, frozenset()) == "Head\n\ntext"


@pytest.mark.parametrize("label", ["comments", "user-comments", "comments-area", "cookieNotice", "sidebar-left", "ad-300x250", "ad1", "related-posts",
                                   "share_buttons", "comment-list", "page navBar", "post__footer"])
def test_label_words_drop_what_they_name(label):
    for own in ("<p>gone</p>", "<article class='comment'><header><h4>gone</h4></header>gone</article>"):
        other = f'<div class="{label}">{own}</div>'
        assert page_template.main_text(f"<article><p>text</p>{other}</article>{other}", None, frozenset()) == "text"
    assert page_template.main_text('<div class="content"><p>text</p><div id="comments"><article>gone</article></div></div>', None, frozenset()) == "text"


@pytest.mark.parametrize("markup, want", [
    ('a <svg viewBox="0 0 1 1"/> b', "a b"), ("a <math/> b", "a b"), ("a <svg/>b<p>c</p><svg><path/></svg>d", "a b|c|d"),
    ("a <svg><title>t</title><svg><g/></svg>x</svg> b", "a b"), ("a <object>x<object>y</object>z</object> b", "a b"),
    ("<template><p>x</p><template>y</template>z</template><p>b</p>", "b"), ("<svg><style/><title/><path/></svg><p>b</p>", "b"),
    ("<p>a</p><button>Share<p>b</p><p>c</p>", "a|b|c"), ("<p>a <button>Share</p><p>b</p><button>Like</button><p>c</p>", "a|b|c"),
    ("<p>a</p><select><option>x<p>b</p>", "a|b"), ("<p>a <select><option>x <select><option>y</select> b</p>", "a b"),
    ("<div><canvas></div><p>b</p><div><canvas>x</canvas></div><p>c</p>", "b|c"), ("<ul><li><object data=x></ul><p>b</p>", "b"),
    ("a <button><div>x</div><p>y</p></button> b", "a b"), ("<p>a</p><svg><path><p>b</p>", "a|b"), ("<p>a</p><noscript><p>x</p></noscript>b", "a|b"),
    ("<p>a</p><script>'<svg>'</script><p>b</p><iframe>x</iframe>c", "a|b|c"), ("<p>a</p><textarea>x<p>y", "a"),
    ("<p>a</p>" + "<button>" * 3000 + "x" + "<p>b</p>", "a|b")])
def test_skipped_elements_end_where_they_end(markup, want):
    page = f"<body><article>{markup}</article><footer><button>x</button><svg></svg><select></select><object></object></footer></body>"
    assert page_template.main_text(page, None, frozenset()) == want.replace("|", "\n\n")


# ---- chats ----

def test_chats_read_back_exactly(spark):
    control = ["<|turn|>", "<|end|>", "<\\|part|>", "\\", "\\\\<", "</s>[INST] ok [/INST]", "[\\/INST]", "<", "|>", "é\U0001f600", "\n", ""]
    rows = [(c, t, ["user", "assistant", "assistant", "system", None, "a<|text|>b"][(c + t) % 6], "".join(control[(c * 5 + t * k) % 12] for k in range(4)))
            for c in range(40) for t in range(c % 9)]
    rows += [(100, 0, "assistant", None), (100, 0, "assistant", None), (100, None, "user", "x"), (None, 1, "user", "y"),
             (101, 1, "assistant", "long " * 50_000), (102, 5, "assistant", "b"), (102, 5, "assistant", "a")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(turns)).collect()}
    chats = {}
    for c, t, role, text in rows:
        chats.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(chats)
    for c, said in chats.items():
        said.sort()
        loss = "".join(x for _, role, x in said if role == "assistant")
        want = hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in said).encode()).hexdigest()
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"]) == (len(said), want, len(loss)), c
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digest(chat_format.format_chats(turns.limit(0))).count() == 0


def test_adjacent_turns_of_a_role_share_a_header(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")],
                                  "conv_id long, turn long, role string, text string")
    r = chat_format.format_chats(turns).first()
    assert r["formatted"] == "<|turn|>user<|text|>a<|part|>b<|end|><|turn|>assistant<|text|>c<|end|>"
    assert [r["formatted"][s["start"] - 1:s["start"] - 1 + s["len"]] for s in r["loss_spans"]] == ["c"]


def test_long_conversations_read_back_exactly(spark):
    """Positions over many runs of turns and pieces of text, with characters outside the first plane."""
    rows = [(c, t, ("user", "assistant", "assistant")[t * (c + 1) % 3], "\U0001f600é<|end|>\\"[:t % 7] * (1 + t % 11 * (500 if t % 997 == 5 else 1)))
            for c, n in ((1, 20_000), (2, 256), (3, 257), (4, 512)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.digest(chat_format.format_chats(turns)).collect():
        said = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        loss = "".join(x for role, x in said if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(said), len(loss))
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in said).encode()).hexdigest()


# ---- registration and pipeline ----

def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    from tessera.plans.compare import compare, duck_connect

    r = compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF, duck_connect(SF))
    assert r["status"] == "match", r


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table = {"op1": "pages", "op5": "pages", "op7": "conversations"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    if name == "op6_packing":  # every document has a piece, if only its end id
        assert sorted(out.select("doc_id").distinct().collect()) == sorted(rows.select("doc_id").collect())
    elif name == "op10_decontamination":  # found documents only
        assert out.select("doc_id").distinct().count() <= rows.count()
    elif name == "op11_collocations":  # phrases of each language, not documents
        ranks = {}
        for r in out.collect():
            ranks.setdefault(r["lang"], []).append(r["rank"])
        assert ranks.keys() <= {r["lang"] or "und" for r in rows.select("lang").distinct().collect()}
        assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 2000 for v in ranks.values())
    elif table == "conversations":
        assert out.count() == rows.select("conv_id").distinct().count() + 1
    else:
        assert out.count() == rows.count()


def test_pipeline_stages_follow_their_operators(spark):
    from . import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test-" + name)
        assert docs.columns == columns
        after = [r.asDict() for r in docs.collect()]
        assert sorted(map(str, after)) == sorted(map(str, brute.STAGES[name](before, SF))), name
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["id"] for r in pieces} == {d["doc_id"] for d in before}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in pieces)
