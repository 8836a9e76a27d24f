"""Golden cases for article extraction and cleaning (FIXTURES 1.2)."""

from pyspark.sql import functions as F

from conftest import one_col
from tessera.functions.html import extract_body, html_to_text
from tessera.operators.pagetext import pages_to_text


def clean(spark, html):
    return one_col(spark, html_to_text(F.col("x")), html)


def test_strip_tags(spark):
    assert clean(spark, "<p>Hello <strong>world</strong></p>") == "Hello world"


def test_nested_blocks(spark):
    html = "<div><p>Para1 <span><b>bold</b></span></p><p>Para2</p></div>"
    assert clean(spark, html) == "Para1 bold\nPara2"


def test_nav_removed(spark):
    out = clean(spark, "<nav>Navigation</nav><article>Content</article>")
    assert "Navigation" not in out and "Content" in out


def test_entities(spark):
    out = clean(spark, "&aacute; &eacute; &iacute; &oacute; &uacute; &ntilde; &iquest; &iexcl;")
    assert out == "á é í ó ú ñ ¿ ¡"


def test_double_decode_and_nbsp(spark):
    assert clean(spark, "<p>a &amp;lt; b c &nbsp;</p>") == "a < b c &nbsp;"


def test_no_blank_lines(spark):
    assert clean(spark, "<p>Para1</p>\n\n<p></p>\n\n<p>Para2</p>") == "Para1\nPara2"


def test_empty(spark):
    assert clean(spark, "") == ""


def test_body_patterns(spark):
    def body(h):
        return one_col(spark, extract_body(F.col("x")), h)
    assert body("<html><article class='x'>A</article></html>") == "A"
    assert body('<div data-component="article-body">B</div>') == "B"
    assert body('<section id="body-content">C</section>') == "C"
    assert body("<div>nothing</div>") is None
    assert body("<main>M</main>") == "M"
    # the first matching pattern wins even when empty -> fallback, not pattern 2
    assert body('<article></article><div data-component="article-body">B</div><main>M</main>') == "M"


def test_noise_blocks_and_lines(spark):
    text = "\n".join([
        "<p>keep 1", "<p>Más leídas", "<p>hidden a", "<p>Final de Más leídas", "<p>keep 2",
        "<p>El nuevo podcast de BBC Mundo", "<p>hidden b", "<p>Fin de Podcast", "<p>keep 3",
        "<p>Pie de foto, x", "<p>Autor, y", "<p>12 mayo 2024", "<p>02:27", "<p>Saltar Más y continuar leyendo",
        "<p>keep 4"])
    assert clean(spark, text) == "keep 1\nkeep 2\nkeep 3\nkeep 4"


def test_coupled_blocks(spark):
    # a most-read block opened inside a podcast block consumes the podcast close
    lines = ["<p>a", "<p>El nuevo podcast de BBC Mundo", "<p>Más leídas", "<p>Fin de Podcast",
             "<p>Final de Más leídas", "<p>b", "<p>Fin de Podcast", "<p>c"]
    assert clean(spark, "\n".join(lines)) == "a\nc"


def test_unclosed_block_drops_rest(spark):
    assert clean(spark, "<p>a<p>Más leídas hoy<p>b<p>c") == "a"


def test_pages_to_text_null_when_no_body(spark):
    df = spark.createDataFrame([(1, "<div>x</div>"), (2, "<article><p>Hi</p></article>"),
                                (3, "<article><script>x</script></article>")], "page_id long, html string")
    got = {r.page_id: r.text for r in pages_to_text(df).collect()}
    assert got == {1: None, 2: "Hi", 3: None}


def test_column_form_and_line_rows_agree_with_staged(spark):
    from tessera.functions.html import article_text
    from tessera.operators.pagetext import page_lines
    from tessera.sources.tables import Tables
    pages = Tables(spark, "/root/testdata/sf0.001").pages
    staged = {r.page_id: r.text for r in pages_to_text(pages).collect()}
    column = {r.page_id: r.t for r in pages.select("page_id", article_text(F.col("html")).alias("t")).collect()}
    assert staged == column
    rows = {}
    for r in page_lines(pages).orderBy("page_id", "line_no").collect():
        rows.setdefault(r.page_id, []).append(r.line)
    assert {k: "\n".join(v) for k, v in rows.items()} == {k: v for k, v in staged.items() if v}


def test_fetch_cases_as_page_rows(spark):
    """Success, article-body extraction, and failed fetches (null page)."""
    df = spark.createDataFrame([
        (1, "<html><body><article><p>Noticia de prueba.</p><p>Más información aquí.</p></article></body></html>"),
        (2, '<html><body><article data-component="article-body"><p>From article body</p></article></body></html>'),
        (3, None)], "page_id long, html string")
    got = {r.page_id: r.text for r in pages_to_text(df).collect()}
    assert got[1] == "Noticia de prueba.\nMás información aquí."
    assert got[2] == "From article body"
    assert got[3] is None
