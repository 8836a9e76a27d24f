"""Registered queries for batch completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import truncate_text, urlsafe_b64
from tessera.operators import complete
from tessera.plans.registry import query
from tessera.sources.tables import Tables


def stub_completer(prompt: str) -> str:
    """Deterministic stand-in for a model: the length and the whole prompt."""
    return f"{len(prompt)}|{prompt}"


@query("batch_complete_stub", oracle="""
WITH todo AS (SELECT doc_id, 'Simplify: ' || CASE WHEN length(text) > 20000
                THEN left(text, 20000) || chr(10) || '[... texto truncado ...]' ELSE text END AS prompt
              FROM documents
              WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0))
SELECT doc_id, cast(length(prompt) AS varchar) || '|' || prompt AS raw, NULL::VARCHAR AS error
FROM todo""")
def batch_complete_stub(spark, sf_dir):
    """Completion over every pending document with a stub model."""
    t = Tables(spark, sf_dir)
    todo = t.documents.select("doc_id", F.concat(F.lit("Simplify: "), truncate_text(F.col("text"))).alias("prompt"))
    done = t.labels.filter(F.col("toxic") == 0)
    return complete.batch_complete(complete.resume(todo, done, "doc_id"), "doc_id", "prompt", stub_completer)


def second_completer(prompt: str) -> str:
    """Another stand-in, so that a result shows which run answered."""
    return f"again|{stub_completer(prompt)}"


@query("complete_journaled", oracle="""
WITH todo AS (SELECT doc_id, 'Simplify: ' || CASE WHEN length(text) > 20000
                THEN left(text, 20000) || chr(10) || '[... texto truncado ...]' ELSE text END AS prompt
              FROM documents)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN '' ELSE 'again|' END
         || cast(length(prompt) AS varchar) || '|' || prompt AS raw, NULL::VARCHAR AS error
FROM todo""")
def complete_journaled(spark, sf_dir):
    """A run that got as far as the labelled documents, then a run over
    all documents with the same journal, which keeps those answers."""
    from tessera.session import materialize, shared_dir, track

    t = Tables(spark, sf_dir)
    journal = shared_dir(spark, "answers")
    track(journal)
    todo = t.documents.select("doc_id", F.concat(F.lit("Simplify: "), truncate_text(F.col("text"))).alias("prompt"))
    begun = todo.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi")
    materialize(complete.journaled_complete(begun, "doc_id", "prompt", stub_completer, journal), "first-run")
    return complete.journaled_complete(todo, "doc_id", "prompt", second_completer, journal)


@query("key_encode", oracle="""
SELECT page_id, url, replace(replace(to_base64(encode(url)), '+', '-'), '/', '_') AS url_key FROM pages""")
def key_encode(spark, sf_dir):
    """URL-safe base64 key of each page URL."""
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", "url", urlsafe_b64(F.col("url")).alias("url_key"))
