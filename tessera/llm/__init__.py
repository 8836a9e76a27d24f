"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this package (except the guarded import in
``__spark_entry__.py`` and ``corpus_pipeline.py``) imports it.
"""
