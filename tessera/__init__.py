"""tessera: Spark-native operators for feed, page, transcript and card data.

Everything here is expressed as DataFrame / SQL column expressions, joins,
windows and Structured Streaming so that Catalyst plans it and the work is
partitioned across the cluster.  The sub-packages are:

* ``functions``  - reusable Column builders (text, HTML, dates, JSON, keys)
* ``sources``    - readers for the input formats (tables, XML feeds, JSON card
                   folders, text corpora, sent logs, word lists)
* ``operators``  - DataFrame -> DataFrame operators (card merge, FIFO queue,
                   speaker assignment, dedup, ...)
* ``plans``      - the registered queries bound to the driver tables, and the
                   DuckDB oracle SQL for each
* ``streaming``  - Structured Streaming jobs (ingest, never-send-twice,
                   stateful queue)
"""

from tessera.session import drop_materialized, get_spark, materialize, shared_dir, ship_package

__all__ = ["get_spark", "shared_dir", "materialize", "drop_materialized", "ship_package"]
