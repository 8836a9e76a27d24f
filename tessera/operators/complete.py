"""Batch completion with a user-supplied text -> text function.

``batch_complete`` runs the function inside ``mapInPandas``: every Spark task
takes its Arrow batches and calls the function with a small thread pool
(``max_in_flight`` concurrent calls per task), so the cluster-wide concurrency
is ``tasks x max_in_flight``.  One failing call yields an error row and does
not stop the others.  ``journaled_complete`` also keeps every answer as it
comes, so a task that dies halfway, or a job run again, repeats no answered
call.  ``resume`` skips keys whose output already exists
(left-anti on the key); ``split_results`` separates parsed rows from the
quarantine (raw text kept).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.jsonx import json_kind, unfence
from tessera.operators.journal import Journal


def resume(todo: DataFrame, done: DataFrame, key: str, *more: DataFrame) -> DataFrame:
    """Inputs whose key has no output yet.  With several kinds of output
    (``more``) an input is done as soon as any of them exists."""
    keys = done.select(key)
    for other in more:
        keys = keys.union(other.select(key))
    return todo.join(keys.distinct(), key, "left_anti")


def batch_complete(df: DataFrame, key: str, prompt: str, completer: Callable[[str], str],
                   max_in_flight: int = 8) -> DataFrame:
    """``(key, raw, error)`` per input row; ``raw`` is the function's
    answer, ``error`` the exception text when it failed."""
    from tessera.session import ship_package

    ship_package(df.sparkSession)   # the workers import this module
    key_type = df.schema[key].dataType
    schema = StructType([StructField(key, key_type), StructField("raw", StringType()),
                         StructField("error", StringType())])

    def call(p):
        try:
            return completer(p), None
        except Exception as e:  # one failure must not stop the batch
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        import pandas as pd
        with ThreadPoolExecutor(max_in_flight) as pool:
            for pdf in batches:
                res = list(pool.map(call, pdf[prompt].tolist()))
                yield pd.DataFrame({key: pdf[key], "raw": [r for r, _ in res],
                                    "error": [e for _, e in res]})

    return df.select(key, prompt).mapInPandas(run, schema)


def journaled_complete(df: DataFrame, key: str, prompt: str, completer: Callable[[str], str], journal: str,
                       parts: int | None = None, max_in_flight: int = 8) -> DataFrame:
    """As ``batch_complete``, with answers kept in the folder ``journal`` as they come.

    Rows are dealt by (key, prompt) to ``parts`` partitions (default:
    ``spark.sql.shuffle.partitions``), so another attempt of a task, or another
    run with the same ``parts``, meets the answers of its rows in its own part of
    the journal and calls the function for the others only.  A changed prompt is
    a new call.  Errors are not kept, so a failed call is made again.  A task
    holds the answers of its partition.  Speculative copies of a task may call
    twice.  Rows equal in key and prompt may share an answer; a null key or
    prompt is a value like others; an empty table gives no rows.  The folder must
    be one that all executors reach; it is the caller's to delete.
    """
    from tessera.session import ship_package

    spark = df.sparkSession
    ship_package(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([StructField("key", df.schema[key].dataType), StructField("raw", StringType()),
                         StructField("error", StringType())])
    entry = F.sha2(F.to_json(F.struct(F.col(key).alias("k"), F.col(prompt).alias("p"))), 256)
    rows = df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), entry.alias("entry")).repartition(parts, "entry")

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        place = f"of-{parts:05d}/part-{TaskContext.get().partitionId():05d}"
        with Journal(f"{journal}/{place}") as kept, ThreadPoolExecutor(max_in_flight) as pool:
            def call(entry, p):
                if entry not in kept.answers:
                    try:
                        kept.add(entry, completer(p))
                    except Exception as e:  # one failure must not stop the batch
                        return None, f"{type(e).__name__}: {e}"
                return kept.answers[entry], None

            for pdf in batches:
                res = list(pool.map(call, pdf["entry"].tolist(), pdf["prompt"].tolist()))
                yield pd.DataFrame({"key": pdf["key"], "raw": [r for r, _ in res], "error": [e for _, e in res]})

    return rows.mapInPandas(run, schema).toDF(key, "raw", "error")


def split_results(results: DataFrame, key: str) -> dict[str, DataFrame]:
    """K2: ``ok`` (fences removed, valid JSON) and ``quarantine`` (raw kept)."""
    clean = results.withColumn("clean", unfence(F.col("raw"))) \
        .withColumn("kind", json_kind(F.col("clean")))
    ok = clean.filter(F.col("error").isNull() & F.col("kind").isNotNull()).select(key, "clean", "kind")
    bad = clean.filter(F.col("error").isNotNull() | F.col("kind").isNull()).select(
        key, "raw", F.coalesce(F.col("error"), F.lit("invalid json")).alias("error"))
    return {"ok": ok, "quarantine": bad}
