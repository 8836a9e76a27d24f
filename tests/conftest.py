import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import ensure_checkpoint_dir, get_spark

    s = get_spark(master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    ensure_checkpoint_dir(s)
    yield s


def one_col(spark, expr, value, schema="x string"):
    """Evaluate a Column expression on a one-row frame."""
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]
