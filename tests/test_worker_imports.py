"""Python workers must import the package even when the driver's working
directory is elsewhere (the driver loads __spark_entry__.py by path)."""

import os
import subprocess
import sys
import tempfile

SCRIPT = r'''
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
spec = importlib.util.spec_from_file_location("entry_mod", sys.argv[1])
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
q = m.queries()
print("RESULT", q["batch_complete_stub"](spark, "/root/testdata/sf0.001").count(),
      q["stream_fifo"](spark, "/root/testdata/sf0.001").count())
'''


def test_python_worker_queries_from_other_cwd():
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    cwd = tempfile.mkdtemp(prefix="elsewhere-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, entry], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    a, b = map(int, line[0].split()[1:])
    assert a > 0 and b > 0
