"""Session construction and the shared folder used to cut lineage.

On a cluster the session is created by the platform; ``get_spark`` only fills
in settings that nobody has set, so submitted and cluster values (master,
shuffle partitions, checkpoint folder, ...) always win.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings of a session without values of its own, wherever it runs.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# Further settings of a local session that this process starts (tests, bench).
_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "16g",
}


def _submitted() -> bool:
    """Whether spark-submit (or submit arguments) decide about master and settings."""
    return "PYSPARK_GATEWAY_PORT" in os.environ or "master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")


def get_spark(master: str | None = None, app: str = "tessera", **conf) -> SparkSession:
    """The active session, or a new one.

    ``master`` (or ``$TESSERA_MASTER``) and ``conf`` are for sessions that this
    process starts; a submitted application keeps what it was submitted with.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if not _submitted():
        master = master or os.environ.get("TESSERA_MASTER")
        if master:
            builder = builder.master(master)
            if master.startswith("local"):
                conf = {**_LOCAL_DEFAULTS, **conf}
        for k, v in conf.items():
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
        given = sc.getConf()
        for k, v in _DEFAULTS.items():
            if not given.contains(k):
                spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (the shared store the
    cluster names).  Only a local master may go without: then one is created
    in the system temp folder and registered, so ``DataFrame.checkpoint``
    works too.  Elsewhere executors would write to their own disks, so a
    missing setting is an error.  Each call returns a new unique sub-folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not base and sc is not None:
        base = sc.getCheckpointDir()
    if not base:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        if sc is not None:
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None on Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable: point it at the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if base and sc is not None:
        sc.setCheckpointDir(base)
    elif not base:
        shared_dir(spark, "init")


def materialize(df, purpose: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a DataFrame reading it back.

    Used where several branches of one operator consume the same expensive
    intermediate (a join or scan): the branches then read a columnar table
    with column pruning instead of recomputing its lineage, and a lost
    executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    for seen in ON_MATERIALIZE:
        seen(df)
    df.write.mode("overwrite").parquet(path)
    track(path)
    return spark.read.parquet(path)


ON_MATERIALIZE: list = []  # called with every DataFrame that ``materialize`` writes (plan report)
_WRITTEN: list[str] = []  # folders written by ``materialize`` in this process
_TABLES: list[str] = []  # tables of the session's catalog that lie in such folders


def track(path: str, table: str | None = None) -> None:
    """Count a folder, and a table that lies in it, among what ``drop_materialized`` deletes."""
    _WRITTEN.append(path)
    if table is not None:
        _TABLES.append(table)


def drop_materialized(spark: SparkSession) -> int:
    """Delete the intermediates this process wrote with ``materialize``.

    Call it when the job's results have been written: DataFrames built on
    an intermediate cannot be evaluated after it is gone.  Returns the number
    of folders removed.  Needs a classic session (Hadoop FileSystem API)."""
    sc = _context(spark)
    if sc is None:
        return 0
    jvm = sc._jvm
    conf = sc._jsc.hadoopConfiguration()
    removed = 0
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


@contextmanager
def intermediates(spark: SparkSession):
    """Deletes what ``materialize`` wrote inside the block when it ends, so
    write or collect results inside it."""
    try:
        yield
    finally:
        drop_materialized(spark)


# Many small files: Spark's own values start a task for each folder to be listed (up to 10,000) and
# one for every few files to be read, each far longer to start than to run.
_SMALL_FILES_OPEN_COST = 256 << 10
_CLEANER_THREADS = 8


def _bytes(size: str | None) -> int:
    """A size as in Spark's settings (``4194304``, ``4194304b``, ``4m``); plain numbers are bytes."""
    found = re.fullmatch(r"(\d+)([kmgtp]?)b?", (size or "").strip().lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else _SMALL_FILES_OPEN_COST


@contextmanager
def small_files(spark: SparkSession):
    """Settings for folders of many small files, inside the block: a listing task takes many folders,
    a read task as many files as its bytes allow, and read files are archived by several threads.

    Reads list their files when they are loaded, streams take the settings
    when they are started; values that go further already are kept."""
    sc = _context(spark)
    tasks = 4 * sc.defaultParallelism if sc is not None else 200
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.parallelPartitionDiscovery.parallelism",
                                                "spark.sql.files.openCostInBytes", "spark.sql.streaming.fileSource.cleaner.numThreads")}
    listing, opening, cleaning = old
    new = {listing: min(tasks, int(old[listing] or tasks)), cleaning: max(_CLEANER_THREADS, int(old[cleaning] or 1)),
           opening: min(_SMALL_FILES_OPEN_COST, _bytes(old[opening]))}
    for k, v in new.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers (executors).

    Operators that run Python inside tasks (``mapInPandas`` completion, the
    stateful streaming queue) pickle their functions by module reference, so
    the workers must be able to import this package.  The package's ``.py``
    files are zipped once per application and added with ``addPyFile``, which
    also distributes them to the executors of a cluster.
    """
    import zipfile

    app = spark.conf.get("spark.app.id", "") or str(id(spark))
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="tessera-pyfiles-"), "tessera.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for base, _, names in os.walk(pkg_dir):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, root))
    sc = _context(spark)
    if sc is not None:
        sc.addPyFile(zpath)
    else:  # Spark Connect
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(app)
