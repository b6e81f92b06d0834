"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings every job of the library relies on.  ANSI mode stays on (Spark 4
# default); the code uses try_cast / try_divide where bad input is expected.
_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state (a month of game ids for the dedup) off the JVM heap
    STATE_STORE: ROCKSDB,
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "elotrail", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library defaults.

    On a cluster, ``master`` is left to spark-submit; locally tests pass
    ``local[N]``.  The shuffle partition count is only set when given: on a
    cluster AQE coalesces from the cluster-wide default.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")  # local mode: the driver is the executor
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there (HDFS / object store); without one it
    is an error, since a folder on each node's own disk would lose rows.  In
    local mode, where all tasks share the machine, a temporary folder is made.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and "
                             f"executors share (master {sc.master})")
        d = tempfile.mkdtemp(prefix="elotrail-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder.

    Used for written intermediate tables (lineage cuts, rendered fixtures,
    exports) so every executor can read them on a cluster.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    for made in getattr(_open, "blocks", [])[-1:]:
        made.append(path)
    return path


_open = threading.local()  # scratch paths given out inside the innermost ``temporary`` block


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove at the end of the block what was written to scratch paths inside it.
    Results are lazy: write them (or collect them) inside the block."""
    blocks = _open.blocks = [*getattr(_open, "blocks", []), []]
    try:
        yield
    finally:
        for path in blocks[-1]:
            remove(path, spark)
        _open.blocks = blocks[:-1]


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block; a streaming query keeps those it was started with."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def exists(path: str, spark: SparkSession | None = None) -> bool:
    """Whether a path exists on its file system (local, HDFS, object store)."""
    spark = spark or SparkSession.getActiveSession()
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p))


def rename(path: str, to: str, spark: SparkSession) -> None:
    """Give a folder of this library's own another name on its file system."""
    sc = spark.sparkContext
    old, new = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    if not old.getFileSystem(sc._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"{path} was not renamed to {to}")


def remove(path: str, spark: SparkSession) -> None:
    """Delete a folder of this library's own on its file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
