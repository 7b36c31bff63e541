"""Session helpers: building a local session for tests and benches, and
finding the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quire") -> SparkSession:
    """A local session configured the way the tests and bench.py run.

    On a cluster the session comes from the platform; nothing here is
    needed there.  AQE stays on so skewed joins are split at run time.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
        # Joins are broadcast by size in bytes, at run time (AQE).
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or the checkpoint dir
    already set on the context).  When neither is set, a ``local[...]``
    session -- tests, benches -- gets a folder under the system temp dir; on a
    cluster that is an error, since executors would each write to a disk of
    their own.  Folders handed out are deleted when the Python driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: master {master} needs a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    own = _scope.get()
    if own is not None:
        own.append(path)
        return path
    if not _handed_out:
        atexit.register(release_shared, spark)
    _handed_out.append(path)
    return path


_handed_out: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders handed out inside are deleted at the end of the block: for work
    whose results are stored elsewhere by then, such as a stream's batch."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        release_shared(spark, own)


def release_shared(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete ``folders``, or all that ``shared_dir`` has handed out; call it when
    no result that reads them is needed any more (it also runs at exit)."""
    folders = _handed_out if folders is None else folders
    while folders:
        path = folders.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit; the folder then stays for the platform's clean-up
            return


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts lineage (a lost executor recomputes from the files, not from
    the sources) and keeps later plans small."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
