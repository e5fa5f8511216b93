"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Folders made for local sessions that name none, by application id.
_local_roots: dict[str, str] = {}


def local_session(name: str, cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; cluster sessions come from spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="foldwright-")
    return _local_roots[app]


# Folders written inside the open scratch spaces, the innermost last; each thread has its own.
_spaces = threading.local()


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path under the shared folder; it belongs to the scratch space that is open.

    With `keep` it belongs to the one around that, or to none.
    """
    folder = f"{shared_root(spark)}/foldwright/{uuid.uuid4().hex}"
    open_spaces = getattr(_spaces, "open", [])
    if len(open_spaces) > keep:
        open_spaces[-1 - keep].append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was stored inside, but for tables stored with `keep`.

    Frames that leave the block must not read the others.
    """
    if not hasattr(_spaces, "open"):
        _spaces.open = []
    _spaces.open.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _spaces.open.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def stored(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write `df` once as Parquet and go on from there: for tables that several jobs read."""
    path = scratch_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage and go on from there.

    Partition order and row order inside a partition stay as written, also when
    an executor is lost later.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
