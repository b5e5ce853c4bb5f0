"""Session defaults and the shared scratch location."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution on. On a cluster ``master`` comes from spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites are recorded per column expression otherwise, which dominates plan building
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


#: Folders that each application has made.
_MADE: dict[str, list[str]] = {}
_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share.

    Off one machine the setting is required: executors cannot see each other's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="tempora-"))
    return _LOCAL_ROOT[0]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root; :func:`remove_shared` removes it."""
    made = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(made)
    return made


def remove_shared(spark: SparkSession) -> None:
    """Delete every shared folder of this application; call it when no result is read any more."""
    _STORED.clear()
    for made in _MADE.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(made)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the shared root."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the stored copy.

    Readers of the copy do not repeat its computation, survive lost executors without it, and
    the optimizer knows its real size.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in this block remove their shuffle files when they end, so only the tables stay on disk."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_STORED: dict[tuple, DataFrame] = {}


def input_state(spark: SparkSession, inputs: list[str]) -> tuple:
    """Size and time of change of every input file: the state that a stored result belongs to."""
    out = []
    for p in inputs:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        out += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(out))


def stored_once(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a stored table, made once per application for one state of its input files."""
    key = (spark.sparkContext.applicationId, name, input_state(spark, inputs))
    if key not in _STORED:
        _STORED[key] = shared_table(build(), name)
    return _STORED[key]
