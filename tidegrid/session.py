"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: Intermediate folders that still stand, in order of making, with the session and process they belong to.
_standing: list[tuple[str, SparkSession, int]] = []


def build_session(app: str = "tidegrid", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on: UTC, adaptive plans, skew-join splitting."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is absent a local master gets a temporary folder; a cluster without the setting is an
    error, because a machine-local folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="tidegrid-")
        base = "file://" + os.path.abspath(_own_dirs[app])
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _standing.append((path, spark, os.getpid()))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(since: int = 0) -> None:
    """Delete the intermediate folders made after the first ``since``; frames that read them are then void."""
    while len(_standing) > since:
        path, spark, pid = _standing.pop()
        if pid == os.getpid() and spark.sparkContext._jsc is not None:
            _delete(spark, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables made within are deleted at the end: for results that are written or collected inside."""
    since = len(_standing)
    try:
        yield
    finally:
        release(since)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001
        pass  # the session is gone; its folders go with the shared folder


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back: the lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
