"""Session defaults and lineage cuts that outlive a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: The folder that holds this package.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package, whatever their folder. Elsewhere ship it with ``--py-files``."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, shared: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tested under. ``conf`` keys use ``__`` for dots.

    ``shared`` is the folder for lineage cuts, one that all machines see; a session on one machine may do without.
    """
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return reach_workers(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where driver and executors are one process (tests) and it is unset: one of our own, set once."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        master = context.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-chronotext-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there.

    Unlike an eager ``checkpoint()`` the plan runs once, not twice, and the copy is columnar and compressed. The files stay
    until ``release``, since lazy results read them.
    """
    path = f"{shared_dir(df.sparkSession)}/chronotext-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialize`` wrote meanwhile; store the results before."""
    before = len(_made)
    try:
        yield
    finally:
        release(spark, before)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete what ``materialize`` wrote in this process, but for the first ``keep`` tables, and return how many that was; for use once the results are stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    count = len(_made) - keep
    while len(_made) > keep:
        path = hadoop(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count
