"""Files in the folder that the cluster shares: new names, intermediate tables, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def file_at(spark: SparkSession, path: str) -> tuple:
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = file_at(spark, path)
    return files.exists(p)


def kept(spark: SparkSession) -> str:
    """A new name in the shared folder, for files that outlive the session."""
    return f"{shared_dir(spark).rstrip('/')}/tidemill-{uuid.uuid4().hex}"


def scratch(spark: SparkSession) -> str:
    """A new directory in the shared folder, which goes when the session ends."""
    path = kept(spark)
    p, files = file_at(spark, path)
    files.mkdirs(p)  # only what is there is removed
    files.deleteOnExit(p)
    _scratch.append(path)
    return path


def erase(spark: SparkSession, path: str) -> None:
    """Removes a scratch directory that nothing reads any more."""
    p, files = file_at(spark, path)
    files.delete(p, True)
    _scratch.remove(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Of the scratch directories made inside, all but the last go at the end."""
    before = len(_scratch)
    yield
    for path in _scratch[before:-1]:
        erase(spark, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files go as it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_at(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, which outlives executors and cuts lineage, and its scratch directory."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(f"{path}/t")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/t"), path


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as such a table, which goes when the session ends."""
    return written_at(df, codec)[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemill_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="tidemill-")).resolve() / "tidemill.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._tidemill_sent = True
