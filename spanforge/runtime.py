"""What Python workers need to run this package's functions, and tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, also in a session begun from another folder."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder, and a cluster one in its default
    file system; a cluster whose default file system is each machine's own disk has to name a folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="spanforge-") if spark.sparkContext.master.startswith("local") else _default_dir(spark)
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def _default_dir(spark: SparkSession) -> str:
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return jvm.org.apache.hadoop.fs.Path(fs.getHomeDirectory(), "spanforge-shared").toString()


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/spanforge/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def mark() -> int:
    """How many scratch folders there have been, for `release`."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the scratch folders made after a mark, once no result that reads them is in use."""
    for path in [p for p in _made[since:] if p not in keep]:
        remove(spark, path)
    _made[since:] = [p for p in _made[since:] if p in keep]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() for small tables; its files go when the table is out of use."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder of our own in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
