"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
_FOLDERS: dict[str, str] = {}  # application id -> folder of its written tables
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers started from now on import this package.

    Workers get the driver's ``PYTHONPATH``, not its ``sys.path``; the folder
    of the package is added to what Spark hands them.  On a cluster where the
    folder does not exist the package is installed or sent with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, under the session's
    ``spark.checkpoint.dir``.  It is deleted when Python ends.

    Without that setting a local session (tests on one machine) takes a temporary
    folder; a cluster has no folder that all its machines see, so it is an error
    there.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if base is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-")
        _FOLDERS[app] = f"{base.rstrip('/')}/millrace-{app}"
        atexit.register(delete, spark, _FOLDERS[app])
    return _FOLDERS[app]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any file system that Spark knows, if it is there."""
    sc = spark.sparkContext
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except (Py4JError, OSError, AttributeError):  # the session has ended: its folder is left to the cluster's own clean-up
        pass


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any file system that Spark knows."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if exists(spark, path) else []


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its rows
    are computed once, its lineage ends, and lost executors lose nothing of it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that nothing reads any more."""
    for df in tables:
        path = _TABLES.pop(df, None)
        if path is not None:
            delete(df.sparkSession, path)


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside helper columns, whose names
    then cannot clash with those of its own columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(name) for name, c in extra.items()])


def unpacked(df: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """The columns of ``row`` again, some of them replaced."""
    return df.select(*[instead.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A table that Spark reads in far fewer tasks than the session has cores is
    dealt out, so that work on its rows runs side by side.  Large tables come in
    many tasks and are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if 2 * df.rdd.getNumPartitions() <= n else df
