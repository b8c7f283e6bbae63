"""The folder that all machines of a cluster share, work tables in it, and the package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that its machines share: each would read its own part of a result."""


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A folder of our own only on a local master where it is unset (tests); elsewhere that raises."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not is_local(spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/linefacts-shared-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


#: Folders that this process has put work tables into.
_own: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. It goes when the driver's process ends, unless LINEFACTS_KEEP_WORK is set."""
    path = f"{shared_dir(spark)}/linefacts/{spark.sparkContext.applicationId}"
    if path not in _own and not os.environ.get("LINEFACTS_KEEP_WORK"):
        _own.add(path)
        jvm = spark.sparkContext._jvm
        conf = jvm.org.apache.hadoop.conf.Configuration(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(_forget, jvm, conf, path)
    return path


def _forget(jvm, conf, path: str) -> None:
    try:  # the JVM may be gone before us
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one work table or folder of files."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a work table: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes work tables and folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless PYTHONPATH leads them to it."""
    top = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == top for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    _shipped.add(app)
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "linefacts"), "zip", top, "linefacts")
    spark.sparkContext.addPyFile(made)
