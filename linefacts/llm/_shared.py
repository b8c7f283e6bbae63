"""Work tables and files in the folder that all machines of a cluster share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linefacts.sources import workdir
from linefacts.sources.workdir import drop, ship

__all__ = ["drop", "drop_work_tables", "filesystem", "made", "new_path", "ship", "trim", "written"]

#: Rows of an Arrow batch between Spark and Python while work tables are written.
BATCH_ROWS = 2000


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one work table or folder of files."""
    path = workdir.new_path(spark, name)
    _made.append(path)
    return path


#: Paths given out by this driver, in order.
_made: list[str] = []


def made() -> list[str]:
    return _made


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet work table and reads it again: lineage ends here, and lost executors cost nothing.

    Spark's output commit keeps the rows of one attempt of each task, so files
    that the rows name are whole and belong to those rows.
    """
    path = new_path(df.sparkSession, name)
    spark, batch = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch, None)
    w = df.write.option("compression", "zstd")
    try:  # whole texts: fewer rows a batch than the default, for the sake of memory
        spark.conf.set(batch, str(min(int(before or BATCH_ROWS), BATCH_ROWS)))
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    finally:
        spark.conf.unset(batch) if before is None else spark.conf.set(batch, before)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def drop_work_tables(spark: SparkSession) -> None:
    """Removes everything this application has put into the shared folder. Results read from there end too."""
    drop(spark, [workdir.own_dir(spark)])


def filesystem(uri: str):
    """(pyarrow file system, path) for a URI or a plain path; for tasks that write or read files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


_libc = None


def trim() -> None:
    """Gives memory that is free in this process back to the machine, so that an idle worker holds little."""
    global _libc
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _libc = lambda _: None
    _libc(0)
