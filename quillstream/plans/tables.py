"""Tables between the steps: raw files, conversations, analyses.

A filter on a computed column is pushed below the steps that compute it, and carries their expressions with it.
So the tables are written and read again before they are filtered; that also cuts their lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: The version of snapshots' tables.
VERSION = 1


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; what is there goes when the application ends.

    Only a local session, as in tests, gets a folder of its own where that is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/quillstream/{spark.sparkContext.applicationId}"
    path, store = _hadoop(spark, own)
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{own}/table-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, mode: str = "error") -> DataFrame:
    """df, written as Parquet and read again; without a path, in the shared folder."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as a shuffle has, before steps whose work isn't in proportion to the bytes they read: a split of small rows holds very many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def snapshot(spark: SparkSession, folder: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of make(), kept below folder for as long as the source file, or folder, has the same time of change.

    A snapshot of another time or version isn't read; one that was broken off is written again.
    """
    path = f"{folder.rstrip('/')}/version={VERSION}/modified_ms={modified_ms(spark, source)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_version(df: DataFrame, folder: str) -> str:
    """Write df as the next version of a table; earlier ones stay, and readers see it when it is whole."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{_last_version(spark, folder) + 1:09d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last whole version of a table; None if there is none."""
    last = _last_version(spark, folder)
    return spark.read.parquet(f"{folder.rstrip('/')}/{last:09d}") if last else None


def _last_version(spark: SparkSession, folder: str) -> int:
    if not exists(spark, folder):
        return 0
    path, store = _hadoop(spark, folder)
    names = [s.getPath().getName() for s in store.listStatus(path)]
    return max((int(n) for n in names if n.isdigit() and exists(spark, f"{folder.rstrip('/')}/{n}/_SUCCESS")), default=0)


def delete(spark: SparkSession, file: str) -> bool:
    """Delete one file; whether it was there."""
    path, store = _hadoop(spark, file)
    return store.delete(path, False)


def exists(spark: SparkSession, folder: str) -> bool:
    path, store = _hadoop(spark, folder)
    return store.exists(path)


def make_folder(spark: SparkSession, folder: str) -> None:
    path, store = _hadoop(spark, folder)
    store.mkdirs(path)


def write_text(spark: SparkSession, file: str, text: str) -> None:
    """Write one small file under its own name."""
    path, store = _hadoop(spark, file)
    out = store.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def modified_ms(spark: SparkSession, file: str) -> int:
    """When a file was last written, in milliseconds."""
    path, store = _hadoop(spark, file)
    return store.getFileStatus(path).getModificationTime()


def _hadoop(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())
