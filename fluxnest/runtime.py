"""Session helpers: table access, lineage cuts in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once its size is known.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, else (local mode) one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="fluxnest-")
    return shared_dir.own


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder's file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, label: str) -> str:
    """The address of a folder in the shared folder that is deleted at exit at the latest."""
    path = f"{shared_dir(spark)}/fluxnest-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    by: columns with few values; rows of each combination lie in a folder of their own, so that a filter on them reads no other.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._fluxnest_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete a table written by materialise once nothing reads it any more."""
    path = getattr(df, "_fluxnest_path", None)
    if path:
        delete(df.sparkSession, path)
        _written[:] = [(s, p) for s, p in _written if p != path]


@atexit.register
def _release_all() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            return


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast only after its size has been checked; otherwise the join shuffles."""
    return F.broadcast(df) if small_enough(df, rows) else df


def empty_array(ddl: str) -> "F.Column":
    """An empty array of the element type given in DDL."""
    return F.array().cast(f"array<{ddl}>")
