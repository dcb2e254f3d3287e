"""Tables and intermediate results in storage that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in this one process (tests), a temporary folder is
    set in its place; on a cluster an unset folder is an error, as a local one would be
    invisible to the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='voxelry-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: What has been written within each ``scratch``.
_scopes: list[list[Written]] = []


@contextlib.contextmanager
def scratch():
    """What is written inside goes when it ends: for results that are written themselves."""
    own: list[Written] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.pop()
        for w in own:
            w.drop()


class Written:
    """A DataFrame written to the shared folder, to be read again without its lineage.

    Losing an executor then costs only the tasks that it ran.  The files go when
    ``drop()`` is called, or at the end of the ``scratch`` that they are written in (but
    for those that are to ``stay``), or else when the driver ends.
    """

    def __init__(self, df: DataFrame, label: str, stay: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/voxelry/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(_remove, self.spark, self.path)
        if _scopes and not stay:
            _scopes[-1].append(self)

    def drop(self) -> None:
        _remove(self.spark, self.path)


#: Rows of a few numbers up to which a table is broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if its size allows it; else joins shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def written(df: DataFrame, label: str) -> DataFrame:
    return Written(df, label).df
