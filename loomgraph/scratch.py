"""Written tables that cut a lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PART_ROWS, MOST_PARTS = 250_000, 4


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A session within one process may leave it unset and has a temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{_own_folder()}"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="loomgraph-")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, written as a table to the shared folder and read back.

    Unlike ``checkpoint()`` it doesn't compute its last stage twice, and a lost
    executor costs nothing, as the files aren't on it. The table goes when the application ends.
    What was shuffled for it goes as soon as it is written, not when the driver happens to collect its garbage.
    """
    return _written([df], name)


def written_by(rows: int, key: list[str], part: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], name: str) -> DataFrame:
    """A table written in parts, so that only the shuffles of one of them are on disk at a time.

    part makes what comes of a part of the rows; it is given the filter that takes the part's rows of a table, by a hash of ``key``.
    There is a part for each ``PART_ROWS`` of ``rows``, ``MOST_PARTS`` at most.
    """
    n = max(1, min(MOST_PARTS, -(-rows // PART_ROWS)))
    return _written((part(lambda df, k=k: df if n == 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k)) for k in range(n)), name)


def _written(parts: Iterable[DataFrame], name: str) -> DataFrame:
    folder = uuid.uuid4().hex
    paths = []
    for df in parts:
        spark = df.sparkSession
        paths.append(f"{shared_dir(spark)}/{name}-{folder}-{len(paths)}")
        fs, where = _fs(spark, paths[-1])
        fs.deleteOnExit(where)
        before = spark.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(paths[-1])
        finally:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(*paths)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, where = _fs(df.sparkSession, folder)
        fs.delete(where, True)
