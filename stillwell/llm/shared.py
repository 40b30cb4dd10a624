"""Helpers of the corpus operators: the shared folder, written stages, and joins that split hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows and more than LEAST_HOT of them; so there are fewer than
#: 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
LEAST_HOT = 100


def shared_folder(spark: SparkSession) -> str:
    """A new folder (a URI) that the driver and all executors reach, below ``spark.checkpoint.dir``.

    Only a session on this machine alone that names no folder gets a temporary one. The folder is removed
    when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base, f"corpus-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    atexit.register(_remove, spark, files, path)
    return str(files.makeQualified(path).toString())


def _remove(spark: SparkSession, files, path) -> None:
    if spark.sparkContext._jsc is not None:
        files.delete(path, True)


#: Nothing reads the shuffles of a written stage again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What the blocks of ``passing`` that are open have written, the innermost last.
_PASSING: list[list[str]] = []


@contextmanager
def passing() -> Iterator[None]:
    """Stages that are written inside are removed at its end, unless they are ``lasting``: no frame that is used later may read them."""
    _PASSING.append([])
    try:
        yield
    finally:
        spark = SparkSession.active()
        for folder in _PASSING.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files: computed once, and safe from lost executors.

    The shuffles of the write are removed with it, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = folder + "/rows"
    if _PASSING and not lasting:
        _PASSING[-1].append(folder)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int, spread: Column | None = None, how: str = "left") -> DataFrame:
    """Join one ``right`` row per key to all its ``left`` rows, whatever share of them one key holds.

    ``weight`` counts the left rows of a key and ``rows`` all of them. Hot keys are fewer than 1 / HOT_SHARE, so they
    pass through the driver and are broadcast: their left rows meet them where they lie, and are dealt by ``spread``
    after that where it is given. Only the rows of other keys are dealt by the key. Rows without a key match nothing.
    """
    out = [*left.columns, *[c for c in right.columns if c not in keys]]
    least = max(rows * HOT_SHARE, LEAST_HOT)
    found = right.filter(F.col(weight) > least).collect() if rows > least else []
    if not found:
        return left.join(right, keys, how).select(*out)
    hot = left.sparkSession.createDataFrame(found, right.schema)
    here = left.join(F.broadcast(hot), keys, "inner").select(*out)
    cold = right.filter(F.col(weight) <= least)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return (here if spread is None else here.repartition(spread)).union(rest.select(*out))
