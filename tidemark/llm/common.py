"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df read back from the shared checkpoint folder: lineage ends, and lost executors lose nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as a compressed table of the shared folder, and what removes the table once nothing reads it any more."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return spark.read.schema(df.schema).parquet(folder), lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a job shuffles is removed with its end, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def tasks_for(rows: int, each: int, least: int = 4) -> int:
    """Tasks for so many rows, each to a task: a small table need not be dealt over all shuffle partitions."""
    return max(least, -(-rows // each))


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df without those that outputs of these names replace (Spark compares without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with underscores until no column of the frames is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_kept: list[tuple[object, object]] = []


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """What make() made for this key, kept by the Python worker for its next tasks: one object at a time, so
    that a worker that goes on to another operator holds nothing of the last."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, make()))
    return _kept[0][1]


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 4, is 2. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
