"""What several operators share: table access, the shared scratch folder, words."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
#: ``bytes.split()`` splits UTF-8 at exactly these characters.
WORD = "[^\\x20\\x09-\\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that the driver and all executors share.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a local master may
    go without one; it gets a temporary folder, which is then set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_ROOT: list[str] = []


def _local_root() -> str:
    if not _ROOT:
        _ROOT.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _ROOT[0]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(path)
    _WRITTEN.append(path)
    if (mine := _COLLECTED.get()) is not None:
        mine.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []
_COLLECTED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("collected", default=None)


@contextlib.contextmanager
def collecting() -> Iterator[list[str]]:
    """Lists the scratch tables that this thread writes inside the block."""
    mine: list[str] = []
    token = _COLLECTED.set(mine)
    try:
        yield mine
    finally:
        _COLLECTED.reset(token)


def written() -> list[str]:
    """Paths of the scratch tables that this process has written and not deleted."""
    return list(_WRITTEN)


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables whose last reader has ended."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


class Scratch:
    """The written tables of one job; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        before = len(_WRITTEN)
        out = stored(df, tag)
        self.paths.append((out, _WRITTEN[before]))
        return out

    def drop(self, *tables: DataFrame) -> None:
        gone = [(t, path) for t, path in self.paths if any(t is x for x in tables)]
        self.paths = [x for x in self.paths if all(x[1] != path for _, path in gone)]
        delete(self.spark, *(path for _, path in gone))


def digests(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit digests of a row; nulls count by their place, maps by the order of their entries."""
    has_map = {f.name for f in df.schema if "map<" in f.dataType.simpleString()}
    parts = [*[F.to_json(F.struct(c)) if c in has_map else F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
