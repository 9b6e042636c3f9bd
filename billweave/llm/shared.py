"""Helpers that several training-data operators use: written tables, memos, words, row ids."""

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# Ids of rows without one start here, above any real id.
NAMELESS = 1 << 62
_own_folder: list[str] = []
_records: list[list[str]] = []
_held: dict[tuple, object] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: `spark.checkpoint.dir`.

    Only a local session may do without the setting; it gets one temporary folder per process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="billweave-llm-"))
    return _own_folder[0]


def write_table(df: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write `df` once to the shared folder; gives the table that reads it, and its path."""
    spark = df.sparkSession
    path = folder or f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    if folder is None and _records:
        _records[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """`write_table` where the path does not matter."""
    return write_table(df)[0]


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Adds to `paths` the tables that are written to the shared folder meanwhile."""
    _records.append(paths)
    try:
        yield
    finally:
        _records.pop()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of `write_table` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts that stay small when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def known_id(id_column: str, text_column: str) -> Column:
    """The id; for rows without one a number above all real ids, the same for equal texts."""
    made = F.lit(NAMELESS) + F.xxhash64(text_of(text_column)).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col(id_column).cast("bigint"), made)


def held_alone(make: Callable) -> Callable:
    """`make` with its result kept in the worker process until another such function is called. Workers serve one stage after the other, so
    the memos and models of all stages would add up."""

    @functools.wraps(make)
    def held(*args):
        key = (make.__module__, make.__name__, args)
        if key not in _held:
            _held.clear()
            _held[key] = make(*args)
        return _held[key]

    return held


def let_go() -> None:
    """Free what `held_alone` keeps."""
    _held.clear()


class Memo(dict):
    """Values by key, computed on first use. Two generations bound its size: what was not used since the
    last turn goes."""

    def __init__(self, compute, size: int = 60_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Call between batches: the memo is never changed while a batch reads it."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
