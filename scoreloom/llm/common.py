"""What the operators of this subpackage share: stored tables, folds and readers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract here: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; one of its own only where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scoreloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The list to which store() adds what it writes, of this thread alone.
_recording: ContextVar[list[DataFrame] | None] = ContextVar("recording", default=None)


@contextmanager
def recorded(made: list[DataFrame]) -> Iterator[None]:
    """Adds every table that store() makes meanwhile to a list, for discard_all() once nothing reads them."""
    before = _recording.set(made)
    try:
        yield
    finally:
        _recording.reset(before)


#: Rows of megabytes: Parquet's writer would hold a hundred of them before it looks at their size, and its reader all of a group.
ONE_ROW_GROUPS = {"parquet.block.row.count.limit": "1"}


def store(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Writes df to the shared folder and rereads it, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scoreloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**ONE_ROW_GROUPS if large_rows else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    made = _recording.get()
    if made is not None:
        made.append(out)
    return out


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: By session: how many are in small_batches(), and what was set before the first.
_inside: dict[SparkSession, tuple[int, str]] = {}
_entering = Lock()


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Meanwhile Spark hands rows to Python workers in batches that end at this size, so large rows go one or a few at a time."""
    with _entering:
        n, before = _inside.get(spark, (0, spark.conf.get(_BATCH)))
        _inside[spark] = (n + 1, before)
        spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        with _entering:
            n, before = _inside.pop(spark)
            if n > 1:
                _inside[spark] = (n - 1, before)
            else:
                spark.conf.set(_BATCH, before)


def discard(df: DataFrame) -> None:
    """Deletes a table made by store() that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_all(made: list[DataFrame]) -> None:
    """Deletes the tables of a list, those deleted before included, and empties it."""
    while made:
        discard(made.pop())


def clean(result: DataFrame) -> None:
    """Deletes all that a query of this subpackage stored for its result, once that is written."""
    discard_all(result._working)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))
