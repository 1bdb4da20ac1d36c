"""What the operators share: stored tables, row identity and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import fresh_path

#: ASCII white space, the separators of words in every operator here: [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"
NONSPACE_CLASS = r"[^\x20\x09-\x0D]"
#: Keys with more than one in so many of all rows are joined by broadcast.
HEAVY = 10_000
#: Sides of joins are broadcast only if they have no more rows than this; beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and lost executors cost nothing that was stored.

    The folder goes when `forget` is called, or when the driver ends. Columns of the void type are stored as strings."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stepquarry_path = path
    return out


def forget(*stored: DataFrame) -> None:
    """Deletes tables that `store` wrote and that nothing will read again."""
    for df in stored:
        _delete(df.sparkSession, df._stepquarry_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is gone, and with it whoever could delete
        pass


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if it has few enough rows (counted unless given)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def join_evenly(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows, stored, inner-joined with table, which has each key once and in n how many of the rows have it.

    Keys with more than one in HEAVY of the rows, HEAVY keys at most, are broadcast, so their rows stay where they are; only the
    other rows are shuffled, and no task gets a large share of them."""
    often = F.col(n) * HEAVY > rows.count()
    heavy = table.where(often)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(table.where(~often), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


def over_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None and out.num_rows:
                yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """At a task's end: a Python worker stays for later tasks, and with it what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Within it, what is run hands that many rows at a time to Python: whole texts in the default batches take much of an executor's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def ascii_lower(text: bytes) -> bytes:
    """Lower-cases A-Z only, as the contracts ask."""
    return text.lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit words (the constants are SplitMix64's, fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unique_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, for work columns beside unknown ones."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
