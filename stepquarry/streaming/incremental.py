"""Incremental ingestion: new trajectory files -> stateless transforms -> first-processed wins -> append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.dedupe import without_used


def ingest(spark: SparkSession, path: str, schema: StructType | str, out: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends rows whose key the output doesn't have, then stops when the files at hand are done.

    The output itself is the memory, so a key is known however long ago it came, and no state grows. Each batch is written into a folder
    of its own number, which replaces what a failed attempt left there; within a batch any one of equal keys stays."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = transform(batch).dropDuplicates(keys)
        target = f"{out.rstrip('/')}/batch={number}"
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(out)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(folder):
            known = spark.read.schema(fresh.schema).parquet(out).where(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
            fresh = without_used(fresh, known, keys)
        fresh.write.mode("overwrite").parquet(target)

    rows = spark.readStream.schema(schema).json(path)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
