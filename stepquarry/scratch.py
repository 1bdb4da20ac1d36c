"""The folder that driver and executors share, for what must be written down on the way."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH = "spark.stepquarry.scratch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one is made for a local master, as in tests; on a cluster that is
    an error, as executors have no common local folder."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.conf.get(SCRATCH, None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="stepquarry-")
        spark.conf.set(SCRATCH, path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stepquarry-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once into the shared folder and read back: what is read several times is computed once, and a lost executor loses nothing of it.

    The folder goes with `drop`, or when the driver ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stepquarry_stored = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote and that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._stepquarry_stored)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is gone, and with it whoever could delete
        pass
