"""Sources and sinks: JSON Lines with ordinals, objects and arrays, Arrow files, slices and lookups, resume, ordered output, sidecars."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts
from ..operators import selection
from ..operators.dedupe import numeric_first
from . import arrow_files as arrow_batches
from . import json_pieces, record_files

CORRUPT = "_corrupt_record"


# discovery ----------------------------------------------------------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discover(spark: SparkSession, paths: list[str]) -> list[str]:
    """Input files in order: a file as it stands, a folder's *.json and then its *.jsonl at any depth, each sorted; missing paths are left out."""
    out = []
    for path in paths:
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            continue
        if fs.getFileStatus(p).isFile():
            out.append(path)
            continue
        found, it = [], fs.listFiles(p, True)
        while it.hasNext():
            found.append(it.next().getPath().toString())
        out += [f for end in (".json", ".jsonl") for f in sorted(found) if f.endswith(end)]
    return out


# lines --------------------------------------------------------------------------------------------------------------------------------
def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): every physical line with its number from 0 in its file. Files are split as Spark splits them.

    Lines are numbered within a split by their place in it, and splits by a running sum of their counts: one small table of splits."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    placed = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return raw.join(placed, ["file", "block"]).select("file", (F.col("row") + F.col("shift")).alias("line"), "value")


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, objects_only: bool = False) -> DataFrame:
    """Rows of .jsonl files with their file and `line` (from 0 in each file). Blank lines are skipped but have a number; objects_only numbers
    the objects that are left instead. A line that isn't an object gives a null record."""
    rows = lines(spark, path).where(texts.strip(F.col("value")) != "")
    sound = F.try_parse_json("value").isNotNull() & texts.lstrip(F.col("value")).startswith("{")
    out = rows.withColumn("record", F.when(sound, F.from_json("value", schema)))
    if objects_only:
        out = out.where("record is not null").withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)
    return out.select("file", F.col("line").cast("long").alias("line"), "record")


def any_shape(spark: SparkSession, path: str | list[str], schema: str, having: str | None = None) -> DataFrame:
    """Records of files that hold one object, an array of objects or an object a line, told by content, where the named field isn't null.

    Files of any size are read in splits. Torn arrays and objects are left out whole, as are lines that can't be read."""
    kept = json_pieces.records(spark, path, schema).select("record.*")
    return kept.where(F.col(having).isNotNull()) if having else kept


def arrow_files(spark: SparkSession, path: str, schema: str, suffix: str = "-train.arrow") -> DataFrame:
    """Rows of the Arrow stream files (*.arrow) at any depth, with `subset`, the file's name without the suffix, `path` and `row`, the place in its file. Files are read by
    record batch, so one of any size is read by many tasks."""
    fs, p = _fs(spark, path)
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        found.append(it.next().getPath().toString())
    return arrow_batches.read(spark, sorted(f for f in found if f.endswith(".arrow")), schema, suffix)


def write_arrow_files(df: DataFrame, path: str, by: str, order: list[str], suffix: str = "-train.arrow", batch: int = 10_000) -> int:
    """An Arrow stream for each value of `by`, named by it, its rows in order, `batch` rows to a record batch; how many files. A file is written by
    one task as its rows come, a batch at a time, and moved to its name when it is whole."""
    names = [c for c in df.columns if c != by]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = arrow_batches.write_streams(batches, path, by, names, suffix, batch)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["files"])

    dealt = df.repartition(by).sortWithinPartitions(by, *order)
    return dealt.mapInArrow(write, "files long").agg(F.sum("files")).first()[0]


# slices -------------------------------------------------------------------------------------------------------------------------------
def record_at(records: DataFrame, index: int, order: str = "line") -> DataFrame:
    """The one record with this number; an IndexError if there is none."""
    found = records.where(F.col(order) == index)
    if found.isEmpty():
        raise IndexError(f"no record at index {index}")
    return found


def sliced(records: DataFrame, keep: Column, start: int = 0, limit: int | None = None, order: str = "line") -> DataFrame:
    """Records from physical line `start` that are kept, the first `limit` of those, in no order; no task has them all."""
    some = records.where((F.col(order) >= start) & F.coalesce(keep, F.lit(False)))
    return some if limit is None else selection.first_in_order(some, limit, [F.col(order)])


def _truthy(json: Column, path: str) -> Column:
    return ~F.coalesce(F.get_json_object(json, path), F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")


def sample_route(json: Column) -> Column:
    """How a source row is prepared: `prepared` (it says so, or has a candidate and reference scores), `raw` (it has dimensions, an answer and
    tests), or null: it is passed over."""
    has = lambda key: F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))
    tests = _truthy(json, "$.public_test.input") | _truthy(json, "$.private_test.input")
    return F.when(_truthy(json, "$.prepared_review_sample") | (has("candidate_code") & has("reference_scores")), "prepared").when(_truthy(json, "$.checklist_dimensions") & has("answer") & tests, "raw")


def routed(spark: SparkSession, path: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """(line, route, value) of a JSON Lines file from a physical line on: the first `limit` rows that are prepared or raw."""
    rows = lines(spark, path).select("line", sample_route(F.col("value")).alias("route"), "value")
    return sliced(rows, F.col("route").isNotNull(), start, limit)


def indices(spark: SparkSession, given: list[int], file: str | None = None) -> DataFrame:
    """(at, index): the given numbers, then those of a JSON file (a list, or {"indices": [...]}), each once, where it came first."""
    more: list[int] = []
    if file:
        payload = json.loads(spark.read.text(file, wholetext=True).first().value)
        more = [int(x) for x in (payload.get("indices", []) if isinstance(payload, dict) else payload)]
    kept = list(dict.fromkeys([*given, *more]))
    return spark.createDataFrame(list(enumerate(kept)), "at long, index long")


def listed(given: DataFrame, index: str = "index", order: str = "place") -> DataFrame:
    """(at, index): each index of a long list once, numbered from 0 by where it came first. Range partitions are counted, so no task numbers all."""
    first = given.groupBy(F.col(index).alias("index")).agg(F.min(order).alias("first"))
    return selection.numbered(first, [F.col("first"), F.col("index")], "at").select("at", "index")


def examples(spark: SparkSession, path: str, k: int, seed: int) -> list[Any]:
    """k few-shot examples of a JSON array file, without replacement, by the order of md5(seed:place); all if there are fewer."""
    import hashlib

    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    order = sorted(range(len(found)), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return [found[i] for i in order[:k]]


# resume -------------------------------------------------------------------------------------------------------------------------------
def completed_ids(spark: SparkSession, path: str, key: str = "dataset_index") -> DataFrame:
    """Distinct ids of the readable lines of a file that may end in a torn one; none if there is no file."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], f"{key} string")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.where(F.try_parse_json("value").isNotNull()).select(F.get_json_object("value", f"$.{key}").alias(key)).where(F.col(key).isNotNull()).distinct()


def stored_records(spark: SparkSession, path: str, schema: str, allowed: DataFrame | None = None, key: str = "dataset_index") -> DataFrame:
    """Records of a folder of one-object files: of several with one id the last file's; unreadable files are left out."""
    kinds = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.options(pathGlobFilter="*.json", multiLine="true").schema(kinds).json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    rows = rows.where(F.col(CORRUPT).isNull() & F.col(key).isNotNull())
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.col(key).cast("string")).orderBy(F.desc("_file")))).where("_n = 1").drop("_n", "_file", CORRUPT)
    if allowed is None:
        return last
    return last.join(allowed.select(F.col(key).cast("string").alias("_allowed")).distinct(), F.col(key).cast("string") == F.col("_allowed"), "left_semi")


# sinks --------------------------------------------------------------------------------------------------------------------------------
def write_json_lines(df: DataFrame, path: str, id_col: str | None = None, mode: str = "overwrite") -> None:
    """JSON Lines that keep null keys; ordered by id, numbers first, if one is named."""
    if id_col:
        df = df.orderBy(*numeric_first(id_col))
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _record_name(id_cols: tuple[str, ...]) -> Column:
    return F.concat(F.concat_ws("_", *[texts.file_part(F.col(c)) for c in id_cols]), F.lit(".json")).alias("name")


def write_per_record(df: DataFrame, path: str, *id_cols: str, mode: str = "append") -> None:
    """A JSON file for each record, named by its ids, which are made safe as file names. A repeated run adds only what lacks."""
    record_files.write(df.select(_record_name(id_cols), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), path, mode)


def read_per_record(df: DataFrame, path: str, schema: str, *id_cols: str) -> DataFrame:
    """`file` and the fields of schema, of the files that write_per_record made of records with these ids. Files are opened by name in tasks, so that
    their number is no matter for the driver; those that aren't there give nothing."""
    return record_files.read(df.select(_record_name(id_cols)), path).select(F.col("name").alias("file"), F.from_json("value", schema).alias("_r")).select("file", "_r.*")


def write_sidecar(df: DataFrame, path: str, counts: dict[str, Column], **given: Any) -> dict[str, Any]:
    """Beside an output, one JSON object: what was given, the number of rows, and a histogram by each named column."""
    total = df.count()
    out = {**given, "total": total}
    for name, c in counts.items():
        out[name] = {str(r["k"]): r["n"] for r in df.groupBy(c.alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect()}
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(out, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out


def missing_outputs(requested: DataFrame, spark: SparkSession, path: str, key: str = "index") -> DataFrame:
    """Requested numbers without a file raw_<number>_... in the folder: what a run that skips existing ones still does."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return requested
    names = spark.read.format("binaryFile").options(pathGlobFilter="raw_*.json").load(path).select(F.regexp_extract("path", r"raw_(\d+)_[^/]*$", 1).alias("_done"))
    return requested.join(names.where("_done <> ''").distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")


def appended(spark: SparkSession, rows: DataFrame, path: str, key: str, chunks: int = 8) -> int:
    """Rows whose id the output lacks, appended in `chunks` writes, so that a lost run keeps what it had; how many rows.

    Ids are dealt to the writes by their hash; each write is in the order of ids."""
    done = completed_ids(spark, path, key).select(F.col(key).alias("_done"))
    left = rows.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")
    before = done.count()
    for k in range(chunks):
        write_json_lines(left.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(chunks)) == k), path, key, "append")
    return completed_ids(spark, path, key).count() - before
