"""Queries that write files into the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import metrics
from ..sources import record_files, records
from ..streaming import first_seen, incremental
from . import tables as T
from .registry import query
from .tables import documents

C = F.col
SCHEMA = "doc_id long, source string, lang string, n_chars long"


def _rows(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.when(C("doc_id") % 9 != 0, C("source")).alias("source"), "lang", "n_chars")


def _written(s: SparkSession, d: str) -> str:
    path = scratch.fresh_path(s, "lines")
    records.write_json_lines(_rows(s, d), path)
    return path


@query("SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN source END AS source, n_chars FROM documents")
def json_lines_round_trip(s: SparkSession, d: str) -> DataFrame:
    return records.json_lines(s, _written(s, d), SCHEMA).select("record.doc_id", "record.source", "record.n_chars")


@query("SELECT n - 1 AS line, k FROM (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS k, doc_id % 7 AS m FROM documents) WHERE m > 1 UNION ALL SELECT n - 1, NULL FROM (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id % 7 AS m FROM documents) WHERE m = 1")
def json_lines_numbered(s: SparkSession, d: str) -> DataFrame:
    """One file in which some lines are blank (they have numbers) and some are no objects (null records)."""
    path = scratch.fresh_path(s, "numbered")
    line = F.when(C("doc_id") % 7 == 0, "").when(C("doc_id") % 7 == 1, "[1]").otherwise(F.concat(F.lit('{"k": '), C("doc_id").cast("string"), F.lit("}")))
    documents(s, d).orderBy("doc_id").select(line.alias("value")).coalesce(1).write.text(path)
    return records.json_lines(s, path, "k long").select("line", C("record.k").alias("k"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, doc_id AS k FROM documents WHERE doc_id % 7 > 1")
def json_objects_numbered(s: SparkSession, d: str) -> DataFrame:
    path = scratch.fresh_path(s, "numbered")
    line = F.when(C("doc_id") % 7 == 0, "").when(C("doc_id") % 7 == 1, "[1]").otherwise(F.concat(F.lit('{"k": '), C("doc_id").cast("string"), F.lit("}")))
    documents(s, d).orderBy("doc_id").select(line.alias("value")).coalesce(1).write.text(path)
    return records.json_lines(s, path, "k long", objects_only=True).select("line", C("record.k").alias("k"))


@query("SELECT doc_id, n_chars, md5(text) AS text_md5 FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 50 <> 7")
def any_shape_records(s: SparkSession, d: str) -> DataFrame:
    """A folder of arrays, single objects and lines, whole texts in them and names that don't tell the shape. Records without a source go, and so do
    arrays that are torn: those of the ids that leave 7."""
    path = scratch.fresh_path(s, "shapes")
    rows = documents(s, d).select("doc_id", F.when(C("doc_id") % 9 != 0, C("source")).alias("source"), "n_chars", "text")
    shape = C("doc_id") % 50
    records.write_json_lines(rows.where((shape != 7) & (shape > 2)), f"{path}/lines")
    named = rows.where((shape == 7) | (shape <= 2)).select("doc_id", F.to_json(F.struct("doc_id", "source", "n_chars", "text")).alias("json"), shape.alias("shape"))
    arrays = named.where("shape > 0").groupBy("shape", F.floor(C("doc_id") / 1000).alias("lot")).agg(F.array_join(F.collect_list("json"), ", ").alias("all"))
    whole = F.when(C("shape") == 7, F.concat(F.lit("["), "all")).otherwise(F.concat(F.lit("[null, "), "all", F.lit("]\n")))
    record_files.write(arrays.select(F.concat_ws("_", "shape", "lot").alias("name"), whole.alias("value")).select(F.concat("name", F.lit(".json")).alias("name"), "value"), f"{path}/arrays")
    record_files.write(named.where("shape = 0").select(F.concat(C("doc_id").cast("string"), F.lit(".jsonl")).alias("name"), C("json").alias("value")), f"{path}/objects")
    return records.any_shape(s, path, "doc_id long, source string, n_chars long, text string", "source").select("doc_id", "n_chars", F.md5(C("text").cast("binary")).alias("text_md5"))


def _sample_lines(s: SparkSession, d: str) -> str:
    """One file whose line k is the k-th document, as a source row that is prepared in one way or the other, raw, or neither."""
    path = scratch.fresh_path(s, "samples")
    k = C("doc_id") % 5
    own = F.concat(F.lit('"doc_id": '), C("doc_id").cast("string"))
    body = F.when(k == 0, ', "prepared_review_sample": true').when(k == 1, ', "candidate_code": null, "reference_scores": {}').when(k == 2, ', "checklist_dimensions": ["d"], "answer": "", "private_test": {"input": ["1"]}').when(k == 3, ', "checklist_dimensions": ["d"], "answer": "", "public_test": {"input": []}').otherwise(', "candidate_code": "x"')
    documents(s, d).repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select(F.concat(F.lit("{"), own, body, F.lit("}")).alias("value")).write.text(path)
    return path


@query("SELECT line, doc_id, CASE WHEN doc_id % 5 < 2 THEN 'prepared' ELSE 'raw' END AS route FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, doc_id FROM documents) WHERE line >= 10 AND doc_id % 5 < 3")
def sliced_load(s: SparkSession, d: str) -> DataFrame:
    """Rows of a file from line 10 on, routed; those of no use are passed over."""
    return records.routed(s, _sample_lines(s, d), 10).select("line", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "route")


@query("SELECT line, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, doc_id FROM documents) WHERE line >= 10 AND doc_id % 5 < 3 ORDER BY line LIMIT 25")
def sliced_load_limited(s: SparkSession, d: str) -> DataFrame:
    """The limit counts rows that are kept."""
    return records.routed(s, _sample_lines(s, d), 10, 25).select("line", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


@query("SELECT line, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, doc_id, count(*) OVER () AS n FROM documents) WHERE line = n // 2")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    """The record at the middle line of a file."""
    found = records.json_lines(s, _sample_lines(s, d), "doc_id long").select("line", "record.doc_id")
    return records.record_at(found, found.count() // 2)


@query("SELECT row_number() OVER (ORDER BY first) - 1 AS \"at\", \"index\" FROM (SELECT l_orderkey AS \"index\", min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1)")
def index_list(s: SparkSession, d: str) -> DataFrame:
    """The order keys of all line items, with repeats, as a file of indices: each once, where it came first."""
    path = scratch.fresh_path(s, "indices")
    keys = T.read(s, d, "lineitem").select("l_orderkey", (C("l_orderkey") * 10 + C("l_linenumber")).alias("place"))
    keys.select(F.to_json(F.struct(C("l_orderkey").alias("index"), "place")).alias("value")).write.text(path)
    return records.listed(s.read.schema("index long, place long").json(path), "index", "place").select("at", "index")


@query("SELECT CAST(doc_id AS VARCHAR) AS dataset_index FROM documents WHERE doc_id % 3 = 0")
def resume_scan(s: SparkSession, d: str) -> DataFrame:
    """Ids of a file whose last line is torn."""
    path = scratch.fresh_path(s, "resume")
    done = documents(s, d).where("doc_id % 3 = 0").select(F.concat(F.lit('{"dataset_index": '), C("doc_id").cast("string"), F.lit("}")).alias("value"))
    done.unionByName(s.createDataFrame([('{"dataset_index": 99',)], "value string")).write.text(path)
    return records.completed_ids(s, path)


@query("SELECT doc_id, n_chars FROM documents")
def chunked_append(s: SparkSession, d: str) -> DataFrame:
    """Half of the rows, then all: what is there already isn't written again."""
    path = scratch.fresh_path(s, "append")
    rows = documents(s, d).select("doc_id", "n_chars")
    records.appended(s, rows.where("doc_id % 2 = 0"), path, "doc_id", 2)
    records.appended(s, rows, path, "doc_id", 2)
    return s.read.schema("doc_id long, n_chars long").json(path)


@query("SELECT doc_id || '_' || source || '.json' AS file, doc_id, n_chars, md5(text) AS text_md5 FROM documents")
def per_record_files(s: SparkSession, d: str) -> DataFrame:
    """One file a document, written in two runs of which the second finds half of them there."""
    path = scratch.fresh_path(s, "records")
    rows = documents(s, d).select("doc_id", "source", "n_chars", "text")
    for lot in ("doc_id % 2 = 0", "true"):
        records.write_per_record(rows.where(lot), path, "doc_id", "source")
    back = records.read_per_record(rows, path, "doc_id long, n_chars long, text string", "doc_id", "source")
    return back.select("file", "doc_id", "n_chars", F.md5(C("text").cast("binary")).alias("text_md5"))


@query("SELECT CAST(doc_id % 4 AS VARCHAR) AS subset, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS row, doc_id, lang, md5(text) AS text_md5 FROM documents")
def arrow_scan(s: SparkSession, d: str) -> DataFrame:
    """Whole documents written as four Arrow streams by tasks, a batch for each hundred or so rows, and read by batch."""
    path = scratch.fresh_path(s, "arrow")
    rows = documents(s, d).select((C("doc_id") % 4).cast("int").alias("lot"), "doc_id", "lang", "text")
    records.write_arrow_files(rows, path, "lot", ["doc_id"], "-train.arrow", 100)
    return records.arrow_files(s, path, "doc_id long, lang string, text string").select("subset", "row", "doc_id", "lang", F.md5(C("text").cast("binary")).alias("text_md5"))


@query("SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY 1")
def metadata_sidecar(s: SparkSession, d: str) -> DataFrame:
    path = scratch.fresh_path(s, "sidecar")
    records.write_sidecar(documents(s, d), path, {"by_lang": C("lang")}, seed=7)
    x = s.read.text(path).select(F.from_json("value", "total long, by_lang map<string,long>").alias("m"))
    return x.select(F.explode("m.by_lang").alias("lang", "n"), C("m.total").alias("total"))


@query("SELECT doc_id AS \"index\" FROM documents WHERE doc_id % 4 <> 0")
def skip_existing(s: SparkSession, d: str) -> DataFrame:
    """Documents without an output file, a quarter of them having one."""
    path = scratch.fresh_path(s, "existing")
    rows = documents(s, d).select(C("doc_id").alias("index"), "lang")
    done = rows.where("index % 4 = 0").select(F.concat(F.lit("raw_"), C("index").cast("string"), F.lit("_"), "lang", F.lit(".json")).alias("name"), F.lit("{}").alias("value"))
    record_files.write(done, path)
    return records.missing_outputs(rows, s, path).select("index")


@query(f"WITH {T.REVIEWS}, r AS (SELECT dimension, CASE WHEN error IS NULL THEN grade END AS p, target AS t FROM reviews WHERE target IS NOT NULL AND pos % 40 <> 13) SELECT dimension, count(*) AS n, count(p) AS n_valid, printf('%.4f', (count(p)::DOUBLE / count(*)))::DOUBLE AS valid_rate, printf('%.4f', avg(abs(p - t)))::DOUBLE AS mae, printf('%.4f', (median(abs(p - t))::DOUBLE))::DOUBLE AS median_error, printf('%.4f', avg(((p >= 3) = (t >= 3))::INT))::DOUBLE AS boundary_accuracy, printf('%.4f', corr(p, t) FILTER (p IS NOT NULL))::DOUBLE AS pearson FROM r GROUP BY 1")
def results_folder_summary(s: SparkSession, d: str) -> DataFrame:
    """Metrics of a folder of result files, lines in some and arrays in others; torn files are left out."""
    path = scratch.fresh_path(s, "results")
    rows = T.reviews(s, d).where("target is not null").select("pos", "dimension", F.when(C("error").isNull(), C("grade")).alias("predicted"), "target")
    lot = C("pos") % 40
    json = rows.select(lot.alias("lot"), F.floor(C("pos") / 4000).alias("run"), F.to_json(F.struct("*")).alias("json"))
    arrays = json.where("lot < 20").groupBy("lot", "run").agg(F.array_join(F.collect_list("json"), ",\n").alias("all"))
    record_files.write(arrays.select(F.concat_ws("_", F.lit("run"), "run", "lot").alias("name"), F.concat(F.lit("["), "all", F.when(C("lot") == 13, "").otherwise("]")).alias("value")), f"{path}/arrays")
    json.where("lot >= 20").select(C("json").alias("value")).write.text(f"{path}/lines")
    found = records.any_shape(s, path, "dimension string, predicted int, target int", "dimension")
    return found.groupBy("dimension").agg(*metrics.summary(C("predicted"), C("target")))


@query("SELECT o_orderkey AS k, count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM orders) GROUP BY 1")
def incremental_ingest(s: SparkSession, d: str) -> DataFrame:
    """Two lots of files, the second with keys of the first: each key comes out once."""
    path = scratch.fresh_path(s, "stream")
    rows = T.read(s, d, "orders").select(C("o_orderkey").alias("k"))
    for lot in ("k % 3 <> 0", "true"):
        rows.where(lot).write.mode("append").json(f"{path}/in")
        incremental.ingest(s, f"{path}/in", "k long", f"{path}/out", f"{path}/log", ["k"]).awaitTermination()
    return s.read.schema("k long").parquet(f"{path}/out").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS cust, coalesce(min(o_orderkey) FILTER (o_orderkey % 3 <> 0), min(o_orderkey)) AS k FROM orders GROUP BY 1")
def first_seen_ingest(s: SparkSession, d: str) -> DataFrame:
    """Each customer's first order by state: of the first lot of files that has the customer the least; the second lot repeats the first."""
    path = scratch.fresh_path(s, "first")
    rows = T.read(s, d, "orders").select(C("o_custkey").alias("cust"), C("o_orderkey").alias("k"))
    for lot in ("k % 3 <> 0", "true"):
        rows.where(lot).write.mode("append").json(f"{path}/in")
        first_seen.ingest(s, f"{path}/in", "cust long, k long", f"{path}/out", f"{path}/log", ["cust"], ["k"]).awaitTermination()
    return s.read.schema("cust long, k long").parquet(f"{path}/out")
