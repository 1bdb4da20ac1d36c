"""Projections of the driver's tables that the reference-style operators run on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import convert, trees

C = F.col


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def samples(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", "text", F.col("lang").alias("subset"), "source", "n_chars", "quality", "toxic",
        F.when(F.col("quality") == 1, "Correct").when(F.col("quality") == 0, "Error").alias("correctness"),
        F.least(F.lit(10), F.floor(F.col("n_chars") / 500)).cast("double").alias("score"),
    )


SAMPLES = """samples AS (SELECT d.doc_id, d.text, d.lang AS subset, d.source, d.n_chars, l.quality, l.toxic,
 CASE WHEN l.quality = 1 THEN 'Correct' WHEN l.quality = 0 THEN 'Error' END AS correctness,
 CAST(least(10, d.n_chars // 500) AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id)),
graded AS (SELECT *, CASE WHEN quality = 1 THEN CASE WHEN n_chars <= 500 THEN 3 WHEN n_chars <= 2000 THEN 4 ELSE 5 END
 ELSE CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 2000 THEN 1 ELSE 2 END END AS grade FROM samples)"""


def graded(spark: SparkSession, d: str) -> DataFrame:
    step = lambda a: F.when(F.col("n_chars") <= 500, a).when(F.col("n_chars") <= 2000, a + 1).otherwise(a + 2)
    return samples(spark, d).withColumn("grade", F.when(F.col("quality") == 1, step(3)).otherwise(step(0)))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as a binary tree of any size: the n-th line has the n-th place of a heap, its tag the way there from the root."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    items = read(spark, d, "lineitem").withColumn("ln", F.row_number().over(w))
    tag = F.concat(F.lit("0"), F.regexp_replace(F.substring(F.bin("ln"), 2, 64), "(.)", ".$1"))
    return items.select(
        F.col("l_orderkey").alias("rec"), "ln", tag.alias("tag"), (F.bround(F.col("l_discount") * 20 - 1, 4) + 0.0).alias("q"), F.col("l_returnflag").alias("dimension"), F.col("l_linestatus").alias("status"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
    )


NODES = r"""nodes AS (SELECT l_orderkey AS rec, CAST(ln AS INT) AS ln, '0' || regexp_replace(substr(bin(ln), 2), '(.)', '.\1', 'g') AS tag, round_even(l_discount * 20 - 1, 4) + 0.0 AS q,
 l_returnflag AS dimension, l_linestatus AS status, l_partkey AS p, l_suppkey AS s FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
 l_suppkey, l_extendedprice, l_quantity) AS ln FROM lineitem)),
lineages AS (SELECT *, unnest(list_transform(range(1, len(string_split(tag, '.')) + 1), lambda i: array_to_string(string_split(tag, '.')[1:i], '.'))) AS anc FROM nodes)"""


def _detailed(n: DataFrame) -> DataFrame:
    """Nodes as a search leaves them: steps, and reviews with their details, some of them faulty in every way that matters."""
    p, text = C("p"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    target = C("rec") % 6
    pred = F.when(p % 2 == 0, target).otherwise(C("s") % 6)
    verdict = F.when(pred >= 4, "accept").when(pred == 3, "minor_issue").otherwise("major_issue")
    kind = F.when(p % 5 == 0, "none").otherwise("deduced_counterexample")
    evidence = F.when(p % 11 == 0, "[]").otherwise(text('["input ', p, '"]'))
    parsed = text('{"axiom_grade": ', pred, ', "score": ', pred * 20, ', "verdict": "', verdict, '", "functional_correctness": ', F.when(pred >= 3, "true").otherwise("false"), ', "repair_effort": "none", "evidence_type": "', kind, '", "evidence": ', evidence, "}")
    check = '{"fact_checks": [{"kind": "provided_test_failure", "claim": "evidence_type=provided_test_failure", "supported": false, "actual": {"reason": "no_listed_executable_tests"}}]}'
    cap = '[{"reason": "unsupported_provided_test_failure_evidence", "cap": 0.15}]'
    faults = F.when(p % 7 == 0, f', "evidence_details": {check}, "reward_caps": {cap}').otherwise("")
    sound = text('{"parsed": ', parsed, ', "predicted_axiom_grade": ', pred, ', "target_axiom_grade": ', target, ', "target_score": ', target * 20, faults, "}")
    details = F.when(p % 17 == 0, "{broken").when(p % 13 == 0, '{"error": "invalid_review_json"}').otherwise(sound)
    step = F.when(p % 19 == 0, "  ").when(p % 23 == 0, text("Premature final review draft retained as a reasoning note, not as the final scored review: ", p)).when(p % 3 == 0, text("<step>\nPart ", p)).otherwise(text(" Look at part ", p, "."))
    done = C("status") == "F"
    return n.withColumns(
        {
            "target_dimension": F.when(p % 29 == 0, "").otherwise(C("dimension")), "text": F.when(done, text("<review>\n", parsed, "\n</review>")).otherwise(step), "final_answer": F.when(done, parsed).otherwise(""),
            "reward_details": F.when(done, details), "q_value": C("q"),
        }
    )


TRAJ = f"""{NODES},
base AS (SELECT *, rec % 6 AS target, CASE WHEN p % 2 = 0 THEN rec % 6 ELSE s % 6 END AS pred FROM nodes),
said AS (SELECT *, '{{"axiom_grade": ' || pred || ', "score": ' || pred * 20 || ', "verdict": "' || CASE WHEN pred >= 4 THEN 'accept' WHEN pred = 3 THEN 'minor_issue' ELSE 'major_issue' END || '", "functional_correctness": '
 || CASE WHEN pred >= 3 THEN 'true' ELSE 'false' END || ', "repair_effort": "none", "evidence_type": "' || CASE WHEN p % 5 = 0 THEN 'none' ELSE 'deduced_counterexample' END || '", "evidence": '
 || CASE WHEN p % 11 = 0 THEN '[]' ELSE '["input ' || p || '"]' END || '}}' AS parsed FROM base),
traj AS (SELECT rec, ln, tag, q, pred, target, status = 'F' AS done, p, CASE WHEN p % 29 = 0 THEN '' ELSE dimension END AS dim, parsed,
 CASE WHEN status = 'F' THEN '<review>' || chr(10) || parsed || chr(10) || '</review>' WHEN p % 19 = 0 THEN '  ' WHEN p % 23 = 0 THEN 'Premature final review draft retained as a reasoning note, not as the final scored review: ' || p
  WHEN p % 3 = 0 THEN '<step>' || chr(10) || 'Part ' || p ELSE ' Look at part ' || p || '.' END AS text,
 CASE WHEN status <> 'F' THEN NULL WHEN p % 17 = 0 THEN 'invalid_reward_details' WHEN p % 13 = 0 THEN 'invalid_review_json' END AS error FROM said),
seg AS (SELECT *, CASE WHEN trim(text) = '' THEN NULL WHEN done THEN text WHEN starts_with(text, '<step>') THEN text || chr(10) || '</step>' ELSE '<step>' || chr(10) || trim(text) || chr(10) || '</step>' END AS segment FROM traj),
anc AS (SELECT t.rec, t.tag, unnest(list_transform(range(1, len(string_split(t.tag, '.')) + 1), lambda i: array_to_string(string_split(t.tag, '.')[1:i], '.'))) AS up FROM traj t),
bestd AS (SELECT a.rec, a.up AS tag, max(t.q) AS best FROM anc a JOIN traj t ON t.rec = a.rec AND t.tag = a.tag WHERE t.done AND t.error IS NULL GROUP BY 1, 2),
best AS (SELECT rec, tag FROM (SELECT rec, tag, row_number() OVER (PARTITION BY rec, dim ORDER BY q DESC, ln) AS r FROM traj WHERE done AND dim <> '') WHERE r = 1),
term AS (SELECT t.*, b.tag IS NOT NULL AS is_best, regexp_replace(t.tag, '(^|\\.)[^.]*$', '') AS up, CASE WHEN error IS NULL THEN p % 7 = 0 ELSE false END AS fault FROM traj t LEFT JOIN best b USING (rec, tag) WHERE t.done),
firsts AS (SELECT *, row_number() OVER (PARTITION BY rec, dim, up, pred, p % 5 = 0 ORDER BY NOT is_best, ln) AS same FROM term)"""


NODE = ["tag", "text", "q_value", "final_answer", "target_dimension", "reward_details"]


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trajectory records: one row each, as the source's JSON objects are."""
    packed = trees.packed(_detailed(nodes(spark, d)), ["rec"], ["ln"], *NODE)
    made = packed.select(
        C("rec").alias("order"), F.lit("unit").alias("source"), F.lit("unit").alias("subset"), C("rec").cast("string").alias("dataset_index"), F.concat(F.lit("Return "), C("rec").cast("string")).alias("problem"),
        F.lit("def f(): pass").alias("candidate_code"), F.lit("python").alias("language"), "react",
    )
    return made.withColumn("best_tags", F.transform(convert.best_tags(C("react")), lambda b: b["tag"]))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").select(
        F.col("user_id").alias("rec"), F.col("event_type").alias("dimension"), F.col("event_id").alias("pos"), (k % 6).alias("grade"),
        F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 6).cast("int")).alias("target"), ((F.col("event_id") * 37 % 201 - 100) / 100.0).alias("q"),
        F.when(F.col("event_id") % 11 == 0, "invalid").alias("error"), "props",
    )


REVIEWS = """reviews AS (SELECT user_id AS rec, event_type AS dimension, event_id AS pos, CAST(json_extract_string(props, '$.k') AS INT) % 6 AS grade,
 CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 6 AS INT) END AS target, (event_id * 37 % 201 - 100) / 100.0::DOUBLE AS q,
 CASE WHEN event_id % 11 = 0 THEN 'invalid' END AS error, props FROM events)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("rec"), F.col("turn").alias("pos"), "role", "text")


TURNS = "turns AS (SELECT conv_id AS rec, turn AS pos, role, text FROM conversations)"


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
