"""Queries on evaluation results, predictions, lengths and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as X
from ..operators import evaluate, metrics
from . import tables as T
from .registry import query, r6
from .tables import documents, text_of

C = F.col


@query(f"WITH {T.REVIEWS}, r AS (SELECT dimension, CASE WHEN error IS NULL THEN grade END AS p, target AS t FROM reviews WHERE target IS NOT NULL) SELECT dimension, count(*) AS n, count(p) AS n_valid, printf('%.4f', (count(p)::DOUBLE / count(*))::DOUBLE)::DOUBLE + 0.0 AS valid_rate, printf('%.4f', (avg(abs(p - t)))::DOUBLE)::DOUBLE + 0.0 AS mae, printf('%.4f', (median(abs(p - t))::DOUBLE)::DOUBLE)::DOUBLE + 0.0 AS median_error, printf('%.4f', (avg(((p >= 3) = (t >= 3))::INT))::DOUBLE)::DOUBLE + 0.0 AS boundary_accuracy, printf('%.4f', (corr(p, t) FILTER (p IS NOT NULL))::DOUBLE)::DOUBLE + 0.0 AS pearson FROM r GROUP BY 1")
def eval_summary(s: SparkSession, d: str) -> DataFrame:
    r = T.reviews(s, d).where("target is not null").withColumn("p", F.when(C("error").isNull(), C("grade")))
    return r.groupBy("dimension").agg(*metrics.summary(C("p"), C("target")))


def results(s: SparkSession, d: str) -> DataFrame:
    """Reviews as nested evaluation results, one record each, some without what a family of metrics needs."""
    parse = F.struct(C("error").isNull().alias("ok"), C("error").alias("error"))
    trace = F.array(F.struct(F.array(F.struct(text_of("grade: ", C("grade")).alias("continuation")), F.struct(F.lit("no mark").alias("continuation"))).alias("candidates")))
    dimension = F.struct(
        C("dimension"), C("target").alias("reference_axiom_grade"), F.when(C("pos") % 2 == 0, F.array(F.lit(5), F.lit(3))).alias("reference_axiom_interval"), F.lit("exact").alias("label_type"), (C("pos") / 2).cast("int").cast("string").alias("pair_id"),
        F.when(C("pos") % 2 == 0, "pos").otherwise("neg").alias("pair_role"), F.when(C("error").isNull(), C("grade")).alias("parsed_axiom_grade"), F.when(C("pos") % 3 == 0, C("grade")).alias("lenient_axiom_grade"), F.lit("none").alias("final_review"), parse.alias("final_review_parse"), trace.alias("trace"),
    )
    return T.reviews(s, d).select("pos", C("rec").alias("record_index"), F.array(dimension).alias("dimensions"))


ROWS = f"{T.REVIEWS}, m AS (SELECT pos, rec, dimension, error IS NULL AS valid, target AS reference, CASE WHEN pos % 2 = 0 THEN 3 END AS low, CASE WHEN pos % 2 = 0 THEN 5 END AS high, CASE WHEN error IS NULL THEN grade END AS parsed, grade AS lenient, pos // 2 AS pair, pos % 2 = 0 AS side, CASE WHEN pos % 7 = 0 THEN 2 WHEN pos % 5 = 0 THEN 1 ELSE 0 END AS bad FROM reviews)"


@query(f"WITH {ROWS} SELECT pos, dimension, valid, reference, low, high, parsed, lenient, CAST(pair AS VARCHAR) AS pair_id FROM m")
def metric_rows(s: SparkSession, d: str) -> DataFrame:
    return evaluate.metric_rows(results(s, d), "pos").select("pos", "dimension", "valid", "reference", "low", "high", "parsed", "lenient", "pair_id")


def _family_sql(prefix: str, grade: str, ok: str) -> str:
    own = f"{ok} AND {grade} IS NOT NULL AND reference IS NOT NULL"
    rate = lambda hit, among: f"round_even(avg(({hit})::INT) FILTER ({among}), 6) + 0.0"
    ranged = f"{ok} AND {grade} IS NOT NULL AND low IS NOT NULL"
    return ", ".join(
        [
            f"round_even(avg(abs({grade} - reference)) FILTER ({own}), 6) + 0.0 AS {prefix}grade_mae", f"round_even(median(abs({grade} - reference)) FILTER ({own})::DOUBLE, 6) + 0.0 AS {prefix}grade_median_abs_error",
            f"{rate(f'({grade} >= 3) = (reference >= 3)', own)} AS {prefix}boundary_acc", f"{rate(f'reference >= 3 AND {grade} < 3', own)} AS {prefix}low_grade_false_positive_rate", f"{rate(f'reference < 3 AND {grade} >= 3', own)} AS {prefix}high_grade_false_negative_rate",
            f"{rate(f'{grade} BETWEEN low AND high', ranged)} AS {prefix}interval_acc", f"{rate(f'({grade} >= 3) = (high >= 3)', ranged)} AS {prefix}interval_boundary_acc",
        ]
    )


EVIDENCE = "round_even(count(*) FILTER (valid AND bad > 0)::DOUBLE / greatest(count(*) FILTER (valid), 1), 6) + 0.0 AS unsupported_evidence_rate, coalesce(sum(bad) FILTER (valid), 0)::BIGINT AS unsupported_evidence_count, count(*) FILTER (valid AND bad = 2) AS unsupported_provided_test_failure, count(*) FILTER (valid AND bad > 0) AS unsupported_unused_identifier"


@query(f"WITH {ROWS} SELECT dimension, count(*) AS dimension_count, count(*) FILTER (valid) AS valid_count, round_even(count(*) FILTER (valid)::DOUBLE / count(*), 6) + 0.0 AS valid_rate, {_family_sql('', 'parsed', 'valid')}, count(*) FILTER (lenient IS NOT NULL AND reference IS NOT NULL) AS lenient_count, round_even(count(*) FILTER (lenient IS NOT NULL AND reference IS NOT NULL)::DOUBLE / count(*), 6) + 0.0 AS lenient_rate, {_family_sql('lenient_', 'lenient', 'true')}, {EVIDENCE} FROM m GROUP BY 1")
def eval_metric_families(s: SparkSession, d: str) -> DataFrame:
    """All families: of valid reviews, lenient grades, intervals, unsupported evidence."""
    kinds = F.when(C("pos") % 7 == 0, F.array(F.lit("provided_test_failure"), F.lit("unused_identifier"))).when(C("pos") % 5 == 0, F.array(F.lit("unused_identifier"))).otherwise(F.array().cast("array<string>"))
    rows = evaluate.metric_rows(results(s, d), "pos").withColumn("kinds", kinds)
    return rows.groupBy("dimension").agg(*evaluate.families(F.size("kinds"), C("kinds")))


@query(f"WITH {ROWS}, p AS (SELECT dimension, pair, max(parsed) FILTER (side) AS a, max(parsed) FILTER (NOT side) AS b FROM m GROUP BY 1, 2) SELECT dimension, count(*) AS pairs, round_even(avg((a > b)::INT), 6) + 0.0 AS accuracy FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def pairwise_by_dimension(s: SparkSession, d: str) -> DataFrame:
    return evaluate.pairwise_accuracy(evaluate.metric_rows(results(s, d), "pos"), "pair_id", "pair_role", "parsed", "pos", by=("dimension",))


@query("WITH p AS (SELECT doc_id // 2 AS pair_id, max(n_chars % 6) FILTER (doc_id % 2 = 0) AS a, max(n_chars % 6) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY 1) SELECT count(*) AS pairs, round_even(avg((a > b)::INT), 6) + 0.0 AS accuracy FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def pairwise_accuracy(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(F.floor(C("doc_id") / 2).alias("pair_id"), F.when(C("doc_id") % 2 == 0, "pos").otherwise("neg").alias("role"), (C("n_chars") % 6).alias("grade"), "doc_id")
    return evaluate.pairwise_accuracy(rows, "pair_id", "role", "grade", "doc_id")


@query(f"WITH {T.REVIEWS}, x AS (SELECT rec, error IS NULL AS valid, CASE WHEN error IS NULL THEN grade * 20.0::DOUBLE END AS p, target * 20.0::DOUBLE AS t FROM reviews) SELECT rec, count(*) AS dimension_count, count(*) FILTER (valid) AS valid_review_count, round_even(count(*) FILTER (valid)::DOUBLE / count(*), 6) + 0.0 AS valid_review_rate, round_even(avg(p), 6) + 0.0 AS mean_parsed_score, round_even(avg(t), 6) + 0.0 AS mean_reference_score, round_even(avg(abs(p - t)), 6) + 0.0 AS mean_abs_score_delta FROM x GROUP BY 1")
def dimension_summary(s: SparkSession, d: str) -> DataFrame:
    rows = T.reviews(s, d).select("rec", C("error").isNull().alias("valid"), F.when(C("error").isNull(), C("grade") * 20.0).alias("parsed_score"), (C("target") * 20.0).alias("reference_score"))
    return rows.groupBy("rec").agg(*evaluate.dimension_summary())


@query(f"WITH {T.REVIEWS}, n AS (SELECT CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'b' END AS tag, count(*)::DOUBLE AS n, round_even(avg(grade), 6) + 0.0 AS g FROM reviews GROUP BY 1) SELECT 'n' AS metric, max(n) FILTER (tag = 'a') AS a, max(n) FILTER (tag = 'b') AS b FROM n UNION ALL SELECT 'g', max(g) FILTER (tag = 'a'), max(g) FILTER (tag = 'b') FROM n")
def run_comparison(s: SparkSession, d: str) -> DataFrame:
    sums = T.reviews(s, d).groupBy(F.when(C("pos") % 2 == 0, "a").otherwise("b").alias("tag")).agg(F.count("*").alias("n"), r6(F.avg("grade")).alias("g"))
    return evaluate.compared(sums, "tag", ["n", "g"])


@query("SELECT e.event_id AS pos, coalesce(d.source, 'own') AS problem, CASE WHEN d.doc_id IS NULL THEN '' ELSE d.lang END AS code FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % 2000 AND e.event_id % 3 <> 0")
def results_to_sources(s: SparkSession, d: str) -> DataFrame:
    records = documents(s, d).select(F.lit("f").alias("file"), C("doc_id").alias("line"), C("source").alias("problem"), C("lang").alias("candidate_code"), F.lit(None).cast("array<string>").alias("tests"))
    mine = T.reviews(s, d).select("pos", F.when(C("pos") % 3 != 0, "f").alias("input_record"), (C("pos") % 2000).alias("record_index"), F.lit("own").alias("problem"))
    return evaluate.sources_of(mine, records).select("pos", "problem", C("candidate_code").alias("code"))


# predictions --------------------------------------------------------------------------------------------------------------------------
FUSE = "CASE WHEN c >= 3 THEN greatest(3, CAST(round_even(median, 0) AS INT)) ELSE least(2, CAST(round_even(median, 0) AS INT)) END"


@query(f"WITH {T.REVIEWS}, g AS (SELECT rec, arg_min(grade, pos) AS c FROM reviews GROUP BY 1), pool AS (SELECT rec, c, grade FROM reviews JOIN g USING (rec) WHERE (grade >= 3) = (c >= 3) UNION ALL SELECT rec, c, c FROM g UNION ALL SELECT rec, c, c FROM g), m AS (SELECT rec, c, median(grade) AS median FROM pool GROUP BY 1, 2), a AS (SELECT rec, CAST(round_even(median(grade), 0) AS INT) AS all_ FROM reviews GROUP BY 1) SELECT rec, CASE WHEN rec % 4 = 0 THEN all_ ELSE {FUSE} END AS fused, CASE WHEN rec % 4 = 0 THEN 'median_fallback_no_correctness' ELSE 'correctness_boundary_first' END AS method FROM m JOIN a USING (rec)")
def boundary_first_fusion(s: SparkSession, d: str) -> DataFrame:
    packed = T.reviews(s, d).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("pos", "grade"))).alias("p"))
    named = F.transform("p", lambda x, i: F.struct(F.when((i == 0) & (C("rec") % 4 != 0), evaluate.CORRECTNESS).otherwise("Style").alias("dimension"), x["grade"].alias("grade")))
    return packed.withColumn("f", evaluate.fused(named)).select("rec", C("f.grade").alias("fused"), C("f.method").alias("method"))


@query(f"WITH {T.REVIEWS}, x AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN grade WHEN pos % 3 = 1 THEN least(5, grade) END AS p, target AS t FROM reviews) SELECT pos, p AS predicted, abs(p - t) AS error, coalesce((p >= 3) = (t >= 3), false) AS boundary FROM x")
def tree_predictions(s: SparkSession, d: str) -> DataFrame:
    """Best reviews' details -> a record's prediction: a predicted grade, else the parsed one; torn details give none."""
    details = F.when(C("pos") % 3 == 0, text_of('{"predicted_axiom_grade": ', C("grade"), "}")).when(C("pos") % 3 == 1, text_of('{"parsed": {"grade": ', C("grade"), "}}")).otherwise("{torn")
    best = F.array(F.struct(F.lit(evaluate.CORRECTNESS).alias("dimension"), F.lit("0").alias("tag"), C("q").alias("q_value"), details.alias("reward_details")))
    x = evaluate.predictions(T.reviews(s, d).select("pos", best.alias("best"), C("target").alias("axiom_target_grade")))
    return x.select("pos", C("predicted_axiom_grade").alias("predicted"), C("grade_abs_error").alias("error"), C("boundary_correct").alias("boundary"))


# candidates ---------------------------------------------------------------------------------------------------------------------------
PENALTY = "CASE WHEN pos % 4 = 0 THEN 1.0::DOUBLE WHEN grade < 3 AND pos % 4 <> 1 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"WITH {T.REVIEWS} SELECT rec, pos, rank FROM (SELECT rec, pos, row_number() OVER (PARTITION BY rec ORDER BY round_even(q - {PENALTY}, 6) DESC, round_even(q * 0.5::DOUBLE, 6) DESC, pos) AS rank FROM reviews)")
def candidate_rank_penalized(s: SparkSession, d: str) -> DataFrame:
    text = F.when(C("pos") % 4 == 0, F.lit("no mark at all")).when(C("pos") % 4 == 1, text_of('{"grade": ', C("grade"), "} as it fails on 0")).otherwise(text_of('{"grade": ', C("grade"), "}"))
    x = T.reviews(s, d).withColumns({"score": F.bround(evaluate.candidate_score(C("q"), text), 6), "last": F.bround(C("q") * 0.5, 6)})
    return evaluate.ranked(x, ["rec"], "score", "last", ["pos"]).select("rec", "pos", "rank")


@query(f"WITH {T.REVIEWS} SELECT rec, arg_max(pos, (q, -pos)) AS best, min(pos) AS first FROM reviews GROUP BY 1")
def best_candidate(s: SparkSession, d: str) -> DataFrame:
    r = T.reviews(s, d)
    first = evaluate.best_candidate(r, ["rec"], None, ["pos"]).select("rec", C("pos").alias("first"))
    return evaluate.best_candidate(r, ["rec"], "q", ["pos"]).select("rec", C("pos").alias("best")).join(first, "rec")


@query(f"WITH {T.REVIEWS} SELECT rec, round_even(max(q) - min(q), 6) + 0.0 AS spread FROM reviews GROUP BY 1")
def value_spread(s: SparkSession, d: str) -> DataFrame:
    return T.reviews(s, d).groupBy("rec").agg(evaluate.spread_over("q").alias("spread")).select("rec", r6(C("spread")).alias("spread"))


# lengths ------------------------------------------------------------------------------------------------------------------------------
def _quantiles(index: str) -> str:
    at = lambda p: f"h[CAST({index.format(f'{p}::DOUBLE * (c - 1)')} AS BIGINT) + 1]"
    return f"WITH n AS (SELECT CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents), l AS (SELECT list_sort(list(n)) AS h, count(*) AS c FROM n) SELECT h[1] AS least, (h[(c - 1) // 2 + 1] + h[c // 2 + 1]) // 2 AS median, {at(0.9)} AS p90, {at(0.95)} AS p95, {at(0.99)} AS p99, h[c] AS most FROM l"


@query(_quantiles("floor({})"))
def token_length_quantiles(s: SparkSession, d: str) -> DataFrame:
    return metrics.length_quantiles(documents(s, d).select(F.size(F.split("text", " ")).alias("n")), "n")


@query(_quantiles("round_even({}, 0)"))
def token_length_quantiles_rounded(s: SparkSession, d: str) -> DataFrame:
    return metrics.length_quantiles(documents(s, d).select(F.size(F.split("text", " ")).alias("n")), "n", rounded=True)


WORDS = r"len(regexp_extract_all({}, '[^\t-\r\x1C-\x20\x{{85}}\p{{Z}}]+'))"


@query(f"SELECT doc_id, CAST({WORDS.format('text')} + 1 + {WORDS.format('source')} + {WORDS.format('lang')} AS INT) AS n_tokens FROM documents WHERE {WORDS.format('text')} + 1 + {WORDS.format('source')} + {WORDS.format('lang')} <= 200")
def token_budget_filter(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", X.token_length(C("text"), F.array("source", text_of(" ", C("lang")))).alias("n_tokens")).where("n_tokens <= 200")


@query(f"WITH {T.NODES} SELECT rec, arg_max(q, ln) AS last, round_even(avg(q), 6) + 0.0 AS mean, min(q) AS min, round_even(0.7::DOUBLE * avg(q) + 0.3::DOUBLE * min(q), 6) + 0.0 AS mix, max(q) AS max FROM nodes GROUP BY rec")
def value_sequence_stats(s: SparkSession, d: str) -> DataFrame:
    packed = T.nodes(s, d).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("ln", "q"))).alias("p"))
    return packed.select("rec", *[(r6(c) if k in ("mean", "mix") else c).alias(k) for k, c in metrics.sequence_stats(C("p.q")).items()])


@query(f"WITH {T.SAMPLES} SELECT quality, subset, count(*) AS n FROM samples GROUP BY GROUPING SETS ((quality), (subset), ())")
def hist_group_levels(s: SparkSession, d: str) -> DataFrame:
    return T.samples(s, d).groupingSets([["quality"], ["subset"], []], "quality", "subset").agg(F.count("*").alias("n"))


# losses -------------------------------------------------------------------------------------------------------------------------------
LOSS = f"{T.REVIEWS}, l AS (SELECT dimension, pos, grade / 5.0::DOUBLE AS v, q, CASE WHEN error IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w, pos % 6 <> 0 AS marked FROM reviews), e AS (SELECT *, CASE WHEN marked THEN (power(greatest(least(q, 0.1::DOUBLE) - v, 0), 2) + power(greatest(v - greatest(q, 0.1::DOUBLE), 0), 2)) / (1 + 1e-6) ELSE 0 END AS i, CASE WHEN marked THEN power(greatest(0.1::DOUBLE - CASE WHEN q >= 0 THEN 1 ELSE -1 END * v, 0), 2) / (1 + 1e-6) ELSE 0 END AS b FROM l)"


@query(f"WITH {LOSS} SELECT dimension, round_even(sum(i * CASE WHEN marked THEN w ELSE 0 END) / (sum(CASE WHEN marked THEN w ELSE 0 END) + 1e-6), 6) + 0.0 AS interval, round_even(sum(b * CASE WHEN marked THEN w ELSE 0 END) / (sum(CASE WHEN marked THEN w ELSE 0 END) + 1e-6), 6) + 0.0 AS sign FROM e GROUP BY 1")
def token_losses(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(-100.0)
    q = F.array(none, F.when(C("pos") % 6 != 0, C("q")).otherwise(none))
    interval, sign, marked = evaluate.token_losses(F.array(F.lit(9.0), C("grade") / 5.0), q, q, F.array(none, F.lit(0.1)))
    x = T.reviews(s, d).select("dimension", interval.alias("i"), sign.alias("b"), marked.alias("m"), F.when(C("error").isNull(), 1.0).otherwise(0.5).alias("w"))
    return x.groupBy("dimension").agg(r6(evaluate.weighted_loss(C("i"), C("w"), C("m"))).alias("interval"), r6(evaluate.weighted_loss(C("b"), C("w"), C("m"))).alias("sign"))


@query(f"WITH {T.REVIEWS}, p AS (SELECT pos // 2 AS pair, max(q) FILTER (pos % 2 = 0) AS a, max(q) FILTER (pos % 2 = 1) AS b FROM reviews GROUP BY 1) SELECT count(*) AS pairs, round_even(avg(power(greatest(0.2::DOUBLE - (a - b), 0), 2)), 6) + 0.0 AS loss FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def pair_margin_loss(s: SparkSession, d: str) -> DataFrame:
    rows = T.reviews(s, d).select("pos", F.floor(C("pos") / 2).alias("pair"), F.when(C("pos") % 2 == 0, "positive").otherwise("neg_response").alias("role"), "q")
    x = evaluate.pair_loss(rows, "pair", "role", "q", "pos")
    return x.select("pairs", r6(C("loss")).alias("loss"))


