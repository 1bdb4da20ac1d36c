"""Queries on grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grades as G
from . import tables as T
from .registry import column, query, r6
from .tables import text_of

C = F.col
CLAMP = "greatest(0, least(5, CAST(round_even({}, 0) AS INT)))"
VERDICT = "CASE WHEN {0} >= 4 THEN 'accept' WHEN {0} = 3 THEN 'minor_issue' ELSE 'major_issue' END"
EFFORTS = "['rewrite', 'major_functional', 'minor_functional', 'major_quality', 'minor_quality', 'none']"
FROM_CORRECTNESS = "CASE WHEN correctness = 'Correct' THEN CASE WHEN score <= 6 THEN 3 WHEN score <= 8 THEN 4 ELSE 5 END WHEN score <= 1 THEN 0 WHEN score <= 3 THEN 1 ELSE 2 END"

column("grade_clamp", T.samples, ["doc_id"], lambda: {"grade": G.clamp_grade(C("score") / 2), "from_text": G.clamp_grade((C("score") - 2.5).cast("string"))}, T.SAMPLES, f"{CLAMP.format('score / 2')} AS grade, {CLAMP.format('score - 2.5')} AS from_text", "samples")
column("grade_scalar", T.graded, ["doc_id"], lambda: {"scalar": G.scalar_score(C("grade"))}, T.SAMPLES, "grade * 20.0::DOUBLE AS scalar", "graded")
column("grade_value_target", T.graded, ["doc_id"], lambda: {"target": r6(G.value_target(C("grade")))}, T.SAMPLES, "round_even(printf('%.4f', (grade / 2.5::DOUBLE - 1)::DOUBLE)::DOUBLE, 6) + 0.0 AS target", "graded")
column("grade_from_scalar", T.samples, ["doc_id"], lambda: {"grade": G.grade_from_scalar(C("n_chars") % 101, C("doc_id") % 3 * 50)}, T.SAMPLES, f"CASE WHEN doc_id % 3 * 50 > 0 THEN {CLAMP.format('(n_chars % 101)::DOUBLE / (doc_id % 3 * 50)::DOUBLE * 5')} END AS grade", "samples")
column("grade_from_correctness", T.samples, ["doc_id"], lambda: {"grade": G.grade_from_correctness(C("correctness"), C("score"))}, T.SAMPLES, f"{FROM_CORRECTNESS} AS grade", "samples")
column("grade_interval_binary", T.samples, ["doc_id"], lambda: dict(zip(("low", "high"), G.interval_from_binary(C("quality")), strict=True)), T.SAMPLES, "CASE WHEN quality = 1 THEN 3 ELSE 0 END AS low, CASE WHEN quality = 1 THEN 5 ELSE 2 END AS high", "samples")
column("grade_verdict", T.graded, ["doc_id"], lambda: {"verdict": G.verdict(C("grade"))}, T.SAMPLES, f"{VERDICT.format('grade')} AS verdict", "graded")
column("grade_boundary", T.graded, ["doc_id"], lambda: {"correct": G.functionally_correct(C("grade"))}, T.SAMPLES, "grade >= 3 AS correct", "graded")
column("repair_effort", T.graded, ["doc_id"], lambda: {"effort": G.repair_effort(C("grade"))}, T.SAMPLES, f"{EFFORTS}[grade + 1] AS effort", "graded")


def payload() -> Column:
    return F.when(C("pos") % 4 == 0, text_of('{"grade": ', C("grade"), "}")).when(C("pos") % 4 == 1, text_of('{"score": ', C("pos") % 130, "}")).when(C("pos") % 4 == 2, F.lit('{"axiom_grade": true}')).otherwise(F.lit('{"x": 1}'))


column("grade_from_payload", T.reviews, ["pos"], lambda: {"grade": G.grade_from_payload(payload())}, T.REVIEWS, f"CASE WHEN pos % 4 = 0 THEN grade WHEN pos % 4 = 1 THEN CASE WHEN pos % 130 <= 5 THEN CAST(pos % 130 AS INT) WHEN pos % 130 <= 100 THEN {CLAMP.format('(pos % 130) / 20.0::DOUBLE')} END WHEN pos % 4 = 2 THEN 1 END AS grade", "reviews")
column("grade_alignment", T.reviews, ["pos"], lambda: {"alignment": r6(G.alignment(C("grade"), C("target")))}, T.REVIEWS, "CASE WHEN target IS NOT NULL THEN round_even(greatest(0.0, 1 - abs(grade - target) / 5.0::DOUBLE), 6) + 0.0 END AS alignment", "reviews")
column("verdict_from_score", T.samples, ["doc_id"], lambda: {"verdict": G.verdict_from_score(C("n_chars") % 101), "agreement": G.verdict_agreement(G.verdict_from_score(C("n_chars") % 101), G.verdict_from_score(C("score")))}, T.SAMPLES + ", v AS (SELECT *, CASE WHEN n_chars % 101 >= CASE WHEN n_chars % 101 <= 5 THEN 4 ELSE 80 END THEN 0 WHEN n_chars % 101 >= CASE WHEN n_chars % 101 <= 5 THEN 3 ELSE 60 END THEN 1 ELSE 2 END AS a, CASE WHEN score >= CASE WHEN score <= 5 THEN 4 ELSE 80 END THEN 0 WHEN score >= CASE WHEN score <= 5 THEN 3 ELSE 60 END THEN 1 ELSE 2 END AS b FROM samples)", "['accept', 'minor_issue', 'major_issue'][a + 1] AS verdict, 1 - abs(a - b) / 2.0::DOUBLE AS agreement", "v")
column("target_grade_reconcile", T.graded, ["doc_id"], lambda: {"target": G.reconcile_target(F.when(C("doc_id") % 7 != 0, C("grade")), (C("doc_id") % 3) / 2.0, C("toxic") == 0)}, T.SAMPLES, "CASE WHEN doc_id % 7 = 0 THEN CASE doc_id % 3 WHEN 2 THEN 4 WHEN 1 THEN 2 ELSE 1 END WHEN toxic = 0 AND doc_id % 3 = 2 AND grade < 3 THEN 3 WHEN toxic = 0 AND doc_id % 3 = 0 AND grade >= 3 THEN 2 ELSE grade END AS target", "graded")


def details() -> Column:
    """A grade, a score as a number, or a score as text."""
    score = C("pos") % 90
    return F.when(C("pos") % 3 == 0, text_of('{"target_axiom_grade": ', C("grade"), ', "target_score": 7}')).when(C("pos") % 3 == 1, text_of('{"target_score": ', score, "}")).otherwise(text_of('{"target_axiom_grade": "4", "target_score": "', score, '"}'))


column("target_grade_from_details", T.reviews, ["pos"], lambda: {"grade": G.target_from_details(details())}, T.REVIEWS, f"CASE WHEN pos % 3 = 0 THEN grade WHEN pos % 3 = 1 AND pos % 90 > 10 THEN {CLAMP.format('(pos % 90)::DOUBLE / 100 * 5')} ELSE {CLAMP.format('(pos % 90)::DOUBLE / 10 * 5')} END AS grade", "reviews")


@query(f"WITH {T.SAMPLES} SELECT doc_id, CASE WHEN toxic = 1 THEN printf('%.2f', (0.6::DOUBLE * score + 0.4::DOUBLE * (10.0 * 0.5::DOUBLE))::DOUBLE)::DOUBLE + 0.0 ELSE score END AS correctness, score AS clarity FROM samples")
def dimension_targets(s: SparkSession, d: str) -> DataFrame:
    scores = F.create_map(F.lit("Correctness Verification"), C("score"), F.lit("Clarity"), C("score"))
    out = T.samples(s, d).withColumn("t", G.dimension_targets(scores, F.lit(0.5), C("toxic") == 1))
    return out.select("doc_id", (C("t")["Correctness Verification"] + 0.0).alias("correctness"), C("t")["Clarity"].alias("clarity"))


def free_text() -> Column:
    """A grade written in one of five ways, the last one of several counting."""
    g = C("grade")
    ways = [text_of('{"grade": 1} then {"axiom_grade": ', g, ', "note": 9}'), text_of('{"axiom_grade": ', g, '.4, "score": 100}'), text_of("Overall GRADE is about ", g, ".7 of 5"), text_of('no mark, {"score": ', C("pos") % 101, "}"), F.lit("upgrade: none")]
    return F.coalesce(*[F.when(C("pos") % 5 == k, w) for k, w in enumerate(ways)])


column("lenient_grade_last_match", T.reviews, ["pos"], lambda: {"grade": G.lenient_grade(free_text())}, T.REVIEWS, f"CASE pos % 5 WHEN 0 THEN grade WHEN 1 THEN grade WHEN 2 THEN least(5, grade + 1) WHEN 3 THEN {CLAMP.format('(pos % 101) / 20.0::DOUBLE')} END AS grade", "reviews")
column(
    "parsed_review_delta", T.reviews, ["pos"], lambda: {"score": G.parsed_score(C("error").isNull(), payload()), "grade": G.parsed_grade(C("error").isNull(), payload()), "delta": r6(G.score_delta(G.parsed_score(C("error").isNull(), payload()), C("target") * 20))},
    T.REVIEWS + f", g AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN pos % 4 = 0 THEN grade WHEN pos % 4 = 1 THEN CASE WHEN pos % 130 <= 5 THEN CAST(pos % 130 AS INT) WHEN pos % 130 <= 100 THEN {CLAMP.format('(pos % 130) / 20.0::DOUBLE')} END WHEN pos % 4 = 2 THEN 1 END END AS g FROM reviews), sc AS (SELECT *, CASE WHEN g IS NOT NULL THEN g * 20.0::DOUBLE WHEN error IS NULL AND pos % 4 = 1 THEN (pos % 130)::DOUBLE END AS sc FROM g)",
    "sc AS score, g AS grade, round_even(sc - target * 20, 6) + 0.0 AS delta", "sc",
)


@query(f"WITH {T.REVIEWS} SELECT CASE WHEN target IS NULL THEN 'unknown' WHEN grade - target <= -2 THEN 'under_2plus' WHEN grade - target = -1 THEN 'under_1' WHEN grade = target THEN 'exact' WHEN grade - target = 1 THEN 'over_1' ELSE 'over_2plus' END AS bucket, count(*) AS n FROM reviews GROUP BY 1")
def delta_bucket_hist(s: SparkSession, d: str) -> DataFrame:
    return T.reviews(s, d).groupBy(G.delta_bucket(C("grade") - C("target")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {T.REVIEWS} SELECT pos, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, q * 3)) AS reward, CASE WHEN error IS NULL THEN q ELSE -100.0::DOUBLE END AS numeric FROM reviews")
def reward_clamp(s: SparkSession, d: str) -> DataFrame:
    return T.reviews(s, d).select("pos", G.clamp_reward(C("q") * 3).alias("reward"), G.numeric_q(F.when(C("error").isNull(), C("q").cast("string")).otherwise("x")).alias("numeric"))
