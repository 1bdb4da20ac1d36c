"""Evaluation results: metric rows, their families of metrics, predictions of trees, ranks of candidates, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades, texts
from ..functions.exact import half_even
from ..functions.grades import let
from .reward import CORRECTNESS


def _rate(hit: Column, among: Column) -> Column:
    return half_even(F.avg(F.when(among, hit.cast("double"))), 6) + 0.0


def sources_of(results: DataFrame, records: DataFrame, file: str = "input_record", index: str = "record_index") -> DataFrame:
    """Results with problem, candidate_code and tests of the record they name; without one, their own."""
    named = records.select(F.col("file").alias("_file"), F.col("line").alias("_line"), *[F.col(n).alias(f"_{n}") for n in ("problem", "candidate_code", "tests")])
    joined = results.join(named, (F.col(file) == F.col("_file")) & (F.col(index) == F.col("_line")), "left")
    empty = {"problem": F.lit(""), "candidate_code": F.lit(""), "tests": F.array().cast("array<string>")}
    own = lambda n: F.col(n) if n in results.columns else F.lit(None).cast("array<string>" if n == "tests" else "string")
    return joined.withColumns({n: F.coalesce(f"_{n}", own(n), e) for n, e in empty.items()}).drop("_file", "_line", *[f"_{n}" for n in empty])


def lenient_of(dimension: Column) -> Column:
    """A result's lenient grade, else that of its final review and of all candidates' texts together."""
    said = F.flatten(F.transform(dimension["trace"], lambda t: F.transform(t["candidates"], lambda c: F.coalesce(c["continuation"], F.lit("")))))
    text = F.concat_ws("\n", F.coalesce(dimension["final_review"], F.lit("")), F.array_join(F.coalesce(said, F.array().cast("array<string>")), "\n"))
    return F.coalesce(dimension["lenient_axiom_grade"], grades.lenient_grade(text))


def metric_rows(results: DataFrame, *keep: str) -> DataFrame:
    """Nested results -> a row for each record and dimension: valid, reference, low, high, parsed, lenient, pair_id, pair_role."""
    c = F.col
    x = results.select(*keep, F.explode("dimensions").alias("d"))
    interval = F.when(F.size("d.reference_axiom_interval") == 2, F.array_sort("d.reference_axiom_interval"))
    return x.select(
        *keep, c("d.dimension").alias("dimension"), F.coalesce("d.final_review_parse.ok", F.lit(False)).alias("valid"), c("d.reference_axiom_grade").alias("reference"), interval[0].alias("low"), interval[1].alias("high"),
        c("d.parsed_axiom_grade").alias("parsed"), lenient_of(c("d")).alias("lenient"), c("d.label_type").alias("label_type"), c("d.pair_id").alias("pair_id"), c("d.pair_role").alias("pair_role"),
    )


def families(unsupported: Column | None = None, kinds: Column | None = None) -> list[Column]:
    """Metrics over metric rows: of valid reviews, of lenient grades, of intervals; null where a family has no rows.

    unsupported: how many checks of a valid review failed; kinds: the kinds of those, as an array."""
    c = F.col
    valid = F.coalesce(c("valid"), F.lit(False))
    out = [F.count("*").alias("dimension_count"), F.count_if(valid).alias("valid_count"), (half_even(F.count_if(valid) / F.greatest(F.count("*"), F.lit(1)), 6) + 0.0).alias("valid_rate")]
    for prefix, grade, ok in (("", c("parsed"), valid), ("lenient_", c("lenient"), F.lit(True))):
        own = ok & grade.isNotNull() & c("reference").isNotNull()
        error = F.when(own, F.abs(grade - c("reference")).cast("double"))
        if prefix:
            out += [F.count_if(own).alias("lenient_count"), (half_even(F.count_if(own) / F.greatest(F.count("*"), F.lit(1)), 6) + 0.0).alias("lenient_rate")]
        out += [
            (half_even(F.avg(error), 6) + 0.0).alias(f"{prefix}grade_mae"), (half_even(F.median(error), 6) + 0.0).alias(f"{prefix}grade_median_abs_error"), _rate((grade >= 3) == (c("reference") >= 3), own).alias(f"{prefix}boundary_acc"),
            _rate((c("reference") >= 3) & (grade < 3), own).alias(f"{prefix}low_grade_false_positive_rate"), _rate((c("reference") < 3) & (grade >= 3), own).alias(f"{prefix}high_grade_false_negative_rate"),
        ]
        ranged = ok & grade.isNotNull() & c("low").isNotNull()
        out += [_rate(grade.between(c("low"), c("high")), ranged).alias(f"{prefix}interval_acc"), _rate((grade >= 3) == (c("high") >= 3), ranged).alias(f"{prefix}interval_boundary_acc")]
    if unsupported is not None:
        n = F.when(valid, F.coalesce(unsupported, F.lit(0))).otherwise(0)
        of = lambda kind: F.coalesce(F.sum(F.when(valid, F.size(F.filter(kinds, lambda k: k == kind))).otherwise(0)), F.lit(0)).cast("bigint").alias(f"unsupported_{kind}")
        out += [(half_even(F.count_if(n > 0) / F.greatest(F.count_if(valid), F.lit(1)), 6) + 0.0).alias("unsupported_evidence_rate"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("unsupported_evidence_count")]
        if kinds is not None:
            out += [of("provided_test_failure"), of("unused_identifier")]
    return out


def pairwise_accuracy(df: DataFrame, pair: str, role: str, grade: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """pairs and accuracy: the share of comparable pairs whose positive is graded strictly higher; a role's last grade counts. One row without pairs."""
    good = df.where(F.col(pair).isNotNull() & (F.col(pair).cast("string") != "") & F.col(grade).isNotNull())
    last = lambda r: F.max(F.when(F.col(role) == r, F.struct(order, grade)))[grade]
    sides = good.groupBy(*by, pair).agg(last("pos").alias("pos"), last("neg").alias("neg")).where("pos is not null and neg is not null")
    return sides.groupBy(*by).agg(F.count("*").alias("pairs"), (half_even(F.avg((F.col("pos") > F.col("neg")).cast("double")), 6) + 0.0).alias("accuracy"))


def dimension_summary() -> list[Column]:
    """Over rows(valid, parsed_score, reference_score): how many, how many valid, and means of scores and of their differences."""
    c = F.col
    delta = F.abs(grades.score_delta(c("parsed_score"), c("reference_score")))
    mean = lambda x: half_even(F.avg(x.cast("double")), 6) + 0.0
    return [
        F.count("*").alias("dimension_count"), F.count_if("valid").alias("valid_review_count"), (half_even(F.count_if("valid") / F.greatest(F.count("*"), F.lit(1)), 6) + 0.0).alias("valid_review_rate"), mean(c("parsed_score")).alias("mean_parsed_score"),
        mean(c("reference_score")).alias("mean_reference_score"), mean(delta).alias("mean_abs_score_delta"),
    ]


def compared(summaries: DataFrame, tag: str, metrics: list[str]) -> DataFrame:
    """Summaries of runs, a column each: (metric, run...)."""
    tall = summaries.select(tag, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    return tall.groupBy("metric").pivot(tag).agg(F.first("value"))


# predictions --------------------------------------------------------------------------------------------------------------------------
def _median(xs: Column) -> Column:
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2.0
    return let(F.array_sort(xs), middle)


def fused(reviews: Column) -> Column:
    """(grade, method) of reviews (dimension, grade): correctness fixes the side, the others may refine on it; without correctness, the median."""

    def of(x: Column) -> Column:
        own, every = x["own"], x["every"]
        side = F.filter(every, lambda g: (g >= 3) == (own >= 3))
        mid = let(_median(F.concat(F.array(own, own), side)), grades.clamp_grade)
        held = F.when(own >= 3, F.greatest(F.lit(3), mid)).otherwise(F.least(F.lit(2), mid))
        grade = F.when(own.isNotNull(), held).when(F.size(every) > 0, let(_median(every), grades.clamp_grade))
        method = F.when(F.size(every) == 0, "no_valid_dimension").when(own.isNull(), "median_fallback_no_correctness").otherwise("correctness_boundary_first")
        return F.struct(grade.alias("grade"), method.alias("method"))

    valid = F.transform(F.filter(reviews, lambda r: r["grade"].isNotNull()), lambda r: F.struct(r["dimension"].alias("dimension"), grades.clamp_grade(r["grade"]).alias("grade")))
    parts = lambda v: F.struct(F.get(F.filter(v, lambda r: r["dimension"] == CORRECTNESS), 0)["grade"].alias("own"), F.transform(v, lambda r: r["grade"]).alias("every"))
    return let(let(valid, parts), of)


def predictions(records: DataFrame) -> DataFrame:
    """records(best array of (dimension, tag, q_value, reward_details), axiom_target_grade, ...) -> predicted_axiom_grade, method, error, boundary."""

    def grade(details: Column) -> Column:
        d = texts.sound_details(details)
        return F.coalesce(grades.json_typed_number(d, "$.predicted_axiom_grade"), grades.grade_from_payload(F.get_json_object(d, "$.parsed")).cast("double"))

    x = records.withColumn("_fused", fused(F.transform("best", lambda b: F.struct(b["dimension"].alias("dimension"), grade(b["reward_details"]).alias("grade")))))
    p, t = F.col("predicted_axiom_grade"), F.col("axiom_target_grade")
    x = x.withColumn("predicted_axiom_grade", F.col("_fused.grade")).withColumn("method", F.col("_fused.method")).drop("_fused")
    return x.withColumns({"grade_abs_error": F.abs(p - t), "boundary_correct": F.coalesce((p >= 3) == (t >= 3), F.lit(False))})


# candidates ---------------------------------------------------------------------------------------------------------------------------
def candidate_score(value: Column, text: Column, final: Column | bool = True, format_penalty: float = 1.0, evidence_penalty: float = 0.4) -> Column:
    """A candidate's value; of a final review less a penalty if no grade can be read from it, or if a low one has no concrete evidence."""
    grade = grades.lenient_grade(F.coalesce(text, F.lit("")))
    loss = F.when(grade.isNull(), format_penalty).when((grade < 3) & ~texts.concrete_evidence(text), evidence_penalty).otherwise(0.0)
    return value - F.when(final if isinstance(final, Column) else F.lit(final), loss).otherwise(0.0)


def ranked(candidates: DataFrame, keys: list[str], score: str, last_value: str, order: list[str]) -> DataFrame:
    """Candidates with `rank` from 1: by score, then last value, then in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(last_value), *order)
    return candidates.withColumn("rank", F.row_number().over(w).cast("long"))


def best_candidate(candidates: DataFrame, keys: list[str], reward: str | None, order: list[str]) -> DataFrame:
    """The candidate with the best reward, of equal ones the first; without a reward the first candidate."""
    w = Window.partitionBy(*keys).orderBy(*([F.desc(reward)] if reward else []), *order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def spread_over(value: str) -> Column:
    """How far a group's values lie apart, as an aggregate; null without any."""
    return F.max(value) - F.min(value)


def spread(values: Column) -> Column:
    """Largest less smallest value, 0 for none."""
    return F.coalesce(F.array_max(values) - F.array_min(values), F.lit(0.0))


# losses -------------------------------------------------------------------------------------------------------------------------------
def _hinge2(x: Column) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), F.lit(2.0))


def weighted_loss(loss: Column, weight: Column, any_: Column) -> Column:
    """Mean of rows' losses by weight; rows without marked tokens have none."""
    w = F.when(any_, weight).otherwise(0.0)
    return F.sum(loss * w) / (F.sum(w) + 1e-6)


def token_losses(values: Column, q: Column, low: Column, high: Column, ignored: float = -100.0) -> tuple[Column, Column, Column]:
    """(interval loss, sign loss, whether any token is marked) of a row: means over its marked tokens."""
    tokens = F.filter(F.arrays_zip(values.alias("v"), q.alias("q"), low.alias("a"), high.alias("b")), lambda t: t["q"] != ignored)
    mean = lambda f: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + f(t)) / (F.size(tokens) + 1e-6)
    interval = mean(lambda t: _hinge2(F.least(t["a"], t["b"]) - t["v"]) + _hinge2(t["v"] - F.greatest(t["a"], t["b"])))
    sign = mean(lambda t: _hinge2(0.1 - F.when(t["q"] >= 0, 1.0).otherwise(-1.0) * t["v"]))
    return interval, sign, F.size(tokens) > 0


def pair_loss(rows: DataFrame, pair: str, role: str, value: str, order: str, margin: float = 0.2) -> DataFrame:
    """pairs and loss: the mean squared shortfall of the margin by which positives should exceed negatives; 0 without pairs."""
    kind = texts.pair_role(F.col(role))
    last = lambda r: F.max(F.when((kind == r) & F.col(value).isNotNull(), F.struct(order, value)))[value]
    sides = rows.where(F.coalesce(F.col(pair).cast("string"), F.lit("")) != "").groupBy(pair).agg(last("pos").alias("p"), last("neg").alias("n")).where("p is not null and n is not null")
    return sides.agg(F.count("*").alias("pairs"), F.coalesce(F.avg(_hinge2(margin - (F.col("p") - F.col("n")))), F.lit(0.0)).alias("loss"))
