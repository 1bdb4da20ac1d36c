"""Value labels of training items: stage standardization and blending, calibration, consensus, policy flags, collapse.

Items are rows with parallel arrays (response, q_value, raw_q_value, q_descendant_best, q_stage). Statistics are small tables that are
aggregated once and come back as one broadcast row, so that items are never shuffled for them; a consensus comes back by a join on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades, texts, udfs
from ..functions.exact import half_even

EPSILON = 1e-6
#: The value that stands for none, and the names of the methods.
IGNORED = -100.0
STAGE_METHOD, CALIBRATION_METHOD = "stage_best_descendant_v1", "dimension_standardize_v1"
BLEND = (0.5, 0.3, 0.2)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _round4(x: Column) -> Column:
    return half_even(x, 4)


def _truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _moments(value: str) -> list[Column]:
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")]


def statistics(values: DataFrame, key: str, value: str) -> DataFrame:
    """One row: all_n, all_mean, all_sd, and parts, a map from key to (n, mean, sd). The keys are few: stages, dimensions."""
    both = values.groupingSets([[key], []], key).agg(F.grouping(key).alias("is_all"), *_moments(value))
    whole = F.col("is_all") == 1
    part = F.struct(F.col(key), F.struct("n", "mean", "sd"))
    found = both.agg(F.max(F.when(whole, F.struct("n", "mean", "sd"))).alias("all"), F.map_from_entries(F.collect_list(F.when(~whole, part))).alias("parts"))
    return found.select(F.coalesce("all.n", F.lit(0)).alias("all_n"), F.col("all.mean").alias("all_mean"), F.col("all.sd").alias("all_sd"), "parts")


def mapped(q: Column, part: Column, all_mean: Column, all_sd: Column) -> Column:
    """q moved from a part's mean and deviation to those of all."""
    return all_mean + (q - part["mean"]) / part["sd"] * all_sd


# stages -------------------------------------------------------------------------------------------------------------------------------
def stage_values(items: DataFrame) -> DataFrame:
    """(stage, q) of all segments whose item has no error, whose value is known and whose stage is named."""
    pairs = F.arrays_zip(F.col("raw_q_value").alias("q"), F.col("q_stage").alias("stage"))
    rows = items.where(~_truthy(F.col("terminal_error"))).select(F.explode(pairs).alias("p")).select("p.stage", F.col("p.q").alias("q"))
    return rows.where(F.col("q").isNotNull() & (F.col("q") != IGNORED) & _truthy(F.col("stage")))


def standardized(q: Column, stage: Column) -> Column:
    """A value on the scale of all stages, beside the columns of `statistics`; as it is where all or its stage has under two values or no spread."""
    part = F.col("parts")[stage]
    on = (F.col("all_n") >= 2) & (F.col("all_sd") > EPSILON) & (q != IGNORED) & (part["n"] >= 2) & (part["sd"] > EPSILON)
    return F.when(on, _round4(clamp(mapped(q, part, F.col("all_mean"), F.col("all_sd"))))).otherwise(q)


def blended(items: DataFrame, weights: tuple[float, float, float] = BLEND) -> DataFrame:
    """Items with q_value mixed from raw, best-descendant and standardized values, and label_change: `adjusted`, `unchanged` or why it was skipped.

    A path's last segment and reviews keep their raw value; unknown values stay; items with an error stay as they are. Weights that don't
    add up to more than zero change nothing. Items without raw values, as corrections are, take no part in the stages' statistics."""
    total = sum(weights)
    if total <= 0:
        return items.withColumn("label_change", F.lit("skip_invalid_weights"))
    raw_w, best_w, stage_w = (w / total for w in weights)
    x = items.crossJoin(F.broadcast(statistics(stage_values(items), "stage", "q")))  # one row
    x = x.withColumn("_own", F.col("raw_q_value").isNotNull()).withColumn("raw_q_value", F.coalesce("raw_q_value", "q_value"))
    raw, last = F.col("raw_q_value"), F.size("raw_q_value") - 1
    derived = F.transform("response", lambda s, i: texts.stage(i, F.size("response"), s))
    x = x.withColumns({"q_descendant_best": F.coalesce("q_descendant_best", raw), "q_stage": F.coalesce("q_stage", derived)})

    def label(q: Column, i: Column) -> Column:
        stage = F.coalesce(F.get("q_stage", i), F.lit(""))
        best = F.coalesce(F.get("q_descendant_best", i), q)
        mixed = raw_w * q + best_w * best + stage_w * F.when(F.col("_own"), standardized(q, stage)).otherwise(q)
        return F.when(q == IGNORED, q).when((stage == "review") | (i == last), _round4(clamp(q))).otherwise(_round4(clamp(mixed)))

    skipped = F.when((F.size(raw) <= 0) | (F.size("q_descendant_best") != F.size(raw)), "skipped_items").when(_truthy(F.col("terminal_error")), "skipped_terminal_error")
    x = x.withColumn("_new", F.transform(raw, label)).withColumn("label_change", F.coalesce(skipped, F.when(F.col("_new") == raw, "unchanged").otherwise("adjusted")))
    on = F.col("label_change") == "adjusted"
    x = x.withColumns(
        {
            "q_value": F.when(on, F.col("_new")).otherwise(F.col("q_value")),
            "terminal_q_value": F.when(on, F.get("_new", last)).otherwise(F.col("terminal_q_value")),
            "q_label_method": F.when(on, STAGE_METHOD),
            "q_label_weights": F.when(on, F.struct(*[F.lit(round(w, 4)).alias(n) for w, n in ((raw_w, "raw"), (best_w, "best_descendant"), (stage_w, "stage"))])),
        }
    )
    return x.drop("_new", "_own", "all_n", "all_mean", "all_sd", "parts")


# calibration --------------------------------------------------------------------------------------------------------------------------
def calibrator(terminals: DataFrame, least: int) -> DataFrame:
    """terminals(target_dimension, q_value, terminal_error) -> one row: enabled, reason, all_n, all_mean, all_sd, parts (of dimensions in use).

    Off with fewer than max(2, least) values, or without a dimension of `least` values that, like all, vary."""
    good = terminals.where(_truthy(F.col("target_dimension")) & ~_truthy(F.col("terminal_error")) & (F.col("q_value") != IGNORED))
    x = statistics(good.select("target_dimension", "q_value"), "target_dimension", "q_value")
    used = F.map_filter("parts", lambda k, p: (p["n"] >= least) & (p["sd"] > EPSILON) & (F.col("all_sd") > EPSILON))
    few = F.col("all_n") < max(2, least)
    reason = F.when(few, "not_enough_anchor_values").when(F.size(used) == 0, "not_enough_dimension_values")
    return x.withColumn("parts", F.when(few, F.create_map().cast("map<string,struct<n:bigint,mean:double,sd:double>>")).otherwise(used)).withColumn("reason", reason).withColumn("enabled", reason.isNull())


def calibrated(items: DataFrame, stats: DataFrame, strength: float = 0.35) -> DataFrame:
    """Items with values moved towards the scale of all dimensions; what was before stays in pre_calibration_q_value, raw values stay.

    calibration_change: `calibrated`, `unchanged`, or why the item was skipped; null where the calibrator is off."""
    s = max(0.0, min(1.0, strength))
    x = items.crossJoin(F.broadcast(stats.select("enabled", "all_mean", "all_sd", "parts")))  # one row
    part = F.col("parts")[F.coalesce("target_dimension", F.lit(""))]
    move = lambda q: F.when(q == IGNORED, q).otherwise(_round4(clamp((1 - s) * q + s * mapped(q, part, F.col("all_mean"), F.col("all_sd")))))
    skipped = F.when(part.isNull(), "skipped_missing_dimension").when(_truthy(F.col("terminal_error")), "skipped_terminal_error")
    x = x.withColumn("_new", F.transform("q_value", move))
    x = x.withColumn("calibration_change", F.when(F.col("enabled"), F.coalesce(skipped, F.when(F.col("_new") == F.col("q_value"), "unchanged").otherwise("calibrated"))))
    on = F.coalesce(F.col("calibration_change") == "calibrated", F.lit(False))
    info = F.struct(F.lit(CALIBRATION_METHOD).alias("method"), F.lit(s).alias("strength"), *[half_even(c, 6).alias(f"anchor_{n}") for c, n in ((F.col("all_mean"), "global_mean"), (F.col("all_sd"), "global_std"), (part["mean"], "dimension_mean"), (part["sd"], "dimension_std"))])
    x = x.withColumns(
        {
            "pre_calibration_q_value": F.when(on, F.col("q_value")),
            "pre_calibration_terminal_q_value": F.when(on, F.col("terminal_q_value")),
            "raw_q_value": F.coalesce("raw_q_value", F.when(on, F.col("q_value"))),
            "q_value": F.when(on, F.col("_new")).otherwise(F.col("q_value")),
            "terminal_q_value": F.when(on & (F.size("_new") > 0), F.get("_new", F.size("_new") - 1)).otherwise(F.col("terminal_q_value")),
            "q_calibration": F.when(on, info),
        }
    )
    return x.drop("_new", "enabled", "all_mean", "all_sd", "parts")


# consensus ----------------------------------------------------------------------------------------------------------------------------
def consensus(terminals: DataFrame, order: list[str], least: int = 3, keys: tuple[str, ...] = ("dataset_index", "target_dimension")) -> DataFrame:
    """terminals(*keys, *order, grade, target, error): one row for each key with at least `least` grades and a target.

    Grades of rows with an error don't count, but the rows do; the target is the first in order. Grades are 0 to 5, so a key's are six counts, which
    add up in any order: median and deviation follow from them, one shuffle does, and no task holds a key's rows."""
    rows = terminals.where(_truthy(F.col("target_dimension"))).withColumn("grade", F.when(~_truthy(F.col("error")), F.col("grade").cast("int")))
    first = F.min(F.when(F.col("target").isNotNull(), F.struct(*order, F.col("target").cast("double").alias("target"))))["target"]
    counts = F.array(*[F.struct(F.lit(float(g)).alias("v"), F.count_if(F.col("grade") == g).alias("n")) for g in range(6)])
    found = rows.groupBy(*keys).agg(counts.alias("_counts"), F.count("grade").alias("valid_count"), F.count("*").alias("total_count"), first.alias("target_axiom_grade"))
    found = found.where((F.col("valid_count") >= least) & F.col("target_axiom_grade").isNotNull())
    out = found.withColumn("median_axiom_grade", _median(F.col("_counts"), F.col("valid_count")))
    off = F.transform("_counts", lambda g: F.struct(F.abs(g["v"] - F.col("median_axiom_grade")).alias("v"), g["n"].alias("n")))
    out = out.withColumn("mad", _median(F.sort_array(off), F.col("valid_count"))).withColumn("valid_rate", F.col("valid_count") / F.col("total_count")).drop("_counts")
    out = out.withColumn("target_alignment", F.greatest(F.lit(0.0), 1 - F.abs(F.col("median_axiom_grade") - F.col("target_axiom_grade")) / 5.0))
    out = out.withColumn("dispersion_confidence", F.greatest(F.lit(0.0), 1 - F.col("mad") / 2.5))
    return out.withColumn("confidence", F.col("valid_rate") * F.col("dispersion_confidence")).withColumn("reward", 2 * F.col("target_alignment") - 1)


def _median(counts: Column, n: Column) -> Column:
    """The median of values given as (v, n) in order, n in all."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))

    def at(k: Column) -> Column:
        step = lambda s, g: F.struct((s["seen"] + g["n"]).alias("seen"), F.coalesce(s["v"], F.when(s["seen"] + g["n"] > k, g["v"])).alias("v"))
        return F.aggregate(counts, start, step, lambda s: s["v"])

    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0


CONSENSUS = ["median_axiom_grade", "mad", "valid_count", "total_count", "valid_rate", "target_axiom_grade", "target_alignment", "dispersion_confidence", "confidence", "reward"]


def item_alignment(grade: Column, score: Column, median: Column) -> Column:
    """How near an item's grade (else its score, of 10 or 100) is to the median; 1 where it has neither."""
    own = F.coalesce(grade.cast("double"), grades.grade_from_scalar(score, F.when(grades.number(score) <= 10, 10.0).otherwise(100.0)).cast("double"))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(own - median) / 5.0), F.lit(1.0))


def with_consensus(items: DataFrame, summary: DataFrame, strength: float = 0.25, mode: str = "weight", keys: tuple[str, ...] = ("dataset_index", "target_dimension")) -> DataFrame:
    """Items with score_consensus, and by mode `weight` loss weights, or by `q_adjust` values moved towards the consensus' reward.

    consensus_change: `weighted`, `adjusted`, `unchanged`, or why the item was skipped; items without a consensus stay as they are."""
    if mode not in ("weight", "q_adjust"):
        raise ValueError(f"no such mode: {mode}")
    s = max(0.0, min(1.0, strength))
    x = items.join(summary.select(*keys, F.struct(*CONSENSUS).alias("_c")), list(keys), "left")
    c, error = F.col("_c"), _truthy(F.col("terminal_error"))
    x = x.withColumn("_align", item_alignment(F.col("parsed_axiom_grade"), F.col("parsed_score"), c["median_axiom_grade"]))
    x = x.withColumn("_eff", s * c["confidence"] * F.col("_align"))
    shown = [(c[n] if n in ("valid_count", "total_count") else half_even(c[n], 4)).alias(n) for n in CONSENSUS]
    shown += [half_even(c["median_axiom_grade"] * 20.0, 4).alias("median_score"), half_even(c["target_axiom_grade"] * 20.0, 4).alias("target_score"), F.lit(s).alias("strength"), F.lit(mode).alias("mode")]
    shown += [F.when(~error, half_even("_align", 4)).alias("item_alignment"), F.when(~error, half_even("_eff", 4)).alias("effective_strength")]
    x = x.withColumn("score_consensus", F.when(c.isNotNull(), F.struct(*shown)))
    on = c.isNotNull() & ~error
    skipped = F.when(c.isNull(), "skipped_missing").when(error, "skipped_terminal_error")
    if mode == "weight":
        weight = _round4(F.greatest(F.lit(0.0), 1 - s + 2 * F.col("_eff")))
        x = x.withColumn("consensus_change", F.coalesce(skipped, F.lit("weighted")))
        for name in ("value_loss_weight", "lm_loss_weight"):
            x = x.withColumn(name, F.when(on, weight).otherwise(F.col(name)))
    else:
        x = x.withColumn("_new", F.transform("q_value", lambda q: F.when(q == IGNORED, q).otherwise(_round4(clamp((1 - F.col("_eff")) * q + F.col("_eff") * c["reward"])))))
        x = x.withColumn("consensus_change", F.coalesce(skipped, F.when(F.col("_new") == F.col("q_value"), "unchanged").otherwise("adjusted")))
        moved = F.coalesce(F.col("consensus_change") == "adjusted", F.lit(False))
        x = x.withColumns(
            {
                "pre_consensus_q_value": F.when(moved, F.col("q_value")),
                "q_value": F.when(moved, F.col("_new")).otherwise(F.col("q_value")),
                "terminal_q_value": F.when(moved & (F.size("_new") > 0), F.get("_new", F.size("_new") - 1)).otherwise(F.col("terminal_q_value")),
            }
        ).drop("_new")
    return x.drop("_c", "_align", "_eff")


# policy -------------------------------------------------------------------------------------------------------------------------------
def eligible(least_q: float) -> Column:
    """Whether an item may train the policy, its reasoning apart."""
    c = F.col
    match = grades.clamp_grade(c("parsed_axiom_grade")) == grades.clamp_grade(c("target_axiom_grade"))
    quiet = (F.coalesce(F.size("verifier_feedback"), F.lit(0)) <= 0) | F.coalesce(c("allow_verifier_policy"), F.lit(False))
    return F.coalesce(c("is_best_path") & (c("terminal_q_value") >= least_q) & c("terminal_error").isNull() & ~F.coalesce(c("force_value_only"), F.lit(False)) & match & quiet, F.lit(False))


def refreshed(items: DataFrame, least_q: float = 0.5) -> DataFrame:
    """Items with train_lm decided anew, and policy_change: `upgraded`, `downgraded` or null. Weak reasoning blocks an item that would or did train."""
    x = items.withColumn("_old", F.coalesce("train_lm", F.lit(False))).withColumn("_fit", eligible(least_q))
    x = x.withColumn("_issue", texts.quality_issue(F.col("response"), udfs.repeated_steps(F.col("response"))))
    blocked = F.col("_issue").isNotNull() & (F.col("_old") | F.col("_fit"))
    x = x.withColumns(
        {
            "train_lm": F.col("_fit") & F.col("_issue").isNull(),
            "force_value_only": blocked | F.coalesce("force_value_only", F.lit(False)),
            "policy_block_reason": F.when(blocked, "weak_or_malformed_reasoning").otherwise(F.col("policy_block_reason")),
            "policy_reasoning_quality_issue": F.when(blocked, F.col("_issue")).otherwise(F.col("policy_reasoning_quality_issue")),
        }
    )
    change = F.when(F.col("train_lm") & ~F.col("_old"), "upgraded").when(~F.col("train_lm") & F.col("_old"), "downgraded")
    return x.withColumns({"lm_loss_weight": F.when(~F.col("train_lm") & F.col("force_value_only"), 0.0).otherwise(F.col("lm_loss_weight")), "policy_change": change}).drop("_old", "_fit", "_issue")


def collapsed(items: DataFrame) -> DataFrame:
    """Items that train the policy cut to their last review; parallel arrays follow where they are as long as the response. Others stay."""
    at = F.array_max(F.filter(F.transform("response", lambda s, i: F.when(texts.lstrip(s).startswith(texts.REVIEW), i)), lambda i: i.isNotNull()))
    x = items.withColumn("_at", F.when(F.coalesce("train_lm", F.lit(False)), at)).withColumn("_size", F.size("response"))
    on = F.col("_at").isNotNull()
    cut = lambda name: F.when(on & (F.size(name) == F.col("_size")), F.slice(name, F.col("_at") + 1, F.lit(1))).otherwise(F.col(name))
    names = [n for n in ("q_value", "raw_q_value", "q_node_tags", "q_descendant_best", "q_stage", "response") if n in items.columns]
    return x.withColumns({n: cut(n) for n in names}).withColumn("policy_response_mode", F.when(on, "final_review")).drop("_at", "_size")
