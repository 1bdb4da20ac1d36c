"""Raw rows of several shapes -> samples, static training items and manifest rows. Projections only; tests are never run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades, texts
from ..functions.exact import half_even
from .reward import CORRECTNESS

#: The rubric, scales, label types and confidences of sources.
RUBRIC = "Judge whether the code satisfies the task requirements and whether there are concrete logic bugs."
VALUE_SCALE = "axiom_grade_0_5_mapped_to_tanh_-1_1"
PROXY_TESTS = "No executable tests are available. Use the AXIOM refinement-effort label as the objective scoring anchor."
PROXY_SOURCE = "axiom_grade_boundary_proxy"
CONFIDENCE = {"exact": 1.0, "exact_mapped": 0.9, "interval_correctness": 0.65, "pairwise_interval_proxy": 0.6}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _blank(c: Column) -> Column:
    return texts.strip(_text(c)) == ""


def all_tests(public: Column, private: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(public, none), F.coalesce(private, none))


# predicates ---------------------------------------------------------------------------------------------------------------------------
def usable(answer: Column, tests: Column, most_chars: int, dimensions: Column | None = None) -> Column:
    """A candidate with an answer that isn't blank or too long, with tests and, if dimensions are given, with some of those."""
    ok = ~_blank(answer) & (F.length(_text(answer)) <= most_chars) & (F.size(tests) > 0)
    return F.coalesce(ok & (F.size(dimensions) > 0) if dimensions is not None else ok, F.lit(False))


def ordinal_grade(score: Column, textual: bool = False) -> Column:
    """A score as a whole number: a number is cut, text (textual) must be one already."""
    if textual:
        return F.when(score.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(score).try_cast("int"))
    return grades.number(score).try_cast("int")


def ordinal_usable(grade: Column, code: Column, inst: Column, most_chars: int) -> Column:
    return F.coalesce(grade.between(0, 5) & ~_blank(code) & ~_blank(inst) & (F.length(_text(code)) <= most_chars), F.lit(False))


def skip_reason(rough: Column, good: Column, low: int, high: int, final: Column | None = None) -> Column:
    """Why a candidate doesn't get into a seed set; null if it does."""
    out = F.when(rough.isNull(), "missing_grade").when(~good, "unusable").when(~rough.between(low, high), F.concat(F.lit("outside_rough_grade_range_"), rough.cast("string")))
    return out if final is None else out.when(~final.between(low, high), F.concat(F.lit("outside_final_grade_range_"), final.cast("string")))


def first_per_source(rows: DataFrame, source: str, order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each source in scan order; 0 keeps all."""
    if limit <= 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def both_sides(pairs: DataFrame, pair: str, pos: str, neg: str, order: list[str]) -> DataFrame:
    """Pairs that have both sides; of equal pair ids the first."""
    ok = pairs.where((_text(F.col(pos)) != "") & (_text(F.col(neg)) != ""))
    return ok.withColumn("_n", F.row_number().over(Window.partitionBy(pair).orderBy(*order))).where("_n = 1").drop("_n")


# objective ----------------------------------------------------------------------------------------------------------------------------
def pass_rate(passed: Column, cap: int | None = None) -> Column:
    """The share of tests passed, of the first cap if one is given; 0 without tests. passed: array of booleans, as a runner gave them."""
    some = F.slice(passed, 1, cap) if cap else passed
    return F.when(F.size(some) > 0, half_even(F.size(F.filter(some, lambda p: p)) / F.size(some), 4)).otherwise(0.0)


def objective(public: Column, private: Column, tests: Column, executable: Column, cap: int | None = None) -> Column:
    """Pass rates of public and private tests, and of both together, of which twice the cap count."""
    ran = F.size(executable) > 0
    return F.struct(
        pass_rate(public, cap).alias("public_test_pass_rate"), pass_rate(private, cap).alias("private_test_pass_rate"), pass_rate(F.concat(public, private), 2 * cap if cap else None).alias("full_test_pass_rate"),
        ran.alias("has_executable_tests"), F.when(ran, "python_assertion").otherwise("non_assertion").alias("test_execution_kind"), F.size(executable).alias("executable_test_count"), F.size(tests).alias("raw_test_count"),
    )


def zipped(keys: Column, values: Column) -> Column:
    """A map of keys to values by place, as long as the shorter; of equal keys the last counts."""
    n = F.least(F.size(keys), F.size(values))
    pairs = F.slice(F.arrays_zip(keys.alias("k"), values.alias("v")), F.lit(1), F.greatest(n, F.lit(0)))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def prepared(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """rows(question, answer, public_tests, private_tests, public_passed, private_passed, checklist_dimensions, checklist_scores, checklists,
    score, correctness, ...) with problem, candidate_code, tests, tests_for_prompt, reference_score, rubric, objective and targets.

    public_passed and private_passed say which assertions passed; they come from a runner outside."""
    c = F.col
    tests = all_tests(c("public_tests"), c("private_tests"))
    x = rows.withColumns({"problem": c("question"), "candidate_code": c("answer"), "tests": tests, "tests_for_prompt": texts.format_tests(c("public_tests"))})
    given = zipped(c("checklist_dimensions"), c("checklist_scores"))[CORRECTNESS]
    item = zipped(c("checklist_dimensions"), c("checklists"))[CORRECTNESS]
    executable = F.concat(texts.assertions(F.coalesce(c("public_tests"), F.array().cast("array<string>"))), texts.assertions(F.coalesce(c("private_tests"), F.array().cast("array<string>"))))
    none = F.array().cast("array<boolean>")
    ran = objective(F.coalesce(c("public_passed"), none), F.coalesce(c("private_passed"), none), c("tests"), executable, cap)
    x = x.withColumns(
        {
            "reference_score": F.coalesce(given.cast("double"), grades.number(c("score")), F.lit(0.0)),
            "rubric": F.when(item.isNotNull(), F.concat(F.lit(f"{RUBRIC}\nReference checklist item: "), item)).otherwise(RUBRIC),
            "objective": ran,
        }
    )
    rate, tested = c("objective.full_test_pass_rate"), c("objective.has_executable_tests")
    target = grades.reconcile_target(grades.grade_from_correctness(c("correctness"), c("score")), rate, tested)
    x = x.withColumns({"dimension_target_score": F.when(tested, half_even(0.6 * c("reference_score") + 0.4 * (10.0 * rate), 2)).otherwise(c("reference_score")), "axiom_target_grade": target})
    return x.withColumns({"axiom_target_score": c("axiom_target_grade") * 20.0, "review_question": texts.review_question(c("problem"))})


def ordinal_sample(rows: DataFrame) -> DataFrame:
    """rows(inst, code, lang, grade): samples whose grade stands in for the tests."""
    c = F.col
    proxy = F.when(c("grade") >= 3, 1.0).otherwise(0.0)
    return rows.withColumns(
        {
            "problem": c("inst"), "candidate_code": c("code"), "code_language": F.when(_text(c("lang")) != "", c("lang")).otherwise("python"), "tests_for_prompt": F.lit(PROXY_TESTS), "reference_score": c("grade") * 2.0,
            "pass_rate": proxy, "objective_source": F.lit(PROXY_SOURCE), "axiom_target_grade": c("grade"), "axiom_target_score": c("grade") * 20.0, "correctness_label": F.when(c("grade") >= 3, "Correct").otherwise("Error"),
            "question": texts.review_question(c("inst")),
        }
    )


def with_defaults(rows: DataFrame) -> DataFrame:
    """Prepared samples with what they lack. A missing value and a null are the same here. Score and label come from a grade that was given;
    a grade that wasn't comes from them, after."""
    c = F.col
    has = lambda name, kind: c(name) if name in rows.columns else F.lit(None).cast(kind)
    given = F.coalesce(has("axiom_target_grade", "int"), F.lit(0))
    x = rows.withColumns({n: F.coalesce(has(n, "string"), F.lit(v)) for n, v in (("code_language", "python"), ("source", "prepared"), ("subset", "prepared"))})
    x = x.withColumn("tests", F.coalesce(has("tests", "array<string>"), F.array().cast("array<string>")))
    x = x.withColumn("tests_for_prompt", F.coalesce(has("tests_for_prompt", "string"), texts.format_tests(c("tests"))))
    x = x.withColumn("reference_score", F.coalesce(has("reference_score", "double"), has("overall_score", "double"), F.lit(0.0)))
    x = x.withColumn("full_test_pass_rate", F.coalesce(has("full_test_pass_rate", "double"), F.lit(0.0)))
    x = x.withColumn("overall_score", F.coalesce(has("overall_score", "double"), grades.scalar_score(given) / 10.0))
    x = x.withColumn("correctness_label", F.coalesce(has("correctness_label", "string"), F.when(given >= 3, "Correct").otherwise("Error")))
    mapped = grades.grade_from_correctness(c("correctness_label"), c("overall_score"))
    tested = F.coalesce(has("has_executable_tests", "boolean"), F.lit(False))
    x = x.withColumn("axiom_target_grade", F.coalesce(has("axiom_target_grade", "int"), grades.reconcile_target(mapped, c("full_test_pass_rate"), tested)))
    x = x.withColumn("axiom_target_score", F.coalesce(has("axiom_target_score", "double"), grades.scalar_score(c("axiom_target_grade"))))
    return x.withColumn("question", F.coalesce(has("question", "string"), texts.review_question(c("problem"))))


SHAPES = ("candidate_code", "inst", "code", "score", "answer", "question", "correctness", "problem", "language", "lang", "source", "public_tests", "private_tests", "tests", "axiom_target_grade", "axiom_target_score")


def common_sample(rows: DataFrame) -> DataFrame:
    """Rows of three shapes, told by which columns aren't null, as problem, candidate_code, tests, source, language and target.

    `shape`: prepared (candidate_code), ordinal (inst, code, score), critic (answer, question); null for none, which the caller may refuse."""
    for name in SHAPES:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("array<string>" if name.endswith("tests") else "double" if name.endswith("target_score") else "int" if name.endswith("target_grade") else "string"))
    c = F.col
    ordinal = c("inst").isNotNull() & c("code").isNotNull() & c("score").isNotNull()
    shape = F.when(c("candidate_code").isNotNull(), "prepared").when(ordinal, "ordinal").when(c("answer").isNotNull() & c("question").isNotNull(), "critic")
    x = rows.withColumn("shape", shape)
    is_ = lambda s: c("shape") == s
    grade = F.when(is_("prepared"), c("axiom_target_grade")).when(is_("ordinal"), grades.clamp_grade(c("score"))).when(is_("critic"), grades.grade_from_correctness(c("correctness"), c("score")))
    some = lambda a, b: F.when(_text(a) != "", a).otherwise(b)
    return x.withColumns(
        {
            "problem": F.when(is_("ordinal"), c("inst")).when(is_("critic"), c("question")).otherwise(c("problem")),
            "candidate_code": F.when(is_("ordinal"), c("code")).when(is_("critic"), c("answer")).otherwise(c("candidate_code")),
            "tests": F.when(is_("ordinal"), F.array().cast("array<string>")).when(is_("critic"), all_tests(c("public_tests"), c("private_tests"))).otherwise(c("tests")),
            "source": F.when(is_("ordinal"), some(c("source"), F.lit("axiom"))).otherwise(c("source")),
            "language": F.when(is_("ordinal"), some(c("lang"), F.lit("unknown"))).when(is_("critic"), some(c("language"), F.lit("python"))).otherwise(c("language")),
            "axiom_target_grade": grade,
            "axiom_target_score": F.when(is_("prepared"), c("axiom_target_score")).otherwise(grade * 20.0),
        }
    )


def manifest_rows(rows: DataFrame) -> DataFrame:
    """rows(problem, candidate_code, language, grade, low, high, ...): code without its fence, grade clamped, the interval sorted and clamped."""
    c = F.col
    g = grades.clamp_grade(c("grade"))
    a, b = grades.clamp_grade(c("low")), grades.clamp_grade(c("high"))
    return rows.withColumns(
        {
            "problem": _text(c("problem")), "candidate_code": texts.code_block(c("candidate_code")), "language": F.when(_text(c("language")) != "", c("language")).otherwise("unknown"), "axiom_target_grade": g,
            "axiom_target_score": grades.scalar_score(g), "axiom_target_interval": F.when(a.isNotNull() & b.isNotNull(), F.array(F.least(a, b), F.greatest(a, b))).when(g.isNotNull(), F.array(g, g)),
        }
    )


# static items -------------------------------------------------------------------------------------------------------------------------
def static_items(rows: DataFrame, label_type: Column, confidence: Column, train: Column) -> DataFrame:
    """rows(instruction, grade, low, high, ...) -> items with a canonical review and value bounds. A grade without an interval is one of width 0;
    an interval without a grade takes its middle."""
    c = F.col
    a, b = (grades.clamp_grade(F.coalesce(c(x).cast("double"), c("grade").cast("double"))) for x in ("low", "high"))
    low, high = F.least(a, b), F.greatest(a, b)
    mid = grades.clamp_grade(F.coalesce(c("grade").cast("double"), (low + high) / 2.0))
    one = lambda g: F.array(grades.value_target(g) + 0.0)
    return rows.withColumns(
        {
            "response": F.array(texts.review_text(mid)), "q_value": one(mid), "q_min": one(low), "q_max": one(high), "train_lm": train, "value_loss_weight": confidence,
            "lm_loss_weight": F.when(train, confidence).otherwise(0.0), "label_type": label_type, "label_confidence": confidence, "target_axiom_grade": F.when(low == high, mid), "target_axiom_interval": F.array(low, high),
            "target_score": grades.scalar_score(mid), "value_scale": F.lit(VALUE_SCALE),
        }
    )


def exact_items(samples: DataFrame, value_weight: float = 1.0, lm_weight: float = 0.15) -> DataFrame:
    """samples(problem, candidate_code, language, axiom_target_grade, ...) -> items with the canonical review of their target."""
    c = F.col
    g = grades.clamp_grade(c("axiom_target_grade"))
    value = grades.value_target(g) + 0.0
    return samples.withColumns(
        {
            "instruction": texts.instruction(c("problem"), c("candidate_code"), c("language"), F.lit(None).cast("array<string>")), "response": F.array(texts.review_text(g, exact=True)), "q_value": F.array(value),
            "train_lm": F.lit(True), "target_dimension": F.lit(CORRECTNESS), "terminal_tag": F.lit("static_exact"), "terminal_q_value": value, "terminal_error": F.lit(None).cast("string"), "parsed_score": g * 20.0,
            "parsed_axiom_grade": g, "target_score": g * 20.0, "target_axiom_grade": g, "is_best_path": F.lit(True), "value_loss_weight": F.lit(value_weight), "lm_loss_weight": F.lit(lm_weight),
            "data_split": F.lit("static"), "synthetic_type": F.lit("static_exact"),
        }
    )
