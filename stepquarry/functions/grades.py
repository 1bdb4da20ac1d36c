"""Grades: one ordinal scale 0..5 for heterogeneous labels. Column -> Column; values that can't be read give null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import half_even, let

#: What a grade means, the effort of a repair by grade, verdicts from best to worst, the keys that hold a grade in collected
#: and in training records, and the patterns of a grade in free text: keyed, loosely named, as a score of 100.
DESCRIPTIONS = {
    5: "Production-ready; no refinement effort is needed.",
    4: "Functionally correct; only minor code-quality tweaking is needed.",
    3: "Functionally correct; major refactoring is needed to improve code quality.",
    2: "Functionally defective; minor tweaking can repair functionality.",
    1: "Functionally defective; major refactoring is needed to repair functionality.",
    0: "Fundamentally flawed or mismatched; rewriting is more efficient than repairing.",
}
REPAIR_EFFORT = {5: "none", 4: "minor_quality", 3: "major_quality", 2: "minor_functional", 1: "major_functional", 0: "rewrite"}
VERDICTS = ("accept", "minor_issue", "major_issue")
COLLECTED_KEYS = ("axiom_grade", "predicted_axiom_grade", "axiogram_grade", "grade")
TRAINING_KEYS = ("axiom_grade", "grade")
KEYED_GRADE = r'"(?:axiom_grade|grade)"\s*:\s*([0-5](?:\.\d+)?)'
LOOSE_GRADE = r"(?i)\b(?:axiom_grade|grade)\b[^0-9]{0,20}([0-5](?:\.\d+)?)"
KEYED_SCORE = r'"score"\s*:\s*([0-9]+(?:\.\d+)?)'


def number(c: Column) -> Column:
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def clamp_grade(c: Column) -> Column:
    x = number(c)  # greatest and least pass over nulls, so those are kept out
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.bround(x))).cast("int"))


def scalar_score(grade: Column) -> Column:
    return clamp_grade(grade) * 20.0


def value_target(grade: Column) -> Column:
    return half_even(clamp_grade(grade) / 2.5 - 1.0, 4)


def grade_from_scalar(score: Column, max_score: Column) -> Column:
    return F.when(number(max_score) > 0, clamp_grade(number(score) / number(max_score) * 5.0))


def is_correct(label: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return low.contains("correct") & ~low.contains("incorrect") & ~low.contains("error")


def grade_from_correctness(label: Column, score: Column) -> Column:
    x = number(score)
    good = F.when(x <= 6, 3).when(x <= 8, 4).otherwise(5)
    bad = F.when(x <= 1, 0).when(x <= 3, 1).otherwise(2)
    return F.when(x.isNotNull(), F.when(is_correct(label), good).otherwise(bad))


def interval_from_binary(label: Column) -> tuple[Column, Column]:
    x = label.try_cast("int")
    return F.when(x == 1, 3).when(x == 0, 0), F.when(x == 1, 5).when(x == 0, 2)


def verdict(grade: Column) -> Column:
    g = clamp_grade(grade)
    return F.when(g >= 4, VERDICTS[0]).when(g == 3, VERDICTS[1]).when(g.isNotNull(), VERDICTS[2])


def functionally_correct(grade: Column) -> Column:
    return clamp_grade(grade) >= 3


def raw_number(raw: Column) -> Column:
    """A JSON value's text as a number; booleans count as 1 and 0."""
    return F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(number(raw))


def json_number(json: Column, path: str) -> Column:
    """The number at a path, also in a string; booleans count as 1 and 0."""
    return let(F.get_json_object(json, path), raw_number)


def is_number(variant: Column, path: str) -> Column:
    """Whether a parsed JSON document has a number or a boolean at a path, and not a string."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")


def json_typed_number(json: Column, path: str) -> Column:
    """As json_number, but null where the value is a string."""
    return F.when(is_number(F.try_parse_json(json), path), json_number(json, path))


def _scaled(score: Column) -> Column:
    return F.when(score.between(0, 5), clamp_grade(score)).when((score > 5) & (score <= 100), clamp_grade(score / 20.0))


def grade_from_raw(keys: Sequence[Column], score: Column) -> Column:
    """As grade_from_payload, of the texts that its keys and `score` have there."""
    return F.coalesce(*[let(raw_number(k), clamp_grade) for k in keys], let(raw_number(score), _scaled))


def grade_from_payload(json: Column, keys: Sequence[str] = COLLECTED_KEYS) -> Column:
    """First readable key, else `score`: up to 5 a grade, up to 100 scaled."""
    own = lambda j: F.coalesce(*[let(json_number(j, f"$.{k}"), clamp_grade) for k in keys], let(json_number(j, "$.score"), _scaled))
    return let(json, own)


def alignment(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(a - b) / 5.0))


def verdict_from_score(score: Column) -> Column:
    x = number(score)
    high, mid = F.when(x <= 5, 4.0).otherwise(80.0), F.when(x <= 5, 3.0).otherwise(60.0)
    return F.when(x >= high, VERDICTS[0]).when(x >= mid, VERDICTS[1]).when(x.isNotNull(), VERDICTS[2])


def verdict_agreement(a: Column, b: Column) -> Column:
    """1.0, 0.5 or 0.0 by distance in the verdicts' order; 0.0 if either is unknown."""
    place = lambda v: F.coalesce(*[F.when(v == x, k) for k, x in enumerate(VERDICTS)])
    return F.coalesce(1 - F.abs(place(a) - place(b)) / 2.0, F.lit(0.0))


def repair_effort(grade: Column) -> Column:
    g = clamp_grade(grade)
    return F.coalesce(*[F.when(g == k, v) for k, v in REPAIR_EFFORT.items()])


def target_from_details(details: Column) -> Column:
    """A numeric target grade in JSON details, else the target score: of 100 if it is a number over 10, of 10 otherwise, also as a string."""
    def own(d: Column) -> Column:
        large = F.coalesce(json_typed_number(d, "$.target_score") > 10, F.lit(False))
        return F.coalesce(let(json_typed_number(d, "$.target_axiom_grade"), clamp_grade), let(json_number(d, "$.target_score") / F.when(large, 100.0).otherwise(10.0) * 5.0, clamp_grade))

    return let(details, own)


def reconcile_target(mapped: Column, pass_rate: Column, executable: Column) -> Column:
    """A mapped grade put right by the share of tests passed, if there are tests that can run; without one, the share decides."""
    unmapped = F.when(pass_rate >= 0.999, 4).when(pass_rate > 0, 2).otherwise(1)
    tested = F.coalesce(executable, F.lit(False))
    return F.when(mapped.isNull(), unmapped).when(tested & (pass_rate >= 0.999) & (mapped < 3), 3).when(tested & (pass_rate <= 0) & (mapped >= 3), 2).otherwise(mapped)


def dimension_targets(scores: Column, pass_rate: Column, executable: Column, correctness: str = "Correctness Verification") -> Column:
    """A map of reference scores; correctness is blended with the tests where there are any."""
    return F.transform_values(scores, lambda k, v: F.when((k == correctness) & executable, half_even(0.6 * v + 0.4 * (10.0 * pass_rate), 2)).otherwise(v))


def last_match(text: Column, pattern: str) -> Column:
    return F.when(F.regexp_like(text, F.lit(pattern)), F.element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), -1))


def lenient_grade(text: Column) -> Column:
    """The last grade written in free text, keyed, else loosely named, else the last score of 100."""
    found = lambda t: F.coalesce(let(last_match(t, KEYED_GRADE), clamp_grade), let(last_match(t, LOOSE_GRADE), clamp_grade), let(number(last_match(t, KEYED_SCORE)) / 20.0, clamp_grade))
    return let(text, found)


def parsed_score(ok: Column, payload: Column, keys: Sequence[str] = TRAINING_KEYS) -> Column:
    """The score of a parsed review: its grade's, else its own; null if it wasn't parsed."""
    return F.when(ok, F.coalesce(grade_from_payload(payload, keys) * 20.0, json_number(payload, "$.score")))


def parsed_grade(ok: Column, payload: Column, keys: Sequence[str] = TRAINING_KEYS) -> Column:
    return F.when(ok, grade_from_payload(payload, keys))


def score_delta(parsed: Column, reference: Column) -> Column:
    return half_even(number(parsed) - number(reference), 6)


def delta_bucket(delta: Column) -> Column:
    return F.when(delta.isNull(), "unknown").when(delta <= -2, "under_2plus").when(delta == -1, "under_1").when(delta == 0, "exact").when(delta == 1, "over_1").otherwise("over_2plus")


def clamp_reward(c: Column) -> Column:
    return F.when(number(c).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number(c))))


def numeric_q(c: Column, default: float = -100.0) -> Column:
    return F.coalesce(number(c), F.lit(default))
