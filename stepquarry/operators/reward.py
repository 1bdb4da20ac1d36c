"""Reward of a review: weighted alignments under the least of its caps."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import grades, texts
from ..functions.exact import half_even, let

#: Weights of score, functionality, dimension, verdict and evidence, for the correctness dimension and for others.
CORRECTNESS = "Correctness Verification"
WEIGHTS = (0.45, 0.25, 0.10, 0.10, 0.10)
OTHER_WEIGHTS = (0.50, 0.20, 0.10, 0.10, 0.10)
#: Kinds of evidence that can carry a low grade.
CONCRETE = ("provided_test_failure", "deduced_counterexample", "static_logic_contradiction")


@dataclass
class Review:
    """What a review says and what it is held against, as columns. checks: fact checks as structs with kind and supported."""

    payload: Column
    dimension: Column
    target: Column
    tests: Column
    pass_rate: Column
    correctness: Column
    checks: Column
    #: grade and kind, where they were read from the payload already.
    read: Column | None = None

    @property
    def grade(self) -> Column:
        return grades.grade_from_payload(self.payload) if self.read is None else self.read["grade"]

    @property
    def kind(self) -> Column:
        return texts.strip(F.coalesce(F.get_json_object(self.payload, "$.evidence_type"), F.lit(""))) if self.read is None else self.read["kind"]

    @property
    def distance(self) -> Column:
        return F.abs(self.grade - self.target)

    @property
    def same_side(self) -> Column:
        return (self.grade >= 3) == (self.target >= 3)

    def unsupported(self, kind: str) -> Column:
        return F.exists(self.checks, lambda c: (c["kind"] == kind) & ~c["supported"])


def evidence_alignment(true_claims: Column, false_claims: Column, evidence: Column) -> Column:
    """The share of claims that hold; 1 if none is false, 0 without any evidence."""
    return F.when(evidence <= 0, 0.0).when(false_claims > 0, true_claims / (true_claims + false_claims)).otherwise(1.0)


def claims(checks: Column) -> tuple[Column, Column]:
    """How many checks are supported, and how many aren't."""
    return F.size(F.filter(checks, lambda c: c["supported"])), F.size(F.filter(checks, lambda c: ~c["supported"]))


def caps(r: Review) -> Column:
    """Upper bounds that hold, as an array of (reason, cap)."""
    true_claims, false_claims = claims(r.checks)
    low = r.grade < 3
    bad_test, bad_name = r.unsupported("provided_test_failure"), r.unsupported("unused_identifier")
    listed = F.coalesce(F.size(r.tests) > 0, F.lit(False))
    proven = (r.dimension == CORRECTNESS) & (F.lower(F.coalesce(r.correctness, F.lit(""))) == "correct") & (r.pass_rate >= 0.999)
    rules = [
        ("false_executable_evidence_claim", false_claims > 0, F.when(true_claims > 0, 0.70).otherwise(0.55)),
        ("unsupported_provided_test_failure_evidence", bad_test & (low | ~r.same_side), 0.15),
        ("unsupported_provided_test_failure_evidence_correct_boundary", bad_test & ~low & r.same_side, 0.55),
        ("unsupported_unused_identifier_evidence", bad_name, 0.25),
        ("low_grade_without_concrete_evidence_type", low & ~r.kind.isin(*CONCRETE), 0.55),
        ("test_failure_claim_without_available_tests", low & (r.kind == CONCRETE[0]) & ~listed, 0.35),
        ("uncertain_evidence_cannot_support_low_grade", low & (r.kind == "uncertain"), 0.45),
        ("functional_correctness_boundary_conflict", proven & low, 0.55),
        ("axiom_functionality_boundary_mismatch", ~r.same_side, 0.35),
    ]
    made = [F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(reason).alias("reason"), (cap if isinstance(cap, Column) else F.lit(cap)).alias("cap"))) for reason, on, cap in rules]
    far = F.struct(F.concat(F.lit("axiom_ordinal_grade_distance_"), r.distance.cast("string")).alias("reason"), F.greatest(F.lit(0.10), 0.45 - 0.15 * (r.distance - 2)).alias("cap"))
    return F.array_compact(F.array(*made, F.when(r.distance >= 2, far)))


def alignments(r: Review) -> list[Column]:
    """Of score, functionality, dimension, verdict and evidence."""
    named = texts.strip(F.coalesce(F.get_json_object(r.payload, "$.dimension"), F.lit("")))
    verdict = texts.strip(F.coalesce(F.get_json_object(r.payload, "$.verdict"), F.lit("")))
    evidence = F.coalesce(F.size(F.from_json(F.get_json_object(r.payload, "$.evidence"), "array<string>")), F.lit(0))
    return [
        grades.alignment(r.grade, r.target),
        r.same_side.cast("double"),
        let(named, lambda n: ((n == "") | (n == r.dimension)).cast("double")),
        let(verdict, lambda v: grades.verdict_agreement(grades.verdict(r.target), v)),
        evidence_alignment(*claims(r.checks), evidence),
    ]


def reward(r: Review) -> Column:
    """(reward, reward_01, error, caps): 2 * share - 1 of the weighted alignments, held under the least cap; -1 for a review that can't be read."""
    return let(F.struct(r.grade.alias("grade"), r.kind.alias("kind")), lambda read: let(caps(replace(r, read=read)), lambda bounds: _held(replace(r, read=read), bounds)))


def _held(r: Review, bounds: Column) -> Column:
    weights = [F.when(r.dimension == CORRECTNESS, a).otherwise(b) for a, b in zip(WEIGHTS, OTHER_WEIGHTS, strict=True)]
    first, *rest = [w * p for w, p in zip(weights, alignments(r), strict=True)]
    share = sum(rest, first)
    held = F.least(share, F.coalesce(F.array_min(F.transform(bounds, lambda b: b["cap"])), F.lit(1.0)))
    error = F.when(r.payload.isNull(), "invalid_review_json").when(r.grade.isNull(), "missing_or_invalid_axiom_grade")
    made = lambda h: F.struct(
        F.when(error.isNotNull(), -1.0).otherwise(half_even(2 * h - 1, 4) + 0.0).alias("reward"), F.when(error.isNull(), half_even(h, 4)).alias("reward_01"), error.alias("error"),
        F.when(error.isNull(), bounds).alias("caps"),
    )
    return let(held, made)
