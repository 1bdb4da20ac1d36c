"""Conversion of trajectories: one small case for each rule."""

import json

from pyspark.sql import functions as F

from stepquarry.operators import convert, labels

SCHEMA = "order long, source string, subset string, dataset_index string, problem string, candidate_code string, language string, best_tags array<string>, react array<struct<tag:string,text:string,q_value:double,final_answer:string,target_dimension:string,reward_details:string>>"
DIMENSION = "Correctness Verification"


def step(tag, text, q=0.0):
    return tag, text, q, "", DIMENSION, None


def review(tag, grade, q=1.0, target=5, dimension=DIMENSION, extra=None, **payload):
    body = {"axiom_grade": grade, "score": grade * 20, "verdict": "accept", "functional_correctness": True, "repair_effort": "none", "evidence_type": "deduced_counterexample", "evidence": ["on 3 it gives 4"]} | payload
    details = {"parsed": body, "predicted_axiom_grade": grade, "target_axiom_grade": target, "target_score": target * 20} | (extra or {})
    return tag, f"<review>\n{json.dumps(body)}\n</review>", q, json.dumps(body), dimension, json.dumps(details)


def record(*nodes, best=(), order=0, index="1"):
    return order, "unit", "unit", index, "Add one.", "def f(x): return x + 1", "python", list(best), list(nodes)


def run(spark, *records, **options):
    rows = convert.converted(spark.createDataFrame(list(records), SCHEMA), **options)
    return [r for r in rows.orderBy("order", F.desc("is_best_path"), "pos", "repeat").collect() if r.fate == "kept"], {r.name: r.n for r in convert.counters(rows).collect()}


def test_same_meaning_under_one_parent_comes_once(spark):
    items, n = run(spark, record(review("0.0", 5), review("0.1", 5, score=95, summary="other words"), review("1.0", 5), best=["0.1"]))
    assert [i.terminal_tag for i in items] == ["0.1", "1.0"] and n["semantic_duplicate_reviews"] == 1 and n["paths"] == 2


def test_grade_decides_what_trains(spark):
    items, n = run(spark, record(review("0.0", 4, 0.82), best=["0.0"]), record(review("0.0", 5), best=["0.0"], order=1, index="2"))
    assert [(i.train_lm, i.is_best_path, i.policy_block_reason, i.lm_loss_weight) for i in items] == [(False, True, "axiom_grade_mismatch", 0.0), (True, True, None, None)]
    assert (n["policy_grade_mismatch_paths"], n["value_only_paths"], n["policy_paths"]) == (1, 1, 1)


def test_weak_reasoning_is_value_only(spark):
    near = [step("0", "Take x as three; the code then gives four which is right"), step("0.0", "<step>Take x as three; the code gives four, which is right</step>"), review("0.0.0", 5)]
    cases = [[review("0", 5, evidence_type="none", evidence=[])], [step("0", "Premature final review draft retained as a reasoning note, not as the final scored review:\nx"), review("0.0", 5)], near]
    items, n = run(spark, *[record(*c, best=[c[-1][0]], order=k, index=str(k)) for k, c in enumerate(cases)])
    assert [(i.train_lm, i.force_value_only, i.policy_block_reason) for i in items] == [(False, True, "weak_or_malformed_reasoning")] * 3
    assert [i.policy_reasoning_quality_issue for i in items] == ["weak_final_evidence_type", "premature_review_step", "repeated_step"] and n["policy_reasoning_quality_blocked"] == 3


def test_a_step_gains_from_what_it_led_to(spark):
    rows = convert.converted(spark.createDataFrame([record(step("0.0", "look", -0.2), review("0.0.0", 5), best=["0.0.0"])], SCHEMA)).where("fate = 'kept'")
    item = labels.blended(rows).first()
    assert item.raw_q_value == [-0.2, 1.0] and item.q_descendant_best == [1.0, 1.0] and item.q_stage == ["early", "review"] and -0.2 < item.q_value[0] < 1.0 and item.q_value[1] == 1.0
    assert item.label_change == "adjusted" and item.terminal_q_value == 1.0


def test_errors_and_blank_dimensions(spark):
    failed = ("0.2", "gibberish", -1.0, "Fail to generate parsable text for next step.", DIMENSION, '{"error": "Fail to generate parsable text for next step."}')
    torn = ("0.3", "<review>a</review>", 0.9, "a", DIMENSION, "{torn")
    items, n = run(spark, record(failed, torn, review("0.4", 3, dimension=""), best=["0.3"]))
    assert [(i.terminal_tag, i.terminal_error, i.train_lm) for i in items] == [("0.3", "invalid_reward_details", False), ("0.2", failed[3], False)]
    assert n["skipped_paths"] == 1 and n["error_invalid_reward_details"] == 1


def test_cap_leaves_meanings_free(spark):
    """A path over the cap takes no meaning, so the next record of the same identity may still have it."""
    first = record(review("0.0", 5), review("0.1", 4), order=0)
    again = record(review("0.1", 4), review("0.2", 3), order=1)
    items, _ = run(spark, first, again, most_paths=1)
    assert [(i.order, i.terminal_tag) for i in items] == [(0, "0.0"), (1, "0.1")]
    assert [(i.order, i.terminal_tag) for i in run(spark, first, again)[0]] == [(0, "0.0"), (0, "0.1"), (1, "0.2")]


FAULT = {"reward_caps": [{"reason": "unsupported_unused_identifier_evidence", "cap": 0.25}]}


def test_corrections(spark):
    rows = [record(review("0.0", 5, extra=FAULT), best=["0.0"], order=k, index=str(k)) for k in range(3)]
    for mode, train in (("value_only", False), ("policy", True), ("paired_repair", True)):
        items, n = run(spark, *rows, corrections=mode, repeat=2, most_corrections=2)
        made = [i for i in items if i.synthetic_type]
        assert len(made) == 4 == n["verifier_correction_paths"] and all(i.train_lm == train and i.force_value_only != train for i in made)
        assert {i.synthetic_type for i in made} == {"verifier_correction" if mode == "policy" else f"verifier_correction_{mode}"}
        assert made[0].terminal_tag == f"0.0#verifier_correction_{mode}#repeat0" and made[0].response[0].startswith("<step>\nVerifier correction: ") and '"axiom_grade": 5' in made[0].response[1]
        assert all(not i.train_lm and i.verifier_feedback == ["Reward cap triggered by verifier: unsupported_unused_identifier_evidence."] for i in items if not i.synthetic_type)


def test_labels_can_upgrade_and_responses_collapse(spark):
    """A value that consensus lifts over the bound makes its row train; then only the review stays."""
    nodes = [step("0", "look", 0.4), review("0.0", 5, 0.45), review("1", 5, 0.3), review("2", 5, 0.2)]
    new = spark.createDataFrame([record(*nodes, best=["0.0"])], SCHEMA)
    plain = {r.terminal_tag: r for r in convert.training_rows(new).collect()}
    lifted = {r.terminal_tag: r for r in convert.training_rows(new, consensus=1.0, consensus_mode="q_adjust", final_review=True).collect()}
    assert not plain["0.0"].train_lm and plain["0.0"].policy_change is None
    assert lifted["0.0"].train_lm and lifted["0.0"].policy_change == "upgraded" and len(lifted["0.0"].response) == len(lifted["0.0"].q_value) == 1 and lifted["0.0"].policy_response_mode == "final_review"


def test_replay_yields_to_new_items(spark):
    new, old = (spark.createDataFrame([record(review("0.0", 5), best=["0.0"], index=i) for i in xs], SCHEMA) for xs in (["1"], ["1", "2", "3"]))
    got = convert.training_rows(new, old, replay_ratio=-1).collect()
    assert sorted((r.dataset_index, r.data_split) for r in got) == [("1", "new"), ("2", "replay"), ("3", "replay")]
    assert len(convert.training_rows(new, old, replay_ratio=0.0).collect()) == 1


def test_capped_identities_pass_in_streams(spark):
    """A cap makes no group of Python's own for each identity; one that is null or comes in many records is decided as one."""
    rows = [record(review("0.0", 5), review("0.1", 4), order=k, index=i) for k, i in enumerate(["1", "2", None, "1", None])]
    made = convert.converted(spark.createDataFrame(rows, SCHEMA), most_paths=1)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    assert sorted((r.order, r.terminal_tag, r.fate) for r in made.collect() if r.fate != "capped") == [(0, "0.0", "kept"), (1, "0.0", "kept"), (2, "0.0", "kept"), (3, "0.0", "semantic_duplicate"), (3, "0.1", "kept"), (4, "0.0", "semantic_duplicate"), (4, "0.1", "kept")]


def test_labels_are_computed_once(spark):
    """What is rounded is written once into the plan, and no filter on the labels is inferred, as it would compute them again below."""
    from stepquarry.functions.exact import half_even
    from stepquarry.plans import tree_queries

    x = spark.range(1).select((F.col("id") / 7).alias("x"))
    nested = x.select(half_even(half_even(half_even(F.sqrt("x"), 4), 3), 2).alias("y"))
    assert nested._jdf.queryExecution().analyzed().toString().count("SQRT") == 1 and nested.first().y == 0.0
    item = labels.blended(convert.converted(spark.createDataFrame([record(step("0.0", "look", -0.2), review("0.0.0", 5), best=["0.0.0"])], SCHEMA)))
    rows = tree_queries._each(item, "terminal_tag")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("FLOOR") <= item.select("q_value")._jdf.queryExecution().optimizedPlan().toString().count("FLOOR")
    assert [(r.i, r.label) for r in rows.orderBy("i").collect()] == [*enumerate(item.first().q_value)]


def test_details_are_read_once(spark):
    """A signature's fields come from one reading of the details and one of their payload; only the error is looked up by itself."""
    records = spark.createDataFrame([record(review("0.0", 5), best=["0.0"])], SCHEMA)
    made = convert.converted(records).where("fate = 'kept'").select("order", "terminal_tag", "response")
    assert made.first().terminal_tag == "0.0"
    assert made._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
