import json
import random

import pytest
from pyspark.sql import functions as F

from stepquarry.functions import grades, texts, udfs
from stepquarry.operators import dedupe, evaluate, intervals, labels, reward, sampling, trees
from stepquarry.sources import config, records
from stepquarry.streaming import incremental


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


# grades -------------------------------------------------------------------------------------------------------------------------------
def test_clamp_halves_and_unreadable(spark):
    rows = spark.createDataFrame([("0.5", 0), ("2.5", 2), ("3.5", 4), ("4.5", 4), ("9", 5), ("-3", 0), ("x", None), (None, None), ("NaN", None)], "v string, want int")
    assert all(r.got == r.want for r in rows.withColumn("got", grades.clamp_grade(F.col("v"))).collect())


def test_payload_grades(spark):
    cases = [('{"grade": 4}', 4), ('{"score": 4}', 4), ('{"score": 40}', 2), ('{"score": 400}', None), ('{"axiom_grade": true}', 1), ("no", None), ('{"predicted_axiom_grade": 3}', 3)]
    rows = spark.createDataFrame(cases, "j string, want int").withColumn("got", grades.grade_from_payload(F.col("j")))
    assert all(r.got == r.want for r in rows.collect())
    assert one(spark, g=grades.grade_from_payload(F.lit('{"predicted_axiom_grade": 3}'), grades.TRAINING_KEYS)).g is None


def test_correctness_text(spark):
    got = one(spark, a=grades.is_correct(F.lit("Incorrect")), b=grades.is_correct(F.lit("correct ")), c=grades.is_correct(F.lit("Error")), d=grades.grade_from_correctness(F.lit("Correct"), F.lit("x")))
    assert tuple(got) == (False, True, False, None)


def test_lenient_grades(spark):
    """Decimals are rounded, keyed grades come first, the loose form needs a word of its own and a digit within twenty characters."""
    cases = [('{"grade": 3.5}', 4), ('{"axiom_grade": 1} "grade": 2', 2), ("My Grade: about 4", 4), ("upgrade 4", None), ("grade is, as far as I can see from here, 4", None), ('{"score": 55}', 3), ("", None), (None, None)]
    rows = spark.createDataFrame(cases, "t string, want int").withColumn("got", grades.lenient_grade(F.col("t")))
    assert all(r.got == r.want for r in rows.collect())
    assert [udfs.lenient_grade(t or "") for t, _ in cases] == [w for _, w in cases]


def test_targets(spark):
    cases = [('{"target_axiom_grade": 2.5}', 2), ('{"target_axiom_grade": "4", "target_score": 80}', 4), ('{"target_score": "50"}', 5), ('{"target_score": 8}', 4), ("{}", None)]
    rows = spark.createDataFrame(cases, "j string, want int").withColumn("got", grades.target_from_details(F.col("j")))
    assert all(r.got == r.want for r in rows.collect())
    fix = lambda mapped, rate, ran: grades.reconcile_target(F.lit(mapped).cast("int"), F.lit(rate), F.lit(ran))
    assert tuple(one(spark, a=fix(5, 0.0, False), b=fix(5, 0.0, True), c=fix(1, 1.0, True), d=fix(1, 1.0, None), e=fix(None, 0.5, False))) == (5, 2, 3, 1, 2)


# texts --------------------------------------------------------------------------------------------------------------------------------
def test_recovery_ladder():
    assert udfs.recover('<review>{"axiom_grade": 5}</review> <review>{"axiom_grade": 2}}</review>')[2:] == ('{"axiom_grade": 2}', "balanced_json_prefix")
    ok, error, payload, method = udfs.recover('<review>{"note": "a\nb", "axiom_grade": 3}</review>')
    assert (ok, error, json.loads(payload)["note"], method) == (True, None, "a\nb", "escaped_control_chars")
    ok, _, payload, method = udfs.recover('<review>{"axiom_grade": 4, "score": 80, "evidence": ["torn</review>')
    assert (ok, method) == (True, "grade_fallback") and json.loads(payload) | {"verdict": None} == {"axiom_grade": 4, "score": 80.0, "verdict": None, "functional_correctness": None, "repair_effort": None, "summary": udfs.RECOVERED_SUMMARY, "evidence": []}
    for bad in (None, '{"axiom_grade": 4}', '<review>{"axiom_grade": 4}'):
        assert udfs.recover(bad) == (False, "missing_review_tags", None, None)
    assert udfs.recover("<review>none</review>")[:2] == (False, "invalid_review_json")
    assert udfs.balanced_object('x {"a": "}", "b": {}} }') == '{"a": "}", "b": {}}' and udfs.balanced_object('{"a": "}') is None


def test_segments_and_signatures(spark):
    got = one(
        spark, a=texts.normalize_segment(F.lit(" <step>a</step> ")), b=texts.normalize_segment(F.lit("<step>a")), c=texts.normalize_segment(F.lit("x <review> y")), d=texts.normalize_segment(F.lit(" \n")),
        e=texts.review_signature(F.lit('<review>{"grade": 4, "functional_correctness": "false"}</review>'))["functional"], f=texts.code_block(F.lit("```\ncode\n```")), g=texts.truncate(F.lit("  abc def "), 4)[0], h=texts.file_part(F.lit("Größe/1")),
        i=texts.truncate_on_stop(F.lit("one two"), ["two", "t"]), j=texts.close_review(F.lit("<review>a ")), k=texts.format_tests(F.array(*[F.lit(str(i)) for i in range(7)])),
    )
    assert tuple(got) == ("<step>a</step>", "<step>a\n</step>", "<review>\ny\n</review>", None, False, "code", "abc\n... [truncated]", "Größe_1", "one two", "<review>a\n</review>", "0\n1\n2\n3\n4\n... (2 more assertions omitted)")


def test_code_and_evidence(spark):
    got = one(spark, a=texts.looks_like_code(F.lit("a; b; c; for d")), b=texts.looks_like_code(F.lit("let x = 1; y")), c=texts.looks_like_code(F.lit("The function will return 1")), d=texts.concrete_evidence(F.lit("line 3 returns 4")), e=texts.concrete_evidence(F.lit("it Does Not stop")), f=texts.pair_role(F.lit("chosen")), g=texts.pair_role(F.lit("POS_response")))
    assert tuple(got) == (False, True, False, False, True, "", "pos")


def test_near_duplicate_steps():
    a = "walk over the list once and keep the largest value seen"
    assert udfs.similarity(a, "walk over the list once and keep the largest value") > udfs.NEAR
    assert udfs.similarity(a, "sort the list first and then take its last value") < udfs.NEAR and udfs.similarity("too short", "too short") == 0.0


def test_quality_issues(spark):
    step, end = "<step>\nlook at the loop\n</step>", '<review>\n{"axiom_grade": 5, "evidence_type": "x", "evidence": ["e"]}\n</review>'
    twin = "<step>walk over the list once and keep the largest value {}</step>"
    cases = [
        ([step, end], None), ([], "empty_response"), (["<step>Premature final review draft retained: x</step>", end], "premature_review_step"), (['<step>{"a": 1}</step>', end], "json_review_inside_step"), ([twin.format("seen"), twin.format("so"), end], "repeated_step"),
        ([step, "<review>torn</review>"], "missing_final_review_payload"), ([step, "<review>{}</review>"], "missing_final_review_payload"), ([step, end.replace('"x"', '" None"')], "weak_final_evidence_type"), ([step, end.replace('"e"', '" "')], "empty_final_evidence"),
    ]
    rows = spark.createDataFrame([(k, r, w) for k, (r, w) in enumerate(cases)], "k int, r array<string>, want string")
    got = rows.withColumn("got", texts.quality_issue(F.col("r"), udfs.repeated_steps(F.col("r")))).orderBy("k").collect()
    assert [r.got for r in got] == [w for _, w in cases]


def test_verifier_messages():
    details = {"evidence_details": {"fact_checks": [{"kind": "unused_identifier", "claim": " 'a' is unused ", "supported": False, "actual": {"identifier": "a", "usage": {"load": 2, "param": 1}}}, {"kind": "k", "claim": "c", "supported": False}, {"supported": False, "actual": {"status": "exception", "exception": "E"}}, 7]}, "reward_caps": [{"reason": "unsupported_x"}, {"reason": "y"}, {"reason": "unsupported_x"}]}
    assert udfs.issue_messages(json.dumps(details)) == [
        "Unsupported unused-identifier claim: \"'a' is unused\". AST usage for 'a': load=2, store=0, param=1.", "Unsupported verifier claim (k): 'c'.", "Unsupported executable claim: ''; actual exception was 'E'.", "Reward cap triggered by verifier: unsupported_x.",
    ]
    assert udfs.issue_messages(None) == udfs.issue_messages("{torn") == []


def test_claims():
    code = "def area(w, h):\n    k = w\n    return w * h"
    assert [c["supported"] for c in udfs.unused_checks("variable 'k' is unused; parameter `h` was never used, `k` is not referenced", code)] == [True, False, True]
    ran = {"area(2, 3)": {"status": "result", "value": "6"}}
    assert [c["supported"] for c in udfs.call_checks("area(2,3) returns 6 instead of 7", code, ["assert area(2, 3) == 7"], ran)] == [True, True]
    assert udfs.call_checks("area(x) returns 1", code, [], ran) == [] and udfs.safe_call("area(-1, [2, (3,)])", "area") == "area(-1, [2, (3,)])" and udfs.safe_call("area(f(1))", "area") is None
    assert udfs.expected_outputs(["assert area(1, 1) == 1", "assert area(1,1)==2", "x = 1", "assert area(a) == 1"], "area") == {"area(1, 1)": "2"}
    assert [c["supported"] for c in udfs.test_failure_checks("provided_test_failure", ["t"] * 9, None, [True] * 8)] == [False]
    assert [c["supported"] for c in udfs.modulo_checks("7 % -3 = -2, 7 % 3 returns 2, 5 % 0 = 1, 07 % 3 = 1")] == [True, False, False, False]


def test_modulo_takes_divisors_sign(spark):
    text = "7 % -3 = -2 and 7 % 3 returns 2 and 5 % 0 = 1 and 07 % 3 = 1"
    got = one(spark, m=texts.modulo_claims(F.lit(text))).m
    assert [(x.claim, x.supported, x.actual) for x in got] == [(c["claim"], c["supported"], c["actual"]) for c in udfs.modulo_checks(text)]


def test_token_rows():
    row = udfs.token_row("a b", ["c d", "e"], [0.5, -100.0], [0.0, -100.0], [1.0, -100.0], True, 6, udfs.word_ids, 0)
    assert (len(row["input_ids"]), row["q"], row["labels"][:2], row["exceeding_length"]) == (6, [-100, -100, -100, 0.5, -100, -100], [-100, -100], False)
    assert udfs.token_row("a", ["b c d"], [1.0], [1.0], [1.0], None, 2, udfs.word_ids, 0)["labels"] == udfs.word_ids("a b")[1:] * 0 + [-100, udfs.word_ids("b")[0]]
    assert set(udfs.token_row("a", ["b"], [0.3], [0.3], [0.3], None, 9, udfs.word_ids, 0)["labels"]) == {-100}


# trees --------------------------------------------------------------------------------------------------------------------------------
def test_tags(spark):
    got = one(spark, a=texts.descends(F.lit("0.10"), F.lit("0.1")), b=texts.descends(F.lit("0.1.2"), F.lit("0.1")), c=texts.lineage(F.lit("0.10.2")), d=texts.natural_key(F.lit("0.10")))
    assert tuple(got) == (False, True, ["0", "0.10", "0.10.2"], [0, 10])


def test_missing_middle_node_is_skipped(spark):
    nodes = spark.createDataFrame([(1, 0, "0", 0.1, "", None), (1, 1, "0.0.0", 0.9, "x", None), (1, 2, "0.1", 1.0, "x", '{"error": "e"}')], "rec long, pos int, tag string, q_value double, final_answer string, reward_details string")
    r = trees.packed(nodes, ["rec"], ["pos"], "tag", "q_value", "final_answer", "reward_details")
    got = r.select(trees.best_descendants(F.col("react")).alias("best"), intervals.ways(F.col("react"), trees.is_terminal).alias("ways")).first()
    assert got.best == [0.9, 0.9, 1.0] and got.ways == [None, [0, 1], [0, 2]]


def test_intervals_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        tags = ["0"]
        for _ in range(rnd.randint(0, 40)):
            tags.append(rnd.choice(tags) + rnd.choice([".0", ".1", ".10", ".2", "#x", "-1", ".1.1"]))
        tags += rnd.sample(tags, min(3, len(tags))) + [None]
        rnd.shuffle(tags)
        values = [rnd.choice([None, rnd.random()]) for _ in tags]
        below = lambda a, b: a is not None and b is not None and (a == b or a.startswith(b + "."))
        best = intervals._best.func(tags, values)
        sums = intervals._sums.func(tags, values)
        ways = intervals._ways.func(tags, None)
        for i, tag in enumerate(tags):
            own = [values[j] for j, t in enumerate(tags) if below(t, tag) and values[j] is not None]
            assert best[i] == max(own, default=None)
            if tag is None:
                assert sums[i] is None and ways[i] is None
            else:
                assert sums[i]["visits"] == len(own) and abs(sums[i]["total"] - sum(own)) < 1e-9
                assert sorted(ways[i]) == [j for j, t in enumerate(tags) if below(tag, t)] and [len(tags[j]) for j in ways[i]] == sorted(len(tags[j]) for j in ways[i])


def test_a_tree_of_many_nodes_is_one_scan(spark):
    """A chain of 3,000 nodes with 30,000 leaves, and a row of 100,000 under one root."""
    chain = ["0" + ".0" * k for k in range(3000)]
    tags = chain + [f"{chain[k % 3000]}.{1 + k // 3000}" for k in range(30_000)]
    df = spark.createDataFrame([(1, [(t, float(i)) for i, t in enumerate(tags)]), (2, [("0", 0.0)] + [(f"0.{i}", float(i)) for i in range(100_000)])], "rec int, react array<struct<tag:string,q:double>>")
    got = {r.rec: (r.best, r.visits) for r in df.select("rec", intervals.best_values(F.col("react"), lambda n: n["q"])[0].alias("best"), intervals.totals(F.col("react"), lambda n: n["q"])[0]["visits"].alias("visits")).collect()}
    assert got == {1: (32_999.0, 33_000), 2: (99_999.0, 100_001)}


def test_beam_ties_and_failures(spark):
    rows = [(1, k, f"0.{k}", v, t, a, 2) for k, (v, t, a) in enumerate([(0.5, True, "ok"), (0.5, False, ""), (0.9, True, trees.FAILURES[0]), (0.1, False, "")])]
    c = spark.createDataFrame(rows, "rec int, pos int, tag string, value double, terminal boolean, final_answer string, depth int")
    got = trees.beam_round(c, ["rec"], ["pos"], F.lit(3), 4).collect()
    assert [(r.tag, r.fate, r.next_width) for r in got] == [("0.2", "dropped", 1), ("0.0", "final", 1), ("0.1", "current", 1)]


def test_expansion_bounds(spark):
    react = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(x).alias("text"), F.lit(e).alias("terminal"), F.lit(a).alias("final_answer")) for t, x, e, a in (("0", "", False, ""), ("0.0", "s", False, ""), ("0.0.0", "s", False, ""), ("0.1", "r", True, "ok"))])
    may = lambda tag, **k: trees.may_expand(react, F.lit(tag), 3, 1, **k)
    assert tuple(one(spark, a=may("0.0"), b=may("0.0.0"), c=may("0.1"), d=may("0.0", leaf_target=1), e=may("0.0", node_budget=3), f=may("0.0.0", linear=F.lit(True)))) == (True, False, False, False, False, True)


# labels, reward -----------------------------------------------------------------------------------------------------------------------
def test_single_value_stage_is_left_alone(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.3)], "stage string, q double")
    x = rows.crossJoin(F.broadcast(labels.statistics(rows, "stage", "q"))).withColumn("z", labels.standardized(F.col("q"), F.col("stage")))
    assert {r.q: r.z for r in x.collect()}[0.5] == 0.5


def test_calibrator_reasons(spark):
    rows = lambda *xs: spark.createDataFrame([(d, q, e) for d, q, e in xs], "target_dimension string, q_value double, terminal_error string")
    off = lambda df, n: labels.calibrator(df, n).first().reason
    assert off(rows(("a", 0.1, None)), 1) == "not_enough_anchor_values"
    assert off(rows(("a", 0.1, None), ("b", 0.2, None), ("", 0.9, None), ("a", 0.9, "e")), 2) == "not_enough_dimension_values"
    got = labels.calibrator(rows(("a", 0.1, None), ("a", 0.3, None), ("b", 0.2, None)), 2).first()
    assert got.enabled and got.parts.keys() == {"a"} and got.all_n == 3


def _reward(spark, payload, target=5, tests=("assert f(1) == 2",), rate=1.0, correctness="Correct"):
    checked = udfs.check_evidence(F.lit(payload), F.lit("def f(x): return x + 1"), F.array(*map(F.lit, tests)).cast("array<string>"), F.lit(rate), F.lit(None).cast("string"), F.lit(None).cast("array<boolean>"))
    row = spark.range(1).select(checked.alias("c"), F.lit(payload).alias("p"))
    r = reward.Review(texts.review_payload(F.col("p")), F.lit(reward.CORRECTNESS), F.lit(target), F.array(*map(F.lit, tests)).cast("array<string>"), F.lit(rate), F.lit(correctness), F.col("c.fact_checks"))
    return row.select(reward.reward(r).alias("r"), reward.evidence_alignment(*reward.claims(F.col("c.fact_checks")), F.col("c.evidence_count")).alias("e")).first()


def test_reward_orders_evidence_below_boundary_errors(spark):
    """A bad claim under a right grade costs less than a grade on the wrong side with the same claim."""
    review = lambda grade, verdict: json.dumps({"axiom_grade": grade, "verdict": verdict, "evidence_type": "provided_test_failure", "summary": "s", "evidence": ["the listed test fails"]})
    right, wrong = _reward(spark, review(5, "accept")), _reward(spark, review(2, "major_issue"))
    assert right.r.reward > -0.3 and right.e < 1 and wrong.r.reward <= -0.7
    assert {c.reason for c in right.r.caps} == {"false_executable_evidence_claim", "unsupported_provided_test_failure_evidence_correct_boundary"}
    assert {c.reason: c.cap for c in wrong.r.caps} == {"false_executable_evidence_claim": 0.55, "unsupported_provided_test_failure_evidence": 0.15, "functional_correctness_boundary_conflict": 0.55, "axiom_functionality_boundary_mismatch": 0.35, "axiom_ordinal_grade_distance_3": pytest.approx(0.30)}
    assert _reward(spark, "{torn").r.error == "invalid_review_json" and _reward(spark, '{"a": 1}').r.reward == -1.0


def test_pairs_and_losses(spark):
    rows = spark.createDataFrame([("p", "pos", 4, 0), ("p", "pos", 2, 1), ("p", "neg", 2, 2), ("q", "pos", 1, 3)], "pair string, role string, grade int, at int")
    assert tuple(evaluate.pairwise_accuracy(rows, "pair", "role", "grade", "at").first()) == (1, 0.0)
    assert evaluate.pair_loss(rows.withColumn("v", F.lit(0.1)), "pair", "role", "v", "at").first().loss == pytest.approx(0.04)


# dedupe, samples ----------------------------------------------------------------------------------------------------------------------
def test_order_of_partitions_does_not_matter(spark):
    rows = spark.createDataFrame([(i % 3, i, (i * 7) % 5) for i in range(60)], "k long, pos long, v long")
    mixed = rows.repartition(7).orderBy(F.desc("pos"))
    for f in (lambda x: dedupe.first_wins(x, ["k"], [F.desc("v"), "pos"]), lambda x: sampling.round_robin(x, "k", 17, 3, "pos"), lambda x: dedupe.top_k(x, ["k"], ["v", "pos"], 4), lambda x: sampling.balanced(x.withColumn("tag", F.lit("t")), "k", 70, 3, "pos", "tag", "x")):
        assert sorted(map(str, f(rows).collect())) == sorted(map(str, f(mixed).collect()))


def test_work_columns_do_not_clash(spark):
    rows = spark.createDataFrame([(1, 2, 3), (1, 4, 5)], "k int, _k int, _rank int")
    assert dedupe.without_used(rows, rows.where("_k = 9"), ["k"]).count() == 2 and dedupe.top_k(rows, ["k"], ["_k"]).columns == ["k", "_k", "_rank"]


def test_repeats_have_tags_of_their_own(spark):
    rows = spark.createDataFrame([(1, "a", "t1"), (2, "a", None), (3, "b", "t3")], "id int, g string, tag string")
    got = sampling.balanced(rows, "g", 7, 1, "id", "tag", "value").collect()
    assert len(got) == 7 and len({r.tag for r in got if r.repeat is not None}) == 4 and {r.tag for r in got if r.id == 2 and r.repeat is not None} <= {f"value_{j}#rebalancevalue{j}" for j in range(4)}
    assert sampling.balanced(rows, "g", -1, 1, "id", "tag", "value").count() == 3 and sampling.balanced(rows.limit(0), "g", 5, 1, "id", "tag", "value").count() == 0


# sources ------------------------------------------------------------------------------------------------------------------------------
def test_json_lines_count_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n[2]\n{"x": 3}\n{"x": ')
    got = records.json_lines(spark, str(tmp_path), "x int").orderBy("line").collect()
    assert [(r.line, r.record and r.record.x) for r in got] == [(0, 1), (2, None), (3, 3), (4, None)]
    assert [(r.line, r.record.x) for r in records.json_lines(spark, str(tmp_path), "x int", objects_only=True).orderBy("line").collect()] == [(0, 1), (1, 3)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.jsonl").write_text("".join(f"line {i}\n" for i in range(3000 + k)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = records.lines(spark, str(tmp_path))
        assert got.count() == 6001 and got.where("value <> concat('line ', line)").count() == 0
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_files_in_order_and_of_any_shape(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "b.json").write_text('[{"react": 1}, {"other": 2}]')
    (tmp_path / "d" / "a.json").write_text('{"react": 3}')
    (tmp_path / "c.json").write_text("{torn")
    (tmp_path / "z.jsonl").write_text('{"react": 4}\n{torn\n')
    found = [p.rsplit("/", 1)[1] for p in records.discover(spark, [str(tmp_path), str(tmp_path / "none"), str(tmp_path / "z.jsonl")])]
    assert found == ["b.json", "c.json", "a.json", "z.jsonl", "z.jsonl"]
    assert sorted(r.react for r in records.any_shape(spark, str(tmp_path), "react int", "react").collect()) == [1, 3, 4]


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"label": [1, 0, 1], "nl": ["a", None, "c"], "more": [1.0, 2.0, 3.0]})
    with pa.OSFile(str(tmp_path / "x-train.arrow"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=2)
    got = records.arrow_files(spark, str(tmp_path), "label long, nl string").orderBy("row").collect()
    assert [(r.subset, r.row, r.label, r.nl) for r in got] == [("x", 0, 1, "a"), ("x", 1, 0, None), ("x", 2, 1, "c")]


def test_resume_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("10", 1, None), ("9", 2, "x"), ("a", 3, "y")], "dataset_index string, n int, s string")
    records.write_json_lines(rows.coalesce(1), str(tmp_path / "out"), "dataset_index")
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(json.loads(t)["dataset_index"] for t in text) == ["10", "9", "a"] and any(json.loads(t).get("s", 0) is None for t in text)
    records.write_per_record(rows, str(tmp_path / "each"), "dataset_index", "s")
    assert {p.name for p in (tmp_path / "each").iterdir()} == {"10_unknown.json", "9_x.json", "a_y.json"}
    (tmp_path / "s").mkdir()
    for name, value in (("1.json", '{"dataset_index": "9", "n": 1}'), ("2.json", '{"dataset_index": "9", "n": 2}'), ("3.json", "{torn")):
        (tmp_path / "s" / name).write_text(value)
    assert [tuple(r) for r in records.stored_records(spark, str(tmp_path / "s"), "dataset_index string, n int", rows).collect()] == [("9", 2)]
    assert records.completed_ids(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(IndexError):
        records.record_at(rows.withColumn("line", F.col("n")), 7)


def test_examples_and_config(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(list("abcdef")))
    got = records.examples(spark, str(tmp_path / "e.json"), 3, 1)
    assert len(set(got)) == 3 and got == records.examples(spark, str(tmp_path / "e.json"), 3, 1) and len(records.examples(spark, str(tmp_path / "e.json"), 9, 1)) == 6
    (tmp_path / "c.json").write_text('{"max_depth": 7}')
    assert config.load(str(tmp_path / "c.json")).max_depth == 7 and config.SearchConfig().c_puct == 1.5
    with pytest.raises(ValueError):
        config.merged(config.SearchConfig(), {"depth": 1})
    (tmp_path / ".env").write_text("# no\nexport A = '1'\nB=2\nnothing\n")
    assert config.load_env(str(tmp_path / ".env"), {"B": "0"}) == {"A": "1", "B": "0"} and config.load_env(str(tmp_path / "none"), {}) == {}


def test_ingest_knows_old_keys(spark, tmp_path):
    for lot in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(k,) for k in lot], "k long").write.mode("append").json(str(tmp_path / "in"))
        incremental.ingest(spark, str(tmp_path / "in"), "k long", str(tmp_path / "out"), str(tmp_path / "log"), ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_white_space_is_one_set(spark):
    """What is stripped by characters is what the patterns' class holds."""
    chars = spark.createDataFrame([(chr(k),) for k in range(0x10000) if not 0xD800 <= k < 0xE000], "c string")
    found = {r.c for r in chars.where(F.regexp_like("c", F.lit(f"[{texts.SPACES}]"))).collect()}
    assert found == set(texts.SPACE_CHARS)


def test_a_reward_reads_each_field_once(spark):
    """Neither the two sets of weights nor the two results repeat what is read from the payload."""
    c = F.col
    checks = F.array().cast("array<struct<kind:string,supported:boolean>>")
    said = str(reward.reward(reward.Review(c("p"), c("d"), c("t"), c("tests"), c("rate"), c("label"), checks)))
    assert [said.count(f"$.{key}") for key in ("dimension", "verdict")] == [1, 1]
