"""Trajectory records to training items: terminal paths, semantic and path dedupe, verifier corrections, replay, the whole conversion.

records: one row for each record: `order` (its place in the files' order), source, subset, dataset_index, problem, candidate_code, language,
tests, best_tags (array) and react, the nodes as structs (tag, text, q_value, final_answer, target_dimension, reward_details) in the order
they were made. All first-wins decisions follow (order, not best, place in react)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades, texts, udfs
from ..functions.exact import let
from ..scratch import stored
from . import intervals, labels, selection, trees

IDENTITY = ["source", "subset", "dataset_index"]
#: The wording of a verifier's corrections, and the names of their kinds.
CORRECTION = (
    "\n\nA previous review for this same sample was rejected by deterministic verifier checks.\nUse the verifier feedback to repair the reasoning. Do not "
    "repeat unsupported evidence; if the failed claim was central, re-evaluate the AXIOM grade from the task, code, and verified tests.\n\nPrevious rejected review:\n",
    "\n\nVerifier feedback:\n",
)
CORRECTION_STEP = ("<step>\nVerifier correction: the previous review used unsupported evidence. ", " I will discard that claim and anchor the score to the verified AXIOM correctness boundary.\n</step>")
CORRECTION_MODES = ("value_only", "policy", "paired_repair")


def best_tags(react: Column) -> Column:
    """(dimension, tag, q_value) of the best review of each dimension: the largest q, of equal ones the first made."""
    final = F.filter(react, lambda n: trees.is_terminal(n) & (F.coalesce(n["target_dimension"], F.lit("")) != ""))
    ranked = F.transform(final, lambda n, i: F.struct(n["target_dimension"].alias("dimension"), F.coalesce(n["q_value"], F.lit(-100.0)).alias("q"), (-i).alias("i"), n["tag"].alias("tag"), n["q_value"].alias("q_value")))
    of = lambda d: F.array_max(F.transform(F.filter(ranked, lambda r: r["dimension"] == d), lambda r: F.struct(r["q"], r["i"], r["tag"], r["q_value"])))
    return F.transform(F.array_distinct(F.transform(final, lambda n: n["target_dimension"])), lambda d: F.struct(d.alias("dimension"), of(d)["tag"].alias("tag"), of(d)["q_value"].alias("q_value")))


def terminals(records: DataFrame, with_way: bool = False) -> DataFrame:
    """A row for each terminal node, with what its details say: error, parsed, grade, target, score and the meaning of its review.

    The nodes are not in the rows: of a record with n terminals each would have them all. with_way: the nodes on the way, their texts as segments, with their best descendant."""
    c, react = F.col, F.col("react")
    keep = [name for name in records.columns if name != "react"]
    # a node's details are parsed once for their error, which its ancestors' best values need too
    judge = lambda d: let(F.try_parse_json(d).isNotNull(), lambda ok: F.struct(ok.alias("sound"), texts.terminal_error(d, ok).alias("error")))
    records = records.select(*keep, "react", F.transform(react, lambda n: F.when(trees.is_terminal(n), judge(n["reward_details"]))).alias("_judged"))
    if with_way:
        on_way = lambda n, best: F.struct(texts.normalize_segment(n["text"]).alias("text"), F.coalesce(n["q_value"], F.lit(-100.0)).alias("q"), n["tag"].alias("tag"), F.coalesce(best, F.lit(-100.0)).alias("best"))
        best = trees.best_descendants(react, F.transform("_judged", lambda j: j["error"]))
        records = records.select(*keep, "react", "_judged", intervals.ways(react, trees.is_terminal).alias("_ways"), F.zip_with(react, best, on_way).alias("_steps"))
        way = lambda i: F.transform(F.get("_ways", i), lambda j: F.get("_steps", j))
    else:
        way = lambda i: F.lit(None).cast("array<struct<text:string,q:double,tag:string,best:double>>")
    made = F.transform(react, lambda n, i: F.when(trees.is_terminal(n), F.struct(i.alias("pos"), n.alias("node"), F.get("_judged", i).alias("judged"), way(i).alias("way"))))
    rows = records.select(*keep, F.explode(F.array_compact(made)).alias("_t")).select(*keep, "_t.pos", "_t.node", c("_t.way").alias("_way"), c("_t.judged.sound").alias("_sound"), c("_t.judged.error").alias("terminal_error"))
    rows = rows.withColumns({"tag": c("node.tag"), "target_dimension": F.coalesce("node.target_dimension", F.lit("")), "terminal_q_value": F.coalesce("node.q_value", F.lit(-100.0)), "is_best_path": F.coalesce(F.array_contains("best_tags", c("node.tag")), F.lit(False))})
    # each JSON text is read once for all its fields; what is sound begins with a brace if it is an object, JSON's white space apart
    details = c("node.reward_details")
    rows = rows.withColumn("_details", F.when(c("_sound") & F.ltrim(details, F.lit(" \t\r\n")).startswith("{"), details).otherwise("{}")).drop("_sound")
    rows = rows.select("*", F.json_tuple("_details", "parsed", "predicted_axiom_grade", "target_axiom_grade", "target_score").alias("_own", "_predicted", "_goal", "_goal_score"))
    rows = rows.withColumns({"_parsed": F.when(c("_own").startswith("{"), c("_own")).otherwise("{}"), "_variant": F.try_parse_json("_details")})
    own = c("_parsed") != "{}"
    answer = texts.payload_text(c("node.final_answer"), fences=False)
    said = F.when(own, c("_parsed")).otherwise(let(answer, lambda a: F.when(F.try_parse_json(a).isNotNull(), a).otherwise("{}")))
    fields = [*grades.TRAINING_KEYS, "score", *texts.MEANING]
    rows = rows.withColumn("_said", said)
    rows = rows.select("*", F.json_tuple("_said", *fields).alias(*[f"_said_{f}" for f in fields]))
    payload = grades.grade_from_raw([c(f"_said_{k}") for k in grades.TRAINING_KEYS], c("_said_score"))
    rows = rows.withColumns({"_stated": let(grades.raw_number(c("_predicted")), grades.clamp_grade), "_payload": payload})
    rows = rows.withColumns(
        {
            "parsed_axiom_grade": F.coalesce("_stated", F.when(own, c("_payload"))), "parsed_score": F.when(own, grades.raw_number(c("_said_score"))), "verifier_feedback": udfs.verifier_messages(c("_details")), "_signature": texts.raw_signature(F.coalesce("_stated", "_payload"), *[c(f"_said_{f}") for f in texts.MEANING]),
            **{name: F.when(grades.is_number(c("_variant"), f"$.{name}"), grades.raw_number(c(raw))) for name, raw in (("target_axiom_grade", "_goal"), ("target_score", "_goal_score"))},
        }
    )
    return rows.drop("_own", "_predicted", "_goal", "_goal_score", "_variant", "_said", "_stated", "_payload", *[f"_said_{f}" for f in fields])


def marks(records: DataFrame) -> DataFrame:
    """What labels are calibrated by and a consensus is made of: a narrow row for each terminal, with its value, its grade, its target (of a score where no
    grade is given) and its error."""
    t = terminals(records)
    target = F.coalesce(F.col("target_axiom_grade"), grades.target_from_details(F.to_json(F.struct("target_score"))).cast("double"))
    return t.select(
        "order", "pos", F.col("dataset_index").cast("string").alias("dataset_index"), "target_dimension", F.col("parsed_axiom_grade").alias("grade"), target.alias("target"),
        F.col("terminal_error").alias("error"), F.col("terminal_q_value").alias("q_value"), "terminal_error",
    )


def paths(rows: DataFrame) -> DataFrame:
    """terminals -> items: response and its parallel arrays over the nodes on the way; null response where no node has text or the dimension is blank."""
    segments = F.filter("_way", lambda n: n["text"].isNotNull())
    x = rows.withColumn("_segments", F.when(F.col("target_dimension") != "", segments)).withColumn("_segments", F.when(F.size("_segments") > 0, F.col("_segments")))
    take = lambda name: F.transform("_segments", lambda s: s[name])
    return x.withColumns(
        {
            "response": take("text"), "q_value": take("q"), "raw_q_value": take("q"), "q_node_tags": take("tag"), "q_descendant_best": take("best"),
            "q_stage": F.transform("_segments", lambda s, i: texts.stage(i, F.size("_segments"), s["text"])),
        }
    ).drop("_segments", "_way")


def _kept(rows: DataFrame, most: int) -> DataFrame:
    """terminals with `fate`: kept, semantic_duplicate, skipped, duplicate_path or capped."""
    order = ["order", "_not_best", "pos"]
    rows = rows.withColumn("_not_best", ~F.col("is_best_path"))
    if most > 0:
        return _kept_under_cap(rows, order, most)
    meaning = ["_home", *IDENTITY, "target_dimension", F.coalesce(texts.parent_tag(F.col("tag")), F.lit("")), "_signature"]
    first = F.row_number().over(Window.partitionBy(*meaning).orderBy(*order)) == 1
    x = rows.withColumn("fate", F.when(F.col("_signature").isNotNull() & ~first, "semantic_duplicate").when(F.col("response").isNull(), "skipped"))
    again = F.row_number().over(Window.partitionBy("_home", *IDENTITY, "tag", F.col("fate").isNull()).orderBy(*order)) > 1
    return x.withColumn("fate", F.coalesce("fate", F.when(again, "duplicate_path").otherwise("kept")))


def _kept_under_cap(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """With a cap the decisions depend on each other, so those of one identity are taken in turn, over narrow rows in order: a task passes from one
    identity to the next as its rows come, and holds of one only what it has decided."""
    narrow = rows.select(*[F.col(c).cast("string").alias(c) for c in IDENTITY], *order, "tag", "target_dimension", F.to_json("_signature").alias("sig"), F.col("response").isNull().alias("empty"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meanings, seen, counts = None, set(), set(), {}
        for batch in batches:
            fates = []
            for source, subset, index, record, _, _, tag, dimension, sig, empty in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (source, subset, index):
                    now, meanings, seen, counts = (source, subset, index), set(), set(), {}
                key, meaning = (record, dimension), (dimension, tag.rpartition(".")[0], sig)
                if counts.get(key, 0) >= most:
                    fates.append("capped")
                    continue
                if sig is not None and meaning in meanings:
                    fates.append("semantic_duplicate")
                    continue
                meanings.add(meaning)
                fate = "skipped" if empty else "duplicate_path" if tag in seen else "kept"
                if fate == "kept":
                    seen.add(tag)
                    counts[key] = counts.get(key, 0) + 1
                fates.append(fate)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(5), pa.array(fates, pa.string())], names=["order", "pos", "fate"])

    turns = narrow.repartition(*IDENTITY).sortWithinPartitions(*IDENTITY, *order)
    decided = turns.mapInArrow(decide, f"order {dict(rows.dtypes)['order']}, pos int, fate string")
    return rows.join(decided, ["order", "pos"])


KEPT = ["order", "pos", *IDENTITY, "instruction", "response", "q_value", "raw_q_value", "q_node_tags", "q_descendant_best", "q_stage", "train_lm", "target_dimension", "terminal_tag", "terminal_q_value", "terminal_error", "parsed_score", "parsed_axiom_grade", "target_score", "target_axiom_grade", "is_best_path", "data_split", "force_value_only", "lm_loss_weight", "value_loss_weight", "policy_block_reason", "policy_reasoning_quality_issue", "verifier_feedback", "allow_verifier_policy", "synthetic_type", "repeat"]


def _instruction(x: DataFrame) -> Column:
    has = lambda name: F.col(name) if name in x.columns else F.lit(None).cast("string")
    return texts.instruction(F.coalesce(has("problem"), has("question")), has("candidate_code"), F.coalesce(has("language"), has("lang")), F.lit(None).cast("array<string>"))


def converted(records: DataFrame, least_q: float = 0.5, most_paths: int = 0, split: str = "main", corrections: str | None = None, correction_q: float = 0.8, correction_weights: tuple[float, float] = (0.5, 0.5), repeat: int = 1, most_corrections: int = 0) -> DataFrame:
    """All terminals with their fate, as items (KEPT and `fate`; only `kept` ones are training rows), and corrections if a mode is given.

    Values are raw: labels.blended is the next step, over one split at a time. correction_weights: of the language model and of the value."""
    c = F.col
    # as whole records, not as their wide rows, for all that is decided in an identity; by a hash, as fields may be constants, which windows leave out of their keys
    dealt = records if most_paths > 0 else records.withColumn("_home", F.xxhash64(*IDENTITY)).repartition("_home")
    x = _kept(paths(terminals(dealt, with_way=True)), most_paths)
    feedback = F.size("verifier_feedback") > 0
    match = F.coalesce(c("parsed_axiom_grade") == grades.clamp_grade(c("target_axiom_grade")), F.lit(False))
    candidate = c("is_best_path") & (c("terminal_q_value") >= least_q) & c("terminal_error").isNull() & ~feedback
    x = x.withColumn("_candidate", candidate).withColumn("_match", match)
    x = x.withColumn("policy_reasoning_quality_issue", F.when(c("_candidate") & c("_match") & c("response").isNotNull(), texts.quality_issue(c("response"), udfs.repeated_steps(F.when(c("_candidate") & c("_match"), c("response"))))))
    weak, mismatch = c("policy_reasoning_quality_issue").isNotNull(), c("_candidate") & ~c("_match")
    off = weak | mismatch | feedback
    x = x.withColumns(
        {
            "instruction": _instruction(x), "train_lm": c("_candidate") & c("_match") & ~weak, "terminal_tag": c("tag"), "data_split": F.lit(split), "force_value_only": off,
            "lm_loss_weight": F.when(off, 0.0), "value_loss_weight": F.lit(None).cast("double"), "policy_block_reason": F.when(weak, "weak_or_malformed_reasoning").when(mismatch, "axiom_grade_mismatch"),
            "allow_verifier_policy": F.lit(False), "synthetic_type": F.lit(None).cast("string"), "repeat": F.lit(0), "_text": c("node.text"),
        }
    )
    items = x.select(*KEPT, "fate")
    if corrections is None:
        return items
    if corrections not in CORRECTION_MODES:
        raise ValueError(f"no such mode: {corrections}")
    made = _corrections(x.where(c("fate") == "kept"), corrections, correction_q, correction_weights, repeat, most_corrections)
    return items.unionByName(made.select(*items.columns))


def _corrections(kept: DataFrame, mode: str, q: float, weights: tuple[float, float], repeat: int, most: int) -> DataFrame:
    """Corrections of kept items that a verifier found fault with: the first `most` (0: all), each `repeat` times under tags of its own."""
    c = F.col
    target = grades.target_from_details(c("_details"))
    x = kept.where((F.size("verifier_feedback") > 0) & (c("target_dimension") != "")).withColumn("_target", target).where("_target is not null")
    if most > 0:
        x = selection.first_in_order(x, most, [F.col("order"), F.col("_not_best"), F.col("pos")])
    train = mode != "value_only"
    feedback = F.array_join(F.transform("verifier_feedback", lambda m: F.concat(F.lit("- "), m)), "\n")
    step = F.concat(F.lit(CORRECTION_STEP[0]), F.array_join(F.slice("verifier_feedback", 1, 3), "; "), F.lit(CORRECTION_STEP[1]))
    value = max(-1.0, min(1.0, q))
    tag = F.concat(c("tag"), F.lit(f"#verifier_correction_{mode}"))
    times = max(1, repeat)
    x = x.withColumns(
        {
            "instruction": F.concat(c("instruction"), F.lit(CORRECTION[0]), texts.strip(F.coalesce(c("_text"), F.lit(""))), F.lit(CORRECTION[1]), feedback),
            "response": F.array(step, _corrected_review(c("_target"))), "q_value": F.array(F.lit(value), F.lit(value)), "raw_q_value": F.lit(None).cast("array<double>"),
            "q_node_tags": F.lit(None).cast("array<string>"), "q_descendant_best": F.lit(None).cast("array<double>"), "q_stage": F.lit(None).cast("array<string>"), "train_lm": F.lit(train),
            "terminal_q_value": F.lit(value), "terminal_error": F.lit(None).cast("string"), "parsed_score": c("_target") * 20.0, "parsed_axiom_grade": c("_target"), "is_best_path": F.lit(train),
            "force_value_only": F.lit(not train), "lm_loss_weight": F.lit(weights[0] if train else 0.0), "value_loss_weight": F.lit(weights[1]), "policy_block_reason": F.lit(None).cast("string"),
            "policy_reasoning_quality_issue": F.lit(None).cast("string"), "allow_verifier_policy": F.lit(train), "synthetic_type": F.lit("verifier_correction" if mode == "policy" else f"verifier_correction_{mode}"),
            "repeat": F.explode(F.sequence(F.lit(0), F.lit(times - 1))),
        }
    )
    x = x.withColumn("terminal_tag", F.concat(tag, F.lit("#repeat"), c("repeat").cast("string")) if times > 1 else tag)
    again = F.row_number().over(Window.partitionBy(*IDENTITY, "terminal_tag").orderBy("order", "_not_best", "pos")) > 1
    return x.withColumn("fate", F.when(again, "duplicate_correction").otherwise("kept"))


def _corrected_review(target: Column) -> Column:
    def text(g: int) -> str:
        means = grades.DESCRIPTIONS[g]
        payload = {"axiom_grade": g, "score": g * 20.0, "verdict": grades.VERDICTS[0 if g >= 4 else 1 if g == 3 else 2], "functional_correctness": g >= 3, "repair_effort": grades.REPAIR_EFFORT[g], "evidence_type": "verifier_corrected"}
        payload |= {"summary": f"Corrected after verifier rejected unsupported evidence. Use AXIOM grade {g}: {means}", "evidence": ["Unsupported evidence from the previous review was removed.", f"The corrected score follows AXIOM grade {g} after removing unsupported evidence."]}
        return f"{texts.REVIEW}\n{json.dumps(payload)}\n{texts.REVIEW_END}"

    return F.coalesce(*[F.when(target == g, text(g)) for g in range(6)])


def counters(items: DataFrame) -> DataFrame:
    """(name, n): what became of the terminals, in one pass."""
    c = F.col
    made = c("synthetic_type").isNotNull()
    fates = {"kept": "paths", "semantic_duplicate": "semantic_duplicate_reviews", "skipped": "skipped_paths", "duplicate_path": "duplicate_paths", "duplicate_correction": "duplicate_verifier_corrections"}
    judged = c("fate").isin("kept", "duplicate_path") & ~made
    names = [
        F.coalesce(*[F.when(c("fate") == k, v) for k, v in fates.items()]),
        F.when(c("fate") == "kept", F.when(c("train_lm"), "policy_paths").otherwise("value_only_paths")),
        F.when(judged & c("policy_reasoning_quality_issue").isNotNull(), "policy_reasoning_quality_blocked"),
        F.when(judged, F.concat(F.lit("policy_reasoning_quality_"), c("policy_reasoning_quality_issue"))),
        F.when(judged & (c("policy_block_reason") == "axiom_grade_mismatch"), "policy_grade_mismatch_paths"),
        F.when((c("fate") == "kept") & (c("terminal_error") != ""), F.concat(F.lit("error_"), c("terminal_error"))),
        F.when((c("fate") == "kept") & made, "verifier_correction_paths"),
    ]
    return items.select(F.explode(F.array_compact(F.array(*names))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def replayed(items: DataFrame, ratio: float, new_items: int, seed: int) -> DataFrame:
    """A sample of round(ratio * new_items) items (half to even), all of them where ratio is negative or there are no more."""
    if ratio < 0:
        return items
    key = F.concat_ws(":", F.lit(str(seed)), *IDENTITY, "terminal_tag", F.col("repeat").cast("string"))
    return selection.first_rows(items, int(round(ratio * new_items)), [F.md5(key), *map(F.col, IDENTITY), F.col("terminal_tag")])


def merged(new: DataFrame, replay: DataFrame) -> DataFrame:
    """New items, then replayed ones, each identity and tag once: the first stays."""
    both = new.withColumn("_turn", F.lit(0)).unionByName(replay.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*IDENTITY, "terminal_tag").orderBy("_turn", "order", ~F.col("is_best_path"), "pos", "repeat"))
    return both.withColumn("_first", first).where("_first = 1").drop("_first", "_turn")


def training_rows(new: DataFrame, replay: DataFrame | None = None, anchors: DataFrame | None = None, least_q: float = 0.5, replay_ratio: float = 1.0, calibration: float | None = None, least_anchors: int = 8, consensus: float | None = None, consensus_mode: str = "weight", final_review: bool = False, seed: int = 42, **options) -> DataFrame:
    """Records to training rows: conversion and stage labels of each split, merged; then calibration on the anchors, consensus, policy flags, collapse.

    The order matters: labels are blended before they are calibrated, and a row whose value has moved may begin to train the policy."""
    made = lambda records, split: labels.blended(stored(converted(records, least_q, split=split, **options).where("fate = 'kept'"), "items"))
    items = made(new, "new")
    if replay is not None:
        n = items.count() if replay_ratio >= 0 else 0
        items = merged(items, replayed(made(replay, "replay"), replay_ratio, n, seed))
    if calibration is None and consensus is None:
        known = None
    else:
        known = stored(marks(new if replay is None else new.unionByName(replay.withColumn("order", F.col("order") + (1 << 60)))), "marks")
    if calibration is not None:
        items = labels.calibrated(items, labels.calibrator(known if anchors is None else marks(anchors), least_anchors), calibration)
    if consensus is not None:
        items = labels.with_consensus(items.withColumn("dataset_index", F.col("dataset_index").cast("string")), labels.consensus(known, ["order", "pos"]), consensus, consensus_mode)
    items = labels.refreshed(items, least_q)
    return labels.collapsed(items) if final_review else items
