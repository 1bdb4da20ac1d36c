"""Queries on tags, trees, searches and the conversion of trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import texts as X
from ..functions import udfs
from ..operators import convert, dedupe, expand, intervals, labels, trees
from . import tables as T
from .registry import column, query, r6
from .tables import text_of

C = F.col
DEPTH = "CAST(len(string_split(tag, '.')) AS INT)"
PARENT = r"regexp_replace({}, '\.[^.]*$', '')"

column("tag_lineage", T.nodes, ["rec", "tag"], lambda: {"lineage": F.array_join(X.lineage(C("tag")), "|")}, T.NODES, "string_agg(anc, '|' ORDER BY len(anc)) AS lineage", "lineages GROUP BY rec, tag")
column("tag_depth_parent", T.nodes, ["rec", "tag"], lambda: {"depth": X.depth(C("tag")), "parent": X.parent_tag(C("tag")), "under": X.descends(C("tag"), F.lit("0.1"))}, T.NODES, f"{DEPTH} AS depth, CASE WHEN contains(tag, '.') THEN {PARENT.format('tag')} END AS parent, tag = '0.1' OR starts_with(tag, '0.1.') AS under", "nodes")


@query(f"WITH {T.NODES} SELECT rec, string_agg(tag, ',' ORDER BY list_transform(string_split(tag, '.'), lambda x: x::INT)) AS tags FROM nodes GROUP BY rec")
def tag_natural_sort(s: SparkSession, d: str) -> DataFrame:
    packed = T.nodes(s, d).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct(X.natural_key(C("tag")).alias("k"), "tag"))).alias("p"))
    return packed.select("rec", F.array_join("p.tag", ",").alias("tags"))


STAGE = "CASE WHEN starts_with(segment, '<review>') THEN 'review' WHEN size <= 1 THEN 'early' WHEN i = size - 1 THEN 'final_step' WHEN i / (size - 1)::DOUBLE < 0.34 THEN 'early' WHEN i / (size - 1)::DOUBLE < 0.67 THEN 'middle' ELSE 'late' END"


@query(f"WITH {T.TURNS}, segments AS (SELECT rec, pos, CASE WHEN pos % 6 = 5 THEN '<review>' ELSE text END AS segment, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY rec) AS size FROM turns) SELECT rec, pos, {STAGE} AS stage FROM segments")
def stage_bucket(s: SparkSession, d: str) -> DataFrame:
    t = T.turns(s, d).select("rec", "pos", F.when(C("pos") % 6 == 5, " <review>").otherwise(C("text")).alias("segment"), F.expr("row_number() over (partition by rec order by pos) - 1 as i"), F.expr("count(*) over (partition by rec) as size"))
    return t.select("rec", "pos", X.stage(C("i"), C("size"), C("segment")).alias("stage"))


def packed(s: SparkSession, d: str) -> DataFrame:
    n = T.nodes(s, d).withColumns({"q_value": C("q"), "done": C("status") == "F"})
    return trees.packed(n.withColumns({"final_answer": F.when(C("done"), "x").otherwise(""), "reward_details": F.when(C("done") & (C("p") % 13 == 0), '{"error": "e"}')}), ["rec"], ["ln"], "tag", "q_value", "final_answer", "reward_details", "dimension", "p")


@query(f"WITH {T.NODES}, good AS (SELECT rec, anc AS tag, max(q) AS best FROM lineages WHERE status = 'F' AND p % 13 <> 0 GROUP BY 1, 2) SELECT rec, tag, coalesce(best, q) AS best_q FROM nodes LEFT JOIN good USING (rec, tag)")
def best_descendant_q(s: SparkSession, d: str) -> DataFrame:
    best = F.zip_with("react", trees.best_descendants(C("react")), lambda n, q: F.struct(n["tag"].alias("tag"), q.alias("best_q")))
    return packed(s, d).select("rec", F.inline(best))


@query(f"WITH {T.NODES}, got AS (SELECT rec, anc AS tag, count(*) AS visits, sum(q) AS total FROM lineages WHERE status = 'F' GROUP BY 1, 2) SELECT rec, tag, coalesce(visits, 0) AS visits, round_even(coalesce(total / visits, 0), 6) + 0.0 AS q FROM nodes LEFT JOIN got USING (rec, tag)")
def mcts_backup(s: SparkSession, d: str) -> DataFrame:
    rewarded = F.transform("react", lambda n: F.struct(n["tag"].alias("tag"), F.when(n["final_answer"] != "", n["q_value"]).alias("reward")))
    return packed(s, d).select("rec", F.inline(trees.backup(rewarded, "reward"))).select("rec", "tag", "visits", r6(C("q")).alias("q"))


@query(f"WITH {T.NODES} SELECT l.rec, l.tag AS terminal, string_agg(n.dimension, '>' ORDER BY len(l.anc)) AS path, round_even(sum(n.q), 6) + 0.0 AS total FROM lineages l JOIN nodes n ON n.rec = l.rec AND n.tag = l.anc GROUP BY 1, 2")
def path_assembly(s: SparkSession, d: str) -> DataFrame:
    nodes = F.transform("react", lambda n: F.struct(n["tag"].alias("tag"), n["dimension"].alias("dimension"), n["q_value"].alias("q")))
    x = packed(s, d).select("rec", nodes.alias("react")).withColumn("ways", intervals.ways(C("react")))
    total = lambda way: F.aggregate(way, F.lit(0.0), lambda a, j: a + F.get("react", j)["q"])
    made = F.zip_with("react", "ways", lambda n, way: F.struct(n["tag"].alias("terminal"), F.array_join(F.transform(way, lambda j: F.get("react", j)["dimension"]), ">").alias("path"), r6(total(way)).alias("total")))
    return x.select("rec", F.inline(made))


def _visited(s: SparkSession, d: str) -> Column:
    """Nodes with the state of a search: visits, value, prior, whether terminal."""
    return F.transform(
        "react",
        lambda n: F.struct(n["tag"].alias("tag"), n["q_value"].alias("q"), n["q_value"].alias("q_value"), (n["p"] % 9).alias("visits"), (n["p"] % 9).alias("visit_count"), F.lit(0.5).alias("prior"), (n["final_answer"] != "").alias("terminal"), F.when(n["p"] % 3 != 0, n["q_value"]).alias("value"), F.when(n["p"] % 10 != 0, "x").otherwise("").alias("text"), F.when(n["p"] % 29 != 0, "d").otherwise("").alias("target_dimension"), n["final_answer"].alias("final_answer")),
    )


STATE = f"st AS (SELECT rec, ln, tag, q, p, p % 9 AS visits, status = 'F' AS terminal, {PARENT.format('tag')} AS up FROM nodes)"


@query(f"WITH {T.NODES}, {STATE}, sc AS (SELECT c.rec, c.up AS parent, c.tag, c.ln, round_even(c.q + 1.5 * 0.5 * sqrt(p.visits::DOUBLE) / (1 + c.visits), 9) + 0.0 AS score FROM st c JOIN st p ON p.rec = c.rec AND p.tag = c.up WHERE c.tag <> '0' AND NOT c.terminal) SELECT rec, parent, tag, round_even(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY rec, parent ORDER BY score DESC, md5('42:' || tag)) AS r FROM sc) WHERE r = 1")
def puct_select(s: SparkSession, d: str) -> DataFrame:
    x = packed(s, d).withColumn("react", _visited(s, d))
    return x.select("rec", F.inline(trees.selected("react"))).select("rec", "parent", "tag", r6(C("score")).alias("score"))


SHOWN = "vis AS (SELECT l.rec, l.tag, CAST(count(*) FILTER (n.p % 10 <> 0) AS INT) AS depth FROM lineages l JOIN nodes n ON n.rec = l.rec AND n.tag = l.anc GROUP BY 1, 2)"


@query(f"WITH {T.NODES}, {STATE}, {SHOWN} SELECT rec, tag, row_number() OVER (PARTITION BY rec ORDER BY depth DESC, q DESC, visits DESC, val DESC, ln) AS rank FROM (SELECT st.*, vis.depth, CASE WHEN p % 3 <> 0 THEN q ELSE -100 END AS val FROM st JOIN vis USING (rec, tag)) x WHERE NOT terminal AND p % 29 <> 0 AND depth <= 2 AND NOT EXISTS (SELECT 1 FROM st k WHERE k.rec = x.rec AND k.up = x.tag AND k.tag <> '0') QUALIFY rank <= 2")
def frontier_topk(s: SparkSession, d: str) -> DataFrame:
    x = packed(s, d).withColumn("react", _visited(s, d))
    return x.select("rec", F.posexplode(trees.frontier(C("react"), 2, 2)).alias("i", "tag")).select("rec", "tag", (C("i") + 1).cast("bigint").alias("rank"))


@query(f"WITH {T.NODES}, {STATE}, {SHOWN}, n AS (SELECT rec, count(*) FILTER (terminal) AS leaves, count(*) FILTER (p % 10 <> 0) AS shown FROM st GROUP BY 1) SELECT rec, tag, NOT terminal AND depth <= 2 AND depth < 4 AND leaves < 3 AND shown < 8 AS may FROM st JOIN vis USING (rec, tag) JOIN n USING (rec)")
def expansion_eligibility(s: SparkSession, d: str) -> DataFrame:
    x = packed(s, d).withColumn("react", _visited(s, d))
    return x.select("rec", F.inline(trees.expandable(C("react"), 4, 2, 3, 8)))


@query(f"WITH {T.NODES}, k AS (SELECT rec, least(grade, 5) AS grade, count(*) AS n FROM (SELECT rec, rec % 6 AS grade FROM nodes WHERE status = 'F') GROUP BY 1, 2) SELECT n.rec, count(*) AS nodes, count(*) FILTER (status = 'F') AS reviews, min(q) AS q_min, max(q) AS q_max, CAST(max(len(string_split(tag, '.'))) AS INT) AS depth, coalesce(any_value(k.grade || ':' || k.n), '') AS grades FROM nodes n LEFT JOIN k ON k.rec = n.rec GROUP BY n.rec")
def tree_stats(s: SparkSession, d: str) -> DataFrame:
    n = T.nodes(s, d).groupBy("rec").agg(F.count("*").alias("nodes"), F.count_if(C("status") == "F").alias("reviews"), F.min("q").alias("q_min"), F.max("q").alias("q_max"), F.max(X.depth(C("tag"))).alias("depth"), F.array_sort(F.collect_list(F.when(C("status") == "F", C("rec") % 6))).alias("g"))
    counted = F.transform(F.array_distinct("g"), lambda g: text_of(g, ":", F.size(F.filter("g", lambda x: x == g))))
    return n.withColumn("grades", F.array_join(counted, ",")).drop("g")


@query(f"WITH {T.TURNS} SELECT rec, pos, string_agg(role, chr(10)) OVER (PARTITION BY rec ORDER BY pos ROWS UNBOUNDED PRECEDING) AS so_far FROM turns")
def cumulative_path_text(s: SparkSession, d: str) -> DataFrame:
    return trees.cumulative_text(T.turns(s, d).select("rec", "pos", "role"), ["rec"], ["pos"], "role").select("rec", "pos", "so_far")


@query(f"WITH {T.TRAJ} SELECT t.rec, t.tag, string_agg(trim(s.text, ' ' || chr(10)), chr(10) ORDER BY len(a.up)) AS so_far FROM traj t JOIN anc a ON a.rec = t.rec AND a.tag = t.tag JOIN traj s ON s.rec = a.rec AND s.tag = a.up WHERE s.text <> '' GROUP BY 1, 2")
def path_text(s: SparkSession, d: str) -> DataFrame:
    return T.trajectories(s, d).select(C("order").alias("rec"), F.inline(trees.so_far(C("react"))))


@query(f"WITH {T.NODES} SELECT rec, string_agg(tag || '=' || dimension, ',' ORDER BY len(string_split(tag, '.')), list_transform(string_split(tag, '.'), lambda x: x::INT)) AS states FROM nodes GROUP BY rec")
def state_map(s: SparkSession, d: str) -> DataFrame:
    made = trees.state_map(T.nodes(s, d), "rec", "tag", "dimension")
    return made.select("rec", F.array_join(F.transform(F.map_entries("react"), lambda e: text_of(e["key"], "=", e["value"]["dimension"])), ",").alias("states"))


# rounds of a search -------------------------------------------------------------------------------------------------------------------
@query("WITH x AS (SELECT doc_id, string_split(text, ' ') AS raw, list_transform(string_split(text, ' '), lambda w: trim(w, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS own FROM documents WHERE n_chars < 5000) SELECT doc_id, array_to_string(list_filter(raw, lambda w, i: list_position(own, own[i]) = i), '|') AS kept FROM x UNION ALL SELECT doc_id, NULL FROM documents WHERE n_chars >= 5000")
def expansion_dedupe(s: SparkSession, d: str) -> DataFrame:
    """A search's outputs, here a text's words, without repeats; texts of 5,000 characters and more aren't outputs of one step."""
    outputs = F.when(C("n_chars") < 5000, F.split("text", " "))
    return T.documents(s, d).select("doc_id", F.array_join(trees.first_texts(outputs), "|").alias("kept"))


@query(f"WITH {T.REVIEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, grade, pos % 2, pos % 4 = 3 ORDER BY pos) AS same FROM reviews) SELECT rec, pos FROM r WHERE same = 1 OR pos % 4 = 3")
def sibling_reviews(s: SparkSession, d: str) -> DataFrame:
    text = F.when(C("pos") % 4 == 3, F.lit("no JSON")).otherwise(text_of('<review>{"axiom_grade": ', C("grade"), ', "verdict": "', C("pos") % 2, '", "summary": "', C("pos"), '"}</review>'))
    return dedupe.sibling_reviews(T.reviews(s, d).withColumn("text", text), ["rec"], ["pos"], "text").select("rec", "pos")


@query()
def redundant_steps(s: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as steps under its first one: those that repeat an earlier one or the first go; short ones are never compared."""
    turns = T.turns(s, d).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    n = turns.select("rec", F.get("t", 0)["text"].alias("parent"), F.transform(F.slice("t", 2, 1 << 30), lambda x: x["text"]).alias("steps"))
    return dedupe.fresh_steps(n, ["rec"], "parent", "steps").select("rec", "at", "fresh")


FAIL = "Fail to sove the problem within limited steps."
BEAM = f"b AS (SELECT rec, tag, q, ln, status = 'F' AS terminal, CASE WHEN status <> 'F' THEN '' WHEN p % 3 = 0 THEN '{FAIL}' ELSE 'x' END AS answer, {DEPTH} AS depth FROM nodes), top AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY q DESC, ln) AS r FROM b QUALIFY r <= 3), f AS (SELECT *, CASE WHEN answer = 'x' THEN 'final' WHEN terminal OR depth > 2 THEN 'dropped' ELSE 'current' END AS fate FROM top)"


def _beam(s: SparkSession, d: str) -> DataFrame:
    n = T.nodes(s, d).select("rec", "ln", "tag", C("q").alias("value"), (C("status") == "F").alias("terminal"), F.when(C("status") != "F", "").when(C("p") % 3 == 0, FAIL).otherwise("x").alias("final_answer"), X.depth(C("tag")).alias("depth"))
    return trees.beam_round(n, ["rec"], ["ln"], F.lit(3), 2)


@query(f"WITH {T.NODES}, {BEAM} SELECT rec, tag, fate, CAST(3 - count(*) FILTER (fate <> 'current') OVER (PARTITION BY rec) AS INT) AS next_width FROM f")
def beam_round(s: SparkSession, d: str) -> DataFrame:
    return _beam(s, d).select("rec", "tag", "fate", "next_width")


@query(f"WITH {T.NODES}, {BEAM} SELECT rec, tag, row_number() OVER (PARTITION BY rec ORDER BY q DESC, ln) AS rank FROM f WHERE fate = 'final'")
def beam_solutions(s: SparkSession, d: str) -> DataFrame:
    return trees.solutions(_beam(s, d).where("fate = 'final'"), ["rec"], ["ln"]).select("rec", "tag", "rank")


# conversion ---------------------------------------------------------------------------------------------------------------------------
KEPT = f"""{T.TRAJ}, kept AS (SELECT *, CASE WHEN same > 1 THEN 'semantic_duplicate' WHEN dim = '' THEN 'skipped' ELSE 'kept' END AS fate FROM firsts),
path AS (SELECT a.rec, a.tag, list(s.segment ORDER BY len(s.tag)) AS segs, list(s.q ORDER BY len(s.tag)) AS qs, list(coalesce(b.best, s.q) ORDER BY len(s.tag)) AS bests,
 bool_or(NOT s.done AND contains(lower(s.segment), 'premature final review draft retained')) AS early
 FROM kept k JOIN anc a ON a.rec = k.rec AND a.tag = k.tag JOIN seg s ON s.rec = a.rec AND s.tag = a.up LEFT JOIN bestd b ON b.rec = a.rec AND b.tag = a.up WHERE s.segment IS NOT NULL GROUP BY 1, 2),
judged AS (SELECT k.*, p.segs, p.qs, p.bests, CASE WHEN error IS NULL THEN pred END AS own, CASE WHEN error IS NULL THEN k.target END AS goal,
 is_best AND q >= 0.5 AND error IS NULL AND NOT fault AS candidate, CASE WHEN early THEN 'premature_review_step' WHEN k.p % 5 = 0 THEN 'weak_final_evidence_type' WHEN k.p % 11 = 0 THEN 'empty_final_evidence' END AS issue
 FROM kept k JOIN path p USING (rec, tag)),
items AS (SELECT *, candidate AND coalesce(own = goal, false) AND issue IS NULL AS train, CASE WHEN candidate AND coalesce(own = goal, false) AND issue IS NOT NULL THEN 'weak_or_malformed_reasoning' WHEN candidate AND NOT coalesce(own = goal, false) THEN 'axiom_grade_mismatch' END AS block FROM judged WHERE fate = 'kept')"""


def kept(s: SparkSession, d: str, **options: object) -> DataFrame:
    return convert.converted(T.trajectories(s, d), **options).where("fate = 'kept'")


@query(f"WITH {KEPT} SELECT rec, tag, train, block, fault OR block IS NOT NULL AS value_only, is_best, own AS grade, error, array_to_string(segs, '|') AS response, round_even(list_sum(qs), 6) + 0.0 AS q_sum, round_even(list_sum(bests), 6) + 0.0 AS best_sum FROM items")
def convert_records(s: SparkSession, d: str) -> DataFrame:
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    return kept(s, d).select(
        C("order").alias("rec"), C("terminal_tag").alias("tag"), C("train_lm").alias("train"), C("policy_block_reason").alias("block"), C("force_value_only").alias("value_only"), C("is_best_path").alias("is_best"), C("parsed_axiom_grade").alias("grade"), C("terminal_error").alias("error"),
        F.array_join("response", "|").alias("response"), total("q_value").alias("q_sum"), total("q_descendant_best").alias("best_sum"),
    )


@query(f"WITH {KEPT}, names AS (SELECT CASE fate WHEN 'semantic_duplicate' THEN 'semantic_duplicate_reviews' WHEN 'skipped' THEN 'skipped_paths' ELSE 'paths' END AS name FROM kept UNION ALL SELECT CASE WHEN train THEN 'policy_paths' ELSE 'value_only_paths' END FROM items UNION ALL SELECT 'policy_grade_mismatch_paths' FROM items WHERE block = 'axiom_grade_mismatch' UNION ALL SELECT 'policy_reasoning_quality_blocked' FROM items WHERE block = 'weak_or_malformed_reasoning' UNION ALL SELECT 'policy_reasoning_quality_' || issue FROM items WHERE block = 'weak_or_malformed_reasoning' UNION ALL SELECT 'error_' || error FROM items WHERE error IS NOT NULL) SELECT name, count(*) AS n FROM names GROUP BY 1")
def convert_counters(s: SparkSession, d: str) -> DataFrame:
    return convert.counters(convert.converted(T.trajectories(s, d)))


@query(f"WITH {KEPT}, c AS (SELECT rec, dim, tag, row_number() OVER (PARTITION BY rec, dim ORDER BY NOT is_best, ln) AS r FROM items) SELECT rec, tag FROM c WHERE r <= 1")
def convert_under_cap(s: SparkSession, d: str) -> DataFrame:
    """At most one path for each record and dimension. Records have identities of their own here, so the first kept ones are the capped ones."""
    return kept(s, d, most_paths=1).select(C("order").alias("rec"), C("terminal_tag").alias("tag"))


FAULT_MESSAGES = "'- Unsupported provided-test-failure evidence: no_listed_executable_tests.' || chr(10) || '- Reward cap triggered by verifier: unsupported_provided_test_failure_evidence.'"


@query(f"WITH {KEPT}, c AS (SELECT * FROM items WHERE fault ORDER BY rec, NOT is_best, ln LIMIT 500) SELECT rec, tag || '#verifier_correction_paired_repair#repeat' || i AS tag, CAST(i AS INT) AS copy, goal AS grade, 0.8::DOUBLE AS q, contains(text, '<review>') AND len(segs) > 0 AS asked FROM c CROSS JOIN range(2) t(i)")
def correction_expand(s: SparkSession, d: str) -> DataFrame:
    made = kept(s, d, corrections="paired_repair", repeat=2, most_corrections=500).where("synthetic_type = 'verifier_correction_paired_repair'")
    asked = C("instruction").contains("Previous rejected review:\n<review>") & C("instruction").endswith("- Reward cap triggered by verifier: unsupported_provided_test_failure_evidence.") & C("train_lm") & (F.size("response") == 2)
    return made.select(C("order").alias("rec"), C("terminal_tag").alias("tag"), C("repeat").alias("copy"), C("parsed_axiom_grade").alias("grade"), C("terminal_q_value").alias("q"), asked.alias("asked"))


@query(f"WITH {KEPT}, new AS (SELECT rec, tag FROM items WHERE rec % 3 = 0), drawn AS (SELECT rec, tag, row_number() OVER (ORDER BY md5('7:unit:unit:' || rec || ':' || tag || ':0')) AS place FROM items WHERE rec % 2 = 0) SELECT rec, tag, 'new' AS split FROM new UNION ALL SELECT rec, tag, 'replay' FROM drawn WHERE place <= (SELECT round_even(0.5::DOUBLE * count(*), 0) FROM new) AND rec % 3 <> 0")
def replay_merge(s: SparkSession, d: str) -> DataFrame:
    """New items of a third of the records, and a replay of half as many of the even ones: what both have stays once, as the new item."""
    items = scratch.stored(kept(s, d).select("order", "pos", *convert.IDENTITY, "terminal_tag", "repeat", "is_best_path"), "items")
    new = items.where(C("order") % 3 == 0).withColumn("data_split", F.lit("new"))
    old = convert.replayed(items.where(C("order") % 2 == 0).withColumn("data_split", F.lit("replay")), 0.5, new.count(), 7)
    return convert.merged(new, old).select(C("order").alias("rec"), C("terminal_tag").alias("tag"), C("data_split").alias("split"))


# expanders ----------------------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id AS pair_id, 'pos' AS pair_role, source AS response FROM documents UNION ALL SELECT doc_id, 'neg', lang FROM documents WHERE doc_id % 3 <> 0")
def pair_explode(s: SparkSession, d: str) -> DataFrame:
    return expand.pair_rows(T.documents(s, d).withColumn("neg", F.when(C("doc_id") % 3 != 0, C("lang"))), "doc_id", "source", "neg")


@query(f"WITH {T.TURNS} SELECT rec, 'c' || (row_number() OVER (PARTITION BY rec ORDER BY pos) - 1) AS tag, text, round_even(1.0::DOUBLE / count(*) OVER (PARTITION BY rec), 6) + 0.0 AS prior FROM turns")
def pseudo_tree_flat(s: SparkSession, d: str) -> DataFrame:
    return expand.flat_tree(T.turns(s, d), "rec", "pos", "text")


@query(f"WITH {T.TURNS}, c AS (SELECT *, pos % 2 AS cand, row_number() OVER (PARTITION BY rec, pos % 2 ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY rec, pos % 2) AS size, count(DISTINCT pos % 2) OVER (PARTITION BY rec) AS cands, dense_rank() OVER (PARTITION BY rec ORDER BY pos % 2) - 1 AS c FROM turns) SELECT rec, 'c' || c || repeat('.0', CAST(k AS INT)) AS tag, text, CASE WHEN k = 0 THEN round_even(1.0::DOUBLE / cands, 6) + 0.0 ELSE 1.0::DOUBLE END AS prior, k = size - 1 AS terminal FROM c")
def pseudo_tree_chain(s: SparkSession, d: str) -> DataFrame:
    return expand.chain_tree(T.turns(s, d).withColumn("cand", C("pos") % 2), "rec", "cand", "pos", "text")


def _each(x: DataFrame, *columns: Column | str, name: str = "label") -> DataFrame:
    """A row for each value of q_value, with its place `i`. The outer generator has Spark infer no filter on q_value, which would compute it again below."""
    return x.select(*columns, F.posexplode_outer("q_value").alias("i", name)).where("i is not null")


# labels of items ----------------------------------------------------------------------------------------------------------------------
SEGMENTS = f"""{KEPT}, sg AS (SELECT rec, tag, error, len(segs) AS size, unnest(range(1, len(segs) + 1)) AS k, segs, qs, bests FROM items),
staged AS (SELECT rec, tag, error, k, size, qs[k] AS q, bests[k] AS best, CASE WHEN starts_with(segs[k], '<review>') THEN 'review' WHEN size <= 1 THEN 'early' WHEN k = size THEN 'final_step'
 WHEN (k - 1) / (size - 1)::DOUBLE < 0.34 THEN 'early' WHEN (k - 1) / (size - 1)::DOUBLE < 0.67 THEN 'middle' ELSE 'late' END AS stage FROM sg),
part AS (SELECT stage, count(*) AS n, avg(q) AS mean, stddev_pop(q) AS sd FROM staged WHERE error IS NULL GROUP BY 1),
whole AS (SELECT count(*) AS all_n, avg(q) AS all_mean, stddev_pop(q) AS all_sd FROM staged WHERE error IS NULL),
z AS (SELECT staged.*, CASE WHEN all_n >= 2 AND all_sd > 1e-6 AND n >= 2 AND sd > 1e-6 THEN printf('%.4f', (greatest(-1.0, least(1.0, all_mean + (q - mean) / sd * all_sd)))::DOUBLE)::DOUBLE + 0.0 ELSE q END AS z FROM staged LEFT JOIN part USING (stage) CROSS JOIN whole)"""


@query(f"WITH {SEGMENTS} SELECT rec, tag, CAST(k - 1 AS INT) AS i, stage, z FROM z")
def stage_standardize(s: SparkSession, d: str) -> DataFrame:
    items = scratch.stored(kept(s, d).select("order", "terminal_tag", "terminal_error", "raw_q_value", "q_stage"), "items")
    x = items.crossJoin(F.broadcast(labels.statistics(labels.stage_values(items), "stage", "q")))
    pairs = F.transform("raw_q_value", lambda q, i: F.struct(i.alias("i"), F.get("q_stage", i).alias("stage"), labels.standardized(q, F.get("q_stage", i)).alias("z")))
    return x.select(C("order").alias("rec"), C("terminal_tag").alias("tag"), F.inline(pairs))


@query(f"WITH {SEGMENTS} SELECT rec, tag, CAST(k - 1 AS INT) AS i, CASE WHEN error IS NOT NULL THEN q WHEN stage = 'review' OR k = size THEN printf('%.4f', (greatest(-1.0, least(1.0, q)))::DOUBLE)::DOUBLE + 0.0 ELSE printf('%.4f', (greatest(-1.0, least(1.0, 0.5::DOUBLE * q + 0.3::DOUBLE * best + 0.2::DOUBLE * z)))::DOUBLE)::DOUBLE + 0.0 END AS label FROM z")
def stage_blend(s: SparkSession, d: str) -> DataFrame:
    items = kept(s, d).select("order", "terminal_tag", "terminal_error", "terminal_q_value", "response", "q_value", "raw_q_value", "q_descendant_best", "q_stage")
    x = labels.blended(scratch.stored(items, "items"))
    return _each(x, C("order").alias("rec"), C("terminal_tag").alias("tag"))


CALIBRATION = f"""{KEPT}, marks AS (SELECT dim, q FROM term WHERE dim <> '' AND error IS NULL), part AS (SELECT dim, count(*) AS n, avg(q) AS mean, stddev_pop(q) AS sd FROM marks GROUP BY 1),
whole AS (SELECT count(*) AS all_n, avg(q) AS all_mean, stddev_pop(q) AS all_sd FROM marks), used AS (SELECT part.* FROM part CROSS JOIN whole WHERE n >= 8 AND sd > 1e-6 AND all_sd > 1e-6 AND all_n >= 8)"""


def _marks(s: SparkSession, d: str) -> DataFrame:
    return convert.marks(T.trajectories(s, d))


@query(f"WITH {CALIBRATION} SELECT dim, n, round_even(mean, 6) + 0.0 AS mean, round_even(sd, 6) + 0.0 AS sd, true AS enabled FROM used")
def q_calibrator(s: SparkSession, d: str) -> DataFrame:
    x = labels.calibrator(_marks(s, d), 8)
    return x.select("enabled", F.explode("parts").alias("dim", "v")).select("dim", "v.n", r6(C("v.mean")).alias("mean"), r6(C("v.sd")).alias("sd"), "enabled")


@query(f"WITH {CALIBRATION} SELECT rec, tag, CASE WHEN error IS NOT NULL OR n IS NULL THEN qs[len(qs)] ELSE printf('%.4f', (greatest(-1.0, least(1.0, 0.65::DOUBLE * qs[len(qs)] + 0.35::DOUBLE * (all_mean + (qs[len(qs)] - mean) / sd * all_sd))))::DOUBLE)::DOUBLE + 0.0 END AS q, CASE WHEN n IS NULL THEN 'skipped_missing_dimension' WHEN error IS NOT NULL THEN 'skipped_terminal_error' END AS skipped FROM items LEFT JOIN used USING (dim) CROSS JOIN whole")
def q_calibrate_apply(s: SparkSession, d: str) -> DataFrame:
    x = labels.calibrated(kept(s, d), labels.calibrator(_marks(s, d), 8), 0.35)
    change = C("calibration_change")
    return x.select(C("order").alias("rec"), C("terminal_tag").alias("tag"), F.get("q_value", F.size("q_value") - 1).alias("q"), F.when(change.startswith("skipped"), change).alias("skipped"))


@query(f"WITH {KEPT}, f AS (SELECT *, is_best AND q >= 0.2 AND error IS NULL AND NOT (fault OR block IS NOT NULL) AND coalesce(own = goal, false) AS fit FROM items) SELECT train AS before, fit AND issue IS NULL AS after, CASE WHEN fit AND issue IS NULL AND NOT train THEN 'upgraded' WHEN train AND NOT (fit AND issue IS NULL) THEN 'downgraded' END AS change, count(*) AS n FROM f GROUP BY ALL")
def policy_flags_refresh(s: SparkSession, d: str) -> DataFrame:
    x = labels.refreshed(kept(s, d).withColumn("before", C("train_lm")), 0.2)
    return x.groupBy("before", C("train_lm").alias("after"), C("policy_change").alias("change")).agg(F.count("*").alias("n"))


@query(f"WITH {KEPT} SELECT rec, tag, CASE WHEN train THEN segs[len(segs)] ELSE array_to_string(segs, '|') END AS response, CASE WHEN train THEN 1 ELSE len(qs) END::INT AS values FROM items")
def collapse_final_segment(s: SparkSession, d: str) -> DataFrame:
    x = labels.collapsed(kept(s, d))
    return x.select(C("order").alias("rec"), C("terminal_tag").alias("tag"), F.array_join("response", "|").alias("response"), F.size("q_value").alias("values"))


R4 = "printf('%.4f', greatest(-1.0, least(1.0, {}))::DOUBLE)::DOUBLE + 0.0"
TRAINING = f"""{SEGMENTS}, lab AS (SELECT rec, tag, k, size, CASE WHEN error IS NOT NULL THEN q WHEN stage = 'review' OR k = size THEN {R4.format('q')} ELSE {R4.format('0.5::DOUBLE * q + 0.3::DOUBLE * best + 0.2::DOUBLE * z')} END AS label FROM z),
marks AS (SELECT dim, q FROM term WHERE dim <> '' AND error IS NULL), mpart AS (SELECT dim, count(*) AS n, avg(q) AS mean, stddev_pop(q) AS sd FROM marks GROUP BY 1), mall AS (SELECT count(*) AS n, avg(q) AS mean, stddev_pop(q) AS sd FROM marks),
used AS (SELECT p.dim, p.mean, p.sd, w.mean AS all_mean, w.sd AS all_sd FROM mpart p CROSS JOIN mall w WHERE p.n >= 8 AND p.sd > 1e-6 AND w.sd > 1e-6 AND w.n >= 8),
cal AS (SELECT l.rec, l.tag, l.k, l.size, CASE WHEN i.error IS NOT NULL OR u.dim IS NULL THEN label ELSE {R4.format('0.65::DOUBLE * label + 0.35::DOUBLE * (all_mean + (label - mean) / sd * all_sd)')} END AS v FROM lab l JOIN items i USING (rec, tag) LEFT JOIN used u ON u.dim = i.dim),
mid AS (SELECT rec, dim, median(CASE WHEN error IS NULL THEN pred END) AS med, count(CASE WHEN error IS NULL THEN pred END) AS n, count(*) AS total FROM term WHERE dim <> '' GROUP BY 1, 2),
off AS (SELECT t.rec, t.dim, median(abs(t.pred - mid.med)) AS mad FROM term t JOIN mid USING (rec, dim) WHERE t.error IS NULL GROUP BY 1, 2),
cons AS (SELECT rec, dim, med, n / total::DOUBLE * greatest(0.0, 1 - mad / 2.5::DOUBLE) AS confidence FROM mid JOIN off USING (rec, dim) WHERE n >= 3),
held AS (SELECT i.rec, i.tag, i.train, i.issue, i.block, i.fault OR i.block IS NOT NULL AS value_only, i.is_best AND e.v >= 0.5 AND i.error IS NULL AND NOT (i.fault OR i.block IS NOT NULL) AND coalesce(i.own = i.goal, false) AS fit,
 CASE WHEN c.rec IS NOT NULL AND i.error IS NULL THEN printf('%.4f', greatest(0.0, 1 - 0.25::DOUBLE + 2 * (0.25::DOUBLE * confidence * greatest(0.0, 1 - abs(i.own - c.med) / 5.0::DOUBLE)))::DOUBLE)::DOUBLE END AS weight
 FROM items i JOIN cal e ON e.rec = i.rec AND e.tag = i.tag AND e.k = e.size LEFT JOIN cons c ON c.rec = i.rec AND c.dim = i.dim),
told AS (SELECT *, fit AND issue IS NULL AS now, issue IS NOT NULL AND (train OR fit) AS stopped FROM held)"""


@query(f"WITH {TRAINING} SELECT rec, tag, CAST(k - 1 AS INT) AS i, v AS q, now AS train, value_only OR stopped AS value_only, CASE WHEN stopped THEN 'weak_or_malformed_reasoning' ELSE block END AS block, CASE WHEN NOT now AND (value_only OR stopped) THEN 0.0::DOUBLE ELSE coalesce(weight, CASE WHEN value_only THEN 0.0::DOUBLE END) END AS lm_weight, weight AS value_weight, CASE WHEN now AND NOT train THEN 'upgraded' WHEN train AND NOT now THEN 'downgraded' END AS change FROM cal JOIN told USING (rec, tag)")
def training_rows(s: SparkSession, d: str) -> DataFrame:
    """The whole conversion with all its steps, by value: labels of each segment, calibration, consensus weights, policy flags."""
    rows = convert.training_rows(T.trajectories(s, d), calibration=0.35, consensus=0.25)
    made = _each(
        rows, C("order").alias("rec"), C("terminal_tag").alias("tag"), C("train_lm").alias("train"), C("force_value_only").alias("value_only"), C("policy_block_reason").alias("block"),
        C("lm_loss_weight").alias("lm_weight"), C("value_loss_weight").alias("value_weight"), C("policy_change").alias("change"), name="q",
    )
    return made.select("rec", "tag", "i", "q", "train", "value_only", "block", "lm_weight", "value_weight", "change")


@query()
def token_rows(s: SparkSession, d: str) -> DataFrame:
    """Items as token rows, counted by words: their length, how many tokens are marked and labelled, and whether they were cut."""
    x = kept(s, d).withColumns({"prompt": C("instruction"), "q_min": C("q_value"), "q_max": C("q_value")})
    t = udfs.tokenize_items(x, 80, keep=("order", "terminal_tag"))
    some = lambda c: F.size(F.filter(c, lambda v: v != -100))
    return t.select(C("order").alias("rec"), C("terminal_tag").alias("tag"), F.size("input_ids").alias("n"), some("q").alias("marked"), some("labels").alias("labelled"), C("exceeding_length").alias("cut"))
