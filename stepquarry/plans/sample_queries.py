"""Queries on samples, dedupe, consensus and the preparation of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions import texts as X
from ..operators import dedupe, labels, reward, samples, sampling
from . import tables as T
from .grade_queries import CLAMP, FROM_CORRECTNESS
from .registry import column, query, quoted, r6
from .tables import documents, text_of
from .text_queries import _canonical_sql

C = F.col
SEED = 20260424
MD5 = "md5('{}:' || {})"


# dedupe -------------------------------------------------------------------------------------------------------------------------------
@query(f"WITH {T.REVIEWS} SELECT rec, dimension, grade, min(pos) AS pos FROM reviews GROUP BY 1, 2, 3")
def dedupe_first_wins(s: SparkSession, d: str) -> DataFrame:
    return dedupe.first_wins(T.reviews(s, d), ["rec", "dimension", "grade"], ["pos"]).select("rec", "dimension", "grade", "pos")


@query(f"WITH {T.REVIEWS} SELECT rec, dimension, grade, pos, q FROM (SELECT *, row_number() OVER (PARTITION BY rec, grade ORDER BY q DESC, pos) AS r FROM reviews) WHERE r = 1")
def dedupe_semantic_best_first(s: SparkSession, d: str) -> DataFrame:
    return dedupe.first_wins(T.reviews(s, d), ["rec", "grade"], [F.desc("q"), "pos"]).select("rec", "dimension", "grade", "pos", "q")


@query(f"WITH {T.REVIEWS} SELECT dimension, min(pos) AS pos FROM reviews GROUP BY 1")
def distinct_in_order(s: SparkSession, d: str) -> DataFrame:
    return dedupe.distinct_in_order(T.reviews(s, d).select("dimension", "pos"), "dimension", ["pos"])


@query(f"WITH {T.REVIEWS} SELECT rec, dimension, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY rec, dimension ORDER BY pos) AS rank FROM reviews) WHERE rank <= 2")
def cap_per_dimension(s: SparkSession, d: str) -> DataFrame:
    return dedupe.top_k(T.reviews(s, d), ["rec", "dimension"], ["pos"], 2, rank="rank").select("rec", "dimension", "pos", "rank")


@query(f"WITH {T.REVIEWS} SELECT rec, dimension, pos, q FROM (SELECT *, row_number() OVER (PARTITION BY rec, dimension ORDER BY q DESC, pos) AS r FROM reviews) WHERE r = 1")
def best_per_dimension(s: SparkSession, d: str) -> DataFrame:
    return dedupe.first_wins(T.reviews(s, d), ["rec", "dimension"], [F.desc("q"), "pos"]).select("rec", "dimension", "pos", "q")


@query("SELECT doc_id, n FROM (SELECT doc_id, len(string_split(text, ' ')) AS n, row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) AS r FROM documents WHERE len(string_split(text, ' ')) <= 200) WHERE r = 1")
def token_filter_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Rows within the token budget, each key once: too long rows don't take a key."""
    short = documents(s, d).withColumn("n", F.size(F.split("text", " ")).cast("bigint")).where("n <= 200")
    return dedupe.first_wins(short, ["lang", "n_chars"], ["doc_id"]).select("doc_id", "n")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def heldout_anti_join(s: SparkSession, d: str) -> DataFrame:
    return dedupe.without_used(documents(s, d).select("doc_id"), T.read(s, d, "labels"), ["doc_id"])


@query("SELECT source || ':' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unused_in_training(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d)
    trained = docs.join(T.read(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").withColumn("dataset_index", C("doc_id"))
    return dedupe.without_used(docs.select(text_of(C("source"), ":", C("doc_id")).alias("id")), dedupe.usage_keys(trained).withColumnRenamed("used", "id"), ["id"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_pending(s: SparkSession, d: str) -> DataFrame:
    return dedupe.pending(T.read(s, d, "orders").select(C("o_orderkey").alias("id")), T.read(s, d, "lineitem").select(C("l_orderkey").alias("id")), "id")


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_repair(s: SparkSession, d: str) -> DataFrame:
    orders = T.read(s, d, "orders").select(C("o_orderkey").alias("id"), C("o_totalprice").alias("total"))
    return dedupe.repairs(orders.where("id % 2 = 0"), T.read(s, d, "lineitem").select(C("l_orderkey").alias("id")), orders, "id").select("id", "total")


# samples ------------------------------------------------------------------------------------------------------------------------------
@query(f"WITH {T.SAMPLES} SELECT doc_id, grade, rank FROM (SELECT doc_id, grade, row_number() OVER (PARTITION BY grade ORDER BY {MD5.format(SEED, 'doc_id')}, doc_id) AS rank FROM graded WHERE n_chars <= 12000 AND grade BETWEEN 1 AND 5 AND trim(text) <> '') WHERE rank <= 8")
def seed_balanced_take(s: SparkSession, d: str) -> DataFrame:
    good = T.graded(s, d).where(samples.usable(C("text"), F.array("source"), 12000) & C("grade").between(1, 5))
    return dedupe.top_k(good, ["grade"], sampling.seeded(SEED, "doc_id"), 8, rank="rank").select("doc_id", "grade", "rank")


@query(f"WITH {T.SAMPLES}, a AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {MD5.format(7, 'doc_id')}, doc_id) AS r FROM graded), b AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY {MD5.format(7, 'doc_id')}, doc_id) AS r2 FROM a WHERE r <= 20) SELECT doc_id, grade, row_number() OVER (ORDER BY grade, {MD5.format(7, 'doc_id')}, doc_id) - 1 AS new_index FROM b WHERE r2 <= 10")
def seed_two_phase(s: SparkSession, d: str) -> DataFrame:
    return sampling.two_phase(T.graded(s, d), "quality", "grade", 10, 2.0, 7, "doc_id").select("doc_id", "grade", "new_index")


@query(f"WITH {T.SAMPLES}, n AS (SELECT grade, count(*) AS n FROM graded GROUP BY 1) SELECT CAST(g AS INT) AS grade, coalesce(n, 0) AS n FROM range(6) t(g) LEFT JOIN n ON n.grade = g WHERE coalesce(n, 0) < 60")
def strict_shortfall(s: SparkSession, d: str) -> DataFrame:
    return sampling.short_strata(T.graded(s, d), "grade", 60, [*range(6)])


@query("WITH p AS (SELECT doc_id, doc_id // 2 AS pair_id FROM documents), k AS (SELECT DISTINCT pair_id, " + MD5.format(3, "pair_id") + " AS h FROM p ORDER BY h, pair_id LIMIT 25) SELECT doc_id, pair_id FROM p JOIN k USING (pair_id)")
def pair_preserving_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.pair_preserving(documents(s, d).select("doc_id", F.floor(C("doc_id") / 2).alias("pair_id")), "pair_id", 25, 3).select("doc_id", "pair_id")


@query(f"WITH {T.REVIEWS} SELECT * FROM (SELECT pos, 'half' AS kind FROM reviews ORDER BY {MD5.format(11, 'pos')}, pos LIMIT 12) UNION ALL SELECT pos, 'all' FROM reviews")
def replay_sample(s: SparkSession, d: str) -> DataFrame:
    """round(0.5 * 25) is 12, half to even; a negative ratio keeps all."""
    rows = T.reviews(s, d).select("pos")
    return sampling.replay(rows, 0.5, 25, 11, "pos").withColumn("kind", F.lit("half")).unionByName(sampling.replay(rows, -1, 25, 11, "pos").withColumn("kind", F.lit("all")))


@query(f"WITH {T.SAMPLES} SELECT doc_id, quality, turn FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {MD5.format(7, 'doc_id')}, doc_id) AS turn FROM samples) ORDER BY turn, quality LIMIT 50")
def round_robin_interleave(s: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(T.samples(s, d), "quality", 50, 7, "doc_id").select("doc_id", "quality", "turn")


REPEAT = f"{T.SAMPLES}, r AS (SELECT doc_id, subset, row_number() OVER (PARTITION BY subset ORDER BY {MD5.format(7, 'doc_id')}, doc_id) AS nth FROM samples), k AS (SELECT * FROM r WHERE nth <= 5), z AS (SELECT subset, count(*) AS size, row_number() OVER (ORDER BY subset) - 1 AS g FROM k GROUP BY 1)"


@query(f"WITH {REPEAT} SELECT doc_id, subset, 'd' || doc_id AS tag, CAST(NULL AS BIGINT) AS repeat FROM k UNION ALL SELECT k.doc_id, k.subset, 'd' || k.doc_id || '#rebalancepolicy' || j, j FROM range(30 - (SELECT count(*)::INT FROM k)) t(j) JOIN z ON z.g = j % (SELECT count(*) FROM z) JOIN k ON k.subset = z.subset AND k.nth = j % z.size + 1")
def repeat_oversample(s: SparkSession, d: str) -> DataFrame:
    """Five samples of a language at most, brought to thirty by repeats under tags of their own."""
    few = dedupe.top_k(T.samples(s, d), ["subset"], sampling.seeded(7, "doc_id"), 5).select("doc_id", "subset", text_of("d", C("doc_id")).alias("tag"))
    return sampling.balanced(few, "subset", 30, 7, "doc_id", "tag", "policy").select("doc_id", "subset", "tag", "repeat")


@query(f"WITH {T.SAMPLES} SELECT 'cut' AS kind, doc_id FROM (SELECT doc_id FROM samples ORDER BY {MD5.format(5, 'doc_id')}, doc_id LIMIT 20) UNION ALL SELECT 'same', doc_id FROM samples")
def total_adjust(s: SparkSession, d: str) -> DataFrame:
    rows = T.samples(s, d).select("doc_id", "subset", text_of("d", C("doc_id")).alias("tag"), F.lit(None).cast("long").alias("repeat"))
    cut = sampling.adjusted(rows, "subset", 20, 5, "doc_id", "tag").select(F.lit("cut").alias("kind"), "doc_id")
    return cut.unionByName(sampling.adjusted(rows, "subset", -1, 5, "doc_id", "tag").select(F.lit("same").alias("kind"), "doc_id"))


@query(f"WITH {T.SAMPLES} SELECT quality = 1 AS policy, count(*) AS n FROM samples GROUP BY 1")
def split_policy_value(s: SparkSession, d: str) -> DataFrame:
    policy, value = sampling.policy_and_value(T.samples(s, d).withColumn("train_lm", C("quality") == 1))
    return policy.groupBy(F.lit(True).alias("policy")).agg(F.count("*").alias("n")).unionByName(value.groupBy(F.lit(False).alias("policy")).agg(F.count("*").alias("n")))


TARGETS = f"{T.REVIEWS}, c AS (SELECT CASE WHEN pos % 3 = 0 THEN 'a' ELSE 'b' END AS name, count(*) FILTER (grade >= 4) AS policy, count(*) FILTER (grade < 4) AS value FROM reviews GROUP BY 1)"


@query(f"WITH {TARGETS}, w AS (SELECT min(policy) AS p, min(value) AS v FROM c) SELECT kind, name, CASE WHEN kind = 'baseline' THEN policy ELSE p END::BIGINT AS target_policy, CASE WHEN kind = 'least' THEN v ELSE value END::BIGINT AS target_value, (CASE WHEN kind = 'baseline' THEN policy ELSE p END + CASE WHEN kind = 'least' THEN v ELSE value END)::BIGINT AS target_total FROM c CROSS JOIN w CROSS JOIN (VALUES ('own_values'), ('least'), ('baseline')) k(kind)")
def balance_targets(s: SparkSession, d: str) -> DataFrame:
    counts = T.reviews(s, d).groupBy(F.when(C("pos") % 3 == 0, "a").otherwise("b").alias("name")).agg(F.count_if(C("grade") >= 4).alias("policy"), F.count_if(C("grade") < 4).alias("value"))
    parts = [sampling.targets(counts, k).select(F.lit(k).alias("kind"), "name", "target_policy", "target_value", "target_total") for k in ("own_values", "least", "baseline")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# consensus ----------------------------------------------------------------------------------------------------------------------------
def _marks(s: SparkSession, d: str) -> DataFrame:
    return T.reviews(s, d).withColumnRenamed("rec", "dataset_index").withColumnRenamed("dimension", "target_dimension")


CONSENSUS = f"WITH {T.REVIEWS}, ok AS (SELECT *, CASE WHEN error IS NULL THEN grade END AS g FROM reviews), mid AS (SELECT rec, dimension, median(g) AS median, count(g) AS n, count(*) AS total, arg_min(target, pos) FILTER (target IS NOT NULL) AS t FROM ok GROUP BY 1, 2), off AS (SELECT rec, dimension, median(abs(g - mid.median)) AS mad FROM ok JOIN mid USING (rec, dimension) WHERE g IS NOT NULL GROUP BY 1, 2), cons AS (SELECT rec, dimension, median, mad, n, total, t, n / total::DOUBLE * greatest(0.0, 1 - mad / 2.5::DOUBLE) AS confidence, 2 * greatest(0.0, 1 - abs(median - t) / 5.0::DOUBLE) - 1 AS reward FROM mid JOIN off USING (rec, dimension) WHERE n >= 3 AND t IS NOT NULL), it AS (SELECT r.*, c.median, c.reward, confidence, greatest(0.0, 1 - abs(r.grade - c.median) / 5.0::DOUBLE) AS al FROM reviews r LEFT JOIN cons c USING (rec, dimension)) "


@query(CONSENSUS + "SELECT rec, dimension, median, mad, n, total, round_even(confidence, 6) + 0.0 AS confidence, round_even(reward, 6) + 0.0 AS reward FROM cons")
def score_consensus(s: SparkSession, d: str) -> DataFrame:
    x = labels.consensus(_marks(s, d), ["pos"])
    return x.select(C("dataset_index").alias("rec"), C("target_dimension").alias("dimension"), C("median_axiom_grade").alias("median"), "mad", C("valid_count").alias("n"), C("total_count").alias("total"), r6(C("confidence")).alias("confidence"), r6(C("reward")).alias("reward"))


def _items(s: SparkSession, d: str, mode: str, strength: float) -> DataFrame:
    rows = _marks(s, d)
    items = rows.withColumns({"parsed_axiom_grade": C("grade"), "parsed_score": F.lit(None).cast("double"), "terminal_error": C("error"), "q_value": F.array("q"), "raw_q_value": F.array("q"), "terminal_q_value": C("q"), "value_loss_weight": F.lit(None).cast("double"), "lm_loss_weight": F.lit(None).cast("double")})
    return labels.with_consensus(items, labels.consensus(rows, ["pos"]), strength, mode)


CHANGE = "CASE WHEN median IS NULL THEN 'skipped_missing' WHEN error IS NOT NULL THEN 'skipped_terminal_error' ELSE '{}' END AS change"


@query(CONSENSUS + f"SELECT pos, CASE WHEN median IS NOT NULL AND error IS NULL THEN printf('%.4f', (greatest(0.0, 1 - 0.25::DOUBLE + 2 * (0.25::DOUBLE * confidence * al)))::DOUBLE)::DOUBLE + 0.0 END AS weight, {CHANGE.format('weighted')} FROM it")
def consensus_weight(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d, "weight", 0.25).select("pos", C("value_loss_weight").alias("weight"), C("consensus_change").alias("change"))


@query(CONSENSUS + "SELECT pos, CASE WHEN median IS NOT NULL AND error IS NULL THEN printf('%.4f', (greatest(-1.0, least(1.0, (1 - (0.3::DOUBLE * confidence * al)) * q + (0.3::DOUBLE * confidence * al) * reward)))::DOUBLE)::DOUBLE + 0.0 ELSE q END AS adjusted FROM it")
def consensus_q_adjust(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d, "q_adjust", 0.3).select("pos", C("terminal_q_value").alias("adjusted"))


# preparation --------------------------------------------------------------------------------------------------------------------------
def _raw(s: SparkSession, d: str) -> DataFrame:
    """Samples as raw critic rows: tests of two kinds, checklists, and which assertions a runner saw pass."""
    k = C("doc_id") % 4
    return T.samples(s, d).withColumns(
        {
            "question": text_of("Q ", C("source")), "answer": C("text"), "public_tests": F.when(k == 0, F.array(F.lit("assert a"), F.lit(" assert b"))).when(k == 1, F.array(F.lit("stdin"))), "private_tests": F.when(k == 0, F.array(F.lit("assert c"))),
            "public_passed": F.when(k == 0, F.array(F.lit(True), C("toxic") == 0)).otherwise(F.array().cast("array<boolean>")), "private_passed": F.when(k == 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
            "checklist_dimensions": F.array(F.lit("Style"), F.lit("Correctness Verification"), F.lit("Extra")), "checklist_scores": F.array(F.lit(1.0), C("score")), "checklists": F.array(F.lit("s"), F.lit("c"), F.lit("e")),
        }
    )


RAW = f"{T.SAMPLES}, raw AS (SELECT *, doc_id % 4 = 0 AS ran, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE printf('%.4f', (2 / 3.0::DOUBLE)::DOUBLE)::DOUBLE END ELSE 0.0::DOUBLE END AS rate, CASE WHEN doc_id % 4 = 0 THEN 3 WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS tests, {FROM_CORRECTNESS} AS mapped FROM samples)"


@query(f"WITH {RAW} SELECT doc_id, ran, rate, CAST(tests AS INT) AS tests, CASE WHEN ran THEN printf('%.2f', (0.6::DOUBLE * score + 0.4::DOUBLE * (10.0 * rate))::DOUBLE)::DOUBLE + 0.0 ELSE score END AS target_score, CASE WHEN ran AND rate >= 0.999 AND mapped < 3 THEN 3 ELSE mapped END AS grade, {quoted(samples.RUBRIC + chr(10) + 'Reference checklist item: c')} AS rubric, {quoted(X.REVIEW_QUESTION)} || 'Q ' || source AS question FROM raw")
def prepared_samples(s: SparkSession, d: str) -> DataFrame:
    x = samples.prepared(_raw(s, d))
    return x.select("doc_id", C("objective.has_executable_tests").alias("ran"), C("objective.full_test_pass_rate").alias("rate"), F.size("tests").alias("tests"), C("dimension_target_score").alias("target_score"), C("axiom_target_grade").alias("grade"), "rubric", C("review_question").alias("question"))


@query(f"WITH {RAW}, r AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'missing_grade' WHEN tests = 0 OR length(text) > 3000 THEN 'unusable' WHEN mapped < 1 THEN 'outside_rough_grade_range_' || mapped END AS reason FROM raw) SELECT reason, count(*) AS n FROM r GROUP BY 1")
def skip_reasons(s: SparkSession, d: str) -> DataFrame:
    x = _raw(s, d)
    rough = F.when(C("doc_id") % 17 != 0, G.grade_from_correctness(C("correctness"), C("score")))
    good = samples.usable(C("answer"), samples.all_tests(C("public_tests"), C("private_tests")), 3000, C("checklist_dimensions"))
    return x.groupBy(samples.skip_reason(rough, good, 1, 5).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN CAST(n_chars % 8 AS INT) WHEN doc_id % 3 = 2 THEN CAST(floor(n_chars % 8 + 0.75) AS INT) END AS grade, CASE doc_id % 3 WHEN 0 THEN false ELSE n_chars % 8 <= 5 AND length(text) <= 1000 END AS usable FROM documents")
def ordinal_candidates(s: SparkSession, d: str) -> DataFrame:
    """Scores as text or numbers: 3.5 as text is no whole number, as a number it is cut."""
    k, n = C("doc_id") % 3, C("n_chars") % 8
    grade = F.when(k == 2, samples.ordinal_grade(n + 0.75)).otherwise(samples.ordinal_grade(F.when(k == 1, n.cast("string")).otherwise(text_of(n, ".5")), textual=True))
    return documents(s, d).select("doc_id", grade.alias("grade"), samples.ordinal_usable(grade, C("text"), C("source"), 1000).alias("usable"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE n_chars % 6 <> 0) WHERE r <= 3")
def per_source_limit(s: SparkSession, d: str) -> DataFrame:
    return samples.first_per_source(documents(s, d).where(G.clamp_grade(C("n_chars") % 6) != 0), "source", ["doc_id"], 3).select("doc_id", "source")


@query("SELECT pair, doc_id FROM (SELECT doc_id // 3 AS pair, doc_id, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS r FROM documents WHERE doc_id % 3 <> 0) WHERE r = 1")
def two_sided_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = documents(s, d).select("doc_id", F.floor(C("doc_id") / 3).alias("pair"), C("text").alias("pos"), F.when(C("doc_id") % 3 != 0, C("lang")).alias("neg"))
    return samples.both_sides(pairs, "pair", "pos", "neg", ["doc_id"]).select("pair", "doc_id")


column("pass_rates", T.reviews, ["pos"], lambda: {"rate": samples.pass_rate(F.filter(F.array(C("grade") > 1, C("grade") > 2, C("error").isNull(), C("q") > 0), lambda p: C("pos") % 7 != 0), 3)}, T.REVIEWS, "CASE WHEN pos % 7 = 0 THEN 0.0::DOUBLE ELSE printf('%.4f', (((grade > 1)::INT + (grade > 2)::INT + (error IS NULL)::INT) / 3.0::DOUBLE)::DOUBLE)::DOUBLE + 0.0 END AS rate", "reviews")
column("last_of_equal_keys", T.reviews, ["pos"], lambda: {"got": samples.zipped(F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("c")), F.array(C("grade"), C("pos"), C("rec")))["a"].cast("bigint"), "size": F.size(samples.zipped(F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("c")), F.array(C("grade"), C("pos"), C("rec"))))}, T.REVIEWS, "rec AS got, 2::INT AS size", "reviews")


@query("SELECT doc_id, CAST(n_chars % 6 AS INT) AS grade, CASE WHEN n_chars % 6 >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rate, n_chars % 6 * 20.0::DOUBLE AS score, CASE WHEN n_chars % 6 >= 3 THEN 'Correct' ELSE 'Error' END AS label, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'python' END AS language FROM documents")
def ordinal_samples(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select("doc_id", C("source").alias("inst"), C("text").alias("code"), F.when(C("doc_id") % 2 == 0, C("lang")).alias("lang"), (C("n_chars") % 6).cast("int").alias("grade"))
    return samples.ordinal_sample(rows).select("doc_id", "grade", C("pass_rate").alias("rate"), C("axiom_target_score").alias("score"), C("correctness_label").alias("label"), C("code_language").alias("language"))


@query("WITH g AS (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars % 6 AS INT) END AS given, CASE WHEN doc_id % 3 = 0 THEN (n_chars % 11)::DOUBLE END AS s FROM documents), h AS (SELECT *, coalesce(s, coalesce(given, 0) * 20.0::DOUBLE / 10) AS overall, CASE WHEN coalesce(given, 0) >= 3 THEN 'Correct' ELSE 'Error' END AS label FROM g) SELECT doc_id, overall, label, coalesce(given, CASE WHEN overall <= 1 THEN 0 WHEN overall <= 3 THEN 1 ELSE 2 END) AS grade, coalesce(s, 0.0) AS reference FROM h")
def prepared_defaults(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select("doc_id", C("lang").alias("problem"), F.when(C("doc_id") % 2 == 0, C("n_chars") % 6).cast("int").alias("axiom_target_grade"), F.when(C("doc_id") % 3 == 0, C("n_chars") % 11).cast("double").alias("overall_score"))
    return samples.with_defaults(rows).select("doc_id", C("overall_score").alias("overall"), C("correctness_label").alias("label"), C("axiom_target_grade").alias("grade"), C("reference_score").alias("reference"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'prepared' WHEN 1 THEN 'ordinal' WHEN 2 THEN 'critic' END AS shape, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN source WHEN 2 THEN lang END AS problem, CASE doc_id % 4 WHEN 1 THEN 'unknown' WHEN 2 THEN 'python' END AS language, CASE doc_id % 4 WHEN 1 THEN CAST(n_chars % 6 AS INT) WHEN 2 THEN 3 END AS grade, CASE doc_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 2 END::INT AS tests FROM documents")
def common_samples(s: SparkSession, d: str) -> DataFrame:
    k = C("doc_id") % 4
    when = lambda n, c: F.when(k == n, c)
    rows = documents(s, d).select(
        "doc_id", when(0, C("text")).alias("candidate_code"), when(0, C("lang")).alias("problem"), when(1, C("source")).alias("inst"), when(1, C("text")).alias("code"), when(1, C("n_chars") % 6).cast("string").alias("score1"),
        when(2, C("text")).alias("answer"), when(2, C("lang")).alias("question"), when(2, F.lit("Correct")).alias("correctness"), when(2, F.array(F.lit("a"))).alias("public_tests"), when(2, F.array(F.lit("b"))).alias("private_tests"),
    )
    x = samples.common_sample(rows.withColumn("score", F.coalesce("score1", F.when(k == 2, "5"))))
    return x.select("doc_id", "shape", "problem", "language", C("axiom_target_grade").alias("grade"), F.size("tests").alias("tests"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars % 6 AS INT) END AS grade, CASE WHEN doc_id % 2 = 0 THEN n_chars % 6 * 20.0::DOUBLE END AS score, CASE WHEN doc_id % 2 = 0 THEN (n_chars % 6) || '-' || (n_chars % 6) ELSE '0-' || least(5, 2 + doc_id % 5) END AS interval, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END AS language FROM documents")
def manifest_rows(s: SparkSession, d: str) -> DataFrame:
    odd = C("doc_id") % 2 == 1
    rows = documents(s, d).select("doc_id", C("source").alias("problem"), C("text").alias("candidate_code"), F.when(C("doc_id") % 5 != 0, C("lang")).alias("language"), F.when(~odd, C("n_chars") % 6).alias("grade"), F.when(odd, 2 + C("doc_id") % 5).alias("low"), F.when(odd, F.lit(-1)).alias("high"))
    x = samples.manifest_rows(rows)
    return x.select("doc_id", C("axiom_target_grade").alias("grade"), C("axiom_target_score").alias("score"), F.array_join(C("axiom_target_interval").cast("array<string>"), "-").alias("interval"), "language")


@query(f"WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars % 6 AS INT) END AS g, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS a, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 2 END AS b FROM documents), y AS (SELECT *, coalesce(g, {CLAMP.format('(a + b) / 2.0::DOUBLE')}) AS grade, coalesce(g, a) AS lo, coalesce(g, b) AS hi FROM x) SELECT doc_id, {_canonical_sql(False)} AS response, printf('%.4f', (grade / 2.5::DOUBLE - 1)::DOUBLE)::DOUBLE + 0.0 AS q, printf('%.4f', (lo / 2.5::DOUBLE - 1)::DOUBLE)::DOUBLE + 0.0 AS q_min, printf('%.4f', (hi / 2.5::DOUBLE - 1)::DOUBLE)::DOUBLE + 0.0 AS q_max, CASE WHEN lo = hi THEN grade END AS target, grade * 20.0::DOUBLE AS score, CASE WHEN g IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lm_weight FROM y")
def static_score_items(s: SparkSession, d: str) -> DataFrame:
    """Exact grades, and binary labels as intervals."""
    even = C("doc_id") % 2 == 0
    low, high = G.interval_from_binary(F.when(C("doc_id") % 3 == 0, 1).otherwise(0))
    rows = documents(s, d).select("doc_id", F.when(even, C("n_chars") % 6).cast("int").alias("grade"), F.when(~even, low).alias("low"), F.when(~even, high).alias("high"))
    x = samples.static_items(rows, F.when(even, "exact").otherwise("interval_correctness"), F.when(even, samples.CONFIDENCE["exact"]).otherwise(samples.CONFIDENCE["interval_correctness"]), even)
    return x.select("doc_id", C("response")[0].alias("response"), C("q_value")[0].alias("q"), C("q_min")[0].alias("q_min"), C("q_max")[0].alias("q_max"), C("target_axiom_grade").alias("target"), C("target_score").alias("score"), C("lm_loss_weight").alias("lm_weight"))


@query(f"WITH {T.SAMPLES} SELECT doc_id, {_canonical_sql(True)} AS response, printf('%.4f', (grade / 2.5::DOUBLE - 1)::DOUBLE)::DOUBLE + 0.0 AS q, 'static_exact' AS tag, 0.15::DOUBLE AS lm_weight FROM graded")
def static_exact_items(s: SparkSession, d: str) -> DataFrame:
    rows = T.graded(s, d).withColumns({"problem": C("source"), "candidate_code": C("text"), "language": C("subset"), "axiom_target_grade": C("grade")})
    return samples.exact_items(rows).select("doc_id", C("response")[0].alias("response"), C("terminal_q_value").alias("q"), C("terminal_tag").alias("tag"), C("lm_loss_weight").alias("lm_weight"))


# reward -------------------------------------------------------------------------------------------------------------------------------
KINDS = ["provided_test_failure", "deduced_counterexample", "uncertain", "none"]
REWARD = f"""{T.REVIEWS}, r AS (SELECT *, pos % 3 AS tr, pos % 2 AS fa, {KINDS}[pos % 4 + 1] AS kind, CASE WHEN pos % 5 = 0 THEN 'Style' ELSE 'Correctness Verification' END AS dim, pos % 6 <> 0 AS listed, CASE WHEN pos % 8 = 0 THEN 'correct' ELSE 'x' END AS label,
 abs(grade - target) AS dist, (grade >= 3) = (target >= 3) AS side, pos % 2 = 1 AND pos % 10 < 4 AS bad_test, pos % 2 = 1 AND pos % 10 BETWEEN 4 AND 6 AS bad_name FROM reviews WHERE target IS NOT NULL),
c AS (SELECT *, least(1.0::DOUBLE, CASE WHEN fa > 0 THEN CASE WHEN tr > 0 THEN 0.70::DOUBLE ELSE 0.55::DOUBLE END ELSE 1 END, CASE WHEN bad_test THEN CASE WHEN grade < 3 OR NOT side THEN 0.15::DOUBLE ELSE 0.55::DOUBLE END ELSE 1 END, CASE WHEN bad_name THEN 0.25::DOUBLE ELSE 1 END,
 CASE WHEN grade < 3 AND kind NOT IN ('provided_test_failure', 'deduced_counterexample', 'static_logic_contradiction') THEN 0.55::DOUBLE ELSE 1 END, CASE WHEN grade < 3 AND kind = 'provided_test_failure' AND NOT listed THEN 0.35::DOUBLE ELSE 1 END, CASE WHEN grade < 3 AND kind = 'uncertain' THEN 0.45::DOUBLE ELSE 1 END,
 CASE WHEN dim = 'Correctness Verification' AND label = 'correct' AND grade < 3 THEN 0.55::DOUBLE ELSE 1 END, CASE WHEN NOT side THEN 0.35::DOUBLE ELSE 1 END, CASE WHEN dist >= 2 THEN greatest(0.10::DOUBLE, 0.45::DOUBLE - 0.15::DOUBLE * (dist - 2)) ELSE 1 END) AS cap,
 greatest(0.0::DOUBLE, 1 - dist / 5.0::DOUBLE) AS al, side::INT::DOUBLE AS fu, CASE WHEN pos % 7 = 0 THEN (dim = 'Style')::INT::DOUBLE ELSE 1.0::DOUBLE END AS di, CASE WHEN target >= 4 THEN 2 WHEN target = 3 THEN 1 ELSE 0 END AS v1, CASE WHEN grade >= 4 THEN 2 WHEN grade = 3 THEN 1 ELSE 0 END AS v2,
 CASE WHEN fa > 0 THEN tr / (tr + fa)::DOUBLE ELSE 1.0::DOUBLE END AS ev FROM r)"""


def _review(s: SparkSession, d: str) -> tuple[DataFrame, reward.Review]:
    p = C("pos")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (p % 4 + 1).cast("int"))
    named = F.when(p % 7 == 0, ', "dimension": "Style"').otherwise("")
    payload = F.when(p % 97 == 0, F.lit("{torn")).when(p % 89 == 0, F.lit('{"x": 1}')).otherwise(text_of('{"axiom_grade": ', C("grade"), ', "verdict": "', G.verdict(C("grade")), '", "evidence_type": "', kind, '", "evidence": ["e"]', named, "}"))
    check = lambda kind, ok: F.struct(F.lit(kind).alias("kind"), F.lit(ok).alias("supported"))
    bad = F.when(p % 10 < 4, check("provided_test_failure", False)).when(p % 10 <= 6, check("unused_identifier", False)).otherwise(check("call", False))
    checks = F.concat(F.array_repeat(check("call", True), (p % 3).cast("int")), F.array_repeat(bad, (p % 2).cast("int")))
    rows = T.reviews(s, d).where("target is not null").withColumns({"payload": X.review_payload(payload), "checks": checks, "dim": F.when(p % 5 == 0, "Style").otherwise(reward.CORRECTNESS), "label": F.when(p % 8 == 0, "correct").otherwise("x"), "tests": F.when(p % 6 != 0, F.array(F.lit("assert a")))})
    return rows, reward.Review(C("payload"), C("dim"), C("target"), C("tests"), F.lit(1.0), C("label"), C("checks"))


@query(f"WITH {REWARD} SELECT pos, CASE WHEN pos % 97 = 0 OR pos % 89 = 0 THEN -1.0::DOUBLE ELSE printf('%.4f', (2 * least(CASE WHEN dim = 'Style' THEN 0.50::DOUBLE * al + 0.20::DOUBLE * fu + 0.10::DOUBLE * di + 0.10::DOUBLE * (1 - abs(v1 - v2) / 2.0::DOUBLE) + 0.10::DOUBLE * ev ELSE 0.45::DOUBLE * al + 0.25::DOUBLE * fu + 0.10::DOUBLE * di + 0.10::DOUBLE * (1 - abs(v1 - v2) / 2.0::DOUBLE) + 0.10::DOUBLE * ev END, cap) - 1)::DOUBLE)::DOUBLE + 0.0 END AS reward, CASE WHEN pos % 97 = 0 THEN 'invalid_review_json' WHEN pos % 89 = 0 THEN 'missing_or_invalid_axiom_grade' END AS error FROM c")
def reward_caps(s: SparkSession, d: str) -> DataFrame:
    rows, review = _review(s, d)
    return rows.withColumn("r", reward.reward(review)).select("pos", C("r.reward").alias("reward"), C("r.error").alias("error"))


@query(f"WITH {REWARD}, n AS (SELECT unnest([CASE WHEN fa > 0 THEN 'false_executable_evidence_claim' END, CASE WHEN bad_test THEN 'unsupported_provided_test_failure_evidence' || CASE WHEN grade < 3 OR NOT side THEN '' ELSE '_correct_boundary' END END, CASE WHEN bad_name THEN 'unsupported_unused_identifier_evidence' END, CASE WHEN grade < 3 AND kind NOT IN ('provided_test_failure', 'deduced_counterexample') THEN 'low_grade_without_concrete_evidence_type' END, CASE WHEN grade < 3 AND kind = 'provided_test_failure' AND NOT listed THEN 'test_failure_claim_without_available_tests' END, CASE WHEN grade < 3 AND kind = 'uncertain' THEN 'uncertain_evidence_cannot_support_low_grade' END, CASE WHEN dim <> 'Style' AND label = 'correct' AND grade < 3 THEN 'functional_correctness_boundary_conflict' END, CASE WHEN NOT side THEN 'axiom_functionality_boundary_mismatch' END, CASE WHEN dist >= 2 THEN 'axiom_ordinal_grade_distance_' || dist END]) AS reason FROM c WHERE pos % 97 <> 0 AND pos % 89 <> 0) SELECT reason, count(*) AS n FROM n WHERE reason IS NOT NULL GROUP BY 1")
def reward_cap_reasons(s: SparkSession, d: str) -> DataFrame:
    rows, review = _review(s, d)
    return rows.select(F.explode(reward.reward(review)["caps"]).alias("c")).groupBy(C("c.reason").alias("reason")).agg(F.count("*").alias("n"))
