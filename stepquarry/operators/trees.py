"""Search trees as one row a record, their nodes an array in the order they were made: lineages, paths, statistics, selection.

A record's tree is one JSON object at the source, so all of this works on the array: nodes that come as rows are packed by one shuffle, and
nothing is joined afterwards. What depends on subtrees or ways comes from `intervals`, in one scan of a record's nodes. A node is a struct with at least `tag`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.exact import let
from . import intervals

#: Answers that stand for a failure, and the value that stands for none.
FAILURES = (
    "Fail to generate parsable text for next step.",
    "Fail to sove the problem within limited steps.",
    "Too many consecutive steps have code errors.",
)
IGNORED = -100.0


def packed(nodes: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """A row for each record: keys, and `react`, its nodes (columns) in the given order."""
    entry = F.struct(*order, F.struct(*columns).alias("_node"))
    return nodes.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["_node"]).alias("react"))


def ancestors(react: Column, tag: Column) -> Column:
    """The nodes on the way to a tag, root first, itself last; prefixes without a node are passed over."""
    found = F.filter(react, lambda n: texts.descends(tag, n["tag"]))
    return F.transform(F.sort_array(F.transform(found, lambda n: F.struct(F.length(n["tag"]).alias("l"), n.alias("n")))), lambda e: e["n"])


def is_terminal(node: Column) -> Column:
    """Nodes with a final answer; one that stands for a failure counts too."""
    return F.coalesce(node["final_answer"], F.lit("")) != ""


def valid_final(answer: Column) -> Column:
    return (F.coalesce(answer, F.lit("")) != "") & ~answer.isin(*FAILURES)


def valued(node: Column, error: Column) -> Column:
    """The value of a terminal node that has one and no error, else null: what best_descendants looks among."""
    return F.when(is_terminal(node) & (F.coalesce(error, F.lit("")) == "") & (node["q_value"] != IGNORED), node["q_value"])


def best_descendants(react: Column, errors: Column | None = None) -> Column:
    """For each node the best value of a valued terminal at or below it; its own value if there is none. errors: of each node, where they are known."""
    if errors is None:
        best = intervals.best_values(react, lambda n: valued(n, texts.terminal_error(n["reward_details"])))
    else:
        best = intervals.best_of(react, F.zip_with(react, errors, valued))
    return F.zip_with(react, best, lambda n, best: F.coalesce(best, n["q_value"]))


def backup(react: Column, reward: str) -> Column:
    """(tag, visits, q) of every node: how many rewards (of nodes at or below it that have one) it got, and their mean, 0 without any."""
    mean = lambda t: F.when(t["visits"] > 0, t["total"] / t["visits"]).otherwise(0.0)
    return F.zip_with(react, intervals.totals(react, lambda n: n[reward]), lambda n, t: F.struct(n["tag"].alias("tag"), t["visits"].alias("visits"), mean(t).alias("q")))


def puct(q: Column, prior: Column, visits: Column, parent_visits: Column, c: float = 1.5) -> Column:
    return q + c * prior * F.sqrt(parent_visits) / (1 + visits)


def selected(react: str, c: float = 1.5, seed: int = 42) -> Column:
    """(parent, tag, score) of the child that PUCT picks under each node: of nodes (tag, visits, q, prior, terminal), terminal ones aside.

    react: a column's name. Of equal scores the child with the least md5(seed:tag) is taken, a draw that can be repeated."""
    nodes = F.col(react)
    draw = lambda k: F.md5(F.concat(F.lit(f"{seed}:"), k["tag"]))
    score = lambda k, up: F.bround(puct(k["q"], k["prior"], k["visits"], F.get(nodes, up)["visits"], c), 9)
    kids = F.zip_with(nodes, intervals.parents(nodes), lambda k, up: F.when(~k["terminal"] & up.isNotNull(), F.struct(up.alias("up"), (-score(k, up)).alias("less"), draw(k).alias("draw"), k["tag"].alias("tag"))))
    # sorted by parent, then score: the first of each parent's is its pick
    ranked = F.sort_array(F.array_compact(kids))
    firsts = let(ranked, lambda x: F.filter(x, lambda k, i: (i == 0) | (F.get(x, i - 1)["up"] != k["up"])))
    return F.transform(firsts, lambda k: F.struct(F.get(nodes, k["up"])["tag"].alias("parent"), k["tag"].alias("tag"), (-k["less"]).alias("score")))


def frontier(react: Column, most_depth: int, limit: int = 0) -> Column:
    """Tags of open leaves, deepest first, then by q, visits and value; ties in the order they were made. limit 0 gives all.

    Open: neither terminal nor with children, not deeper than most_depth, with a dimension."""
    open_ = lambda n, at: at["leaf"] & ~n["terminal"] & (F.coalesce(n["target_dimension"], F.lit("")) != "") & (at["shown"] <= most_depth)
    rank = lambda n, at: F.struct(at["shown"].alias("d"), n["q_value"].alias("q"), n["visit_count"].alias("v"), F.coalesce(n["value"], F.lit(IGNORED)).alias("x"))
    marked = F.zip_with(react, intervals.standing(react), lambda n, at: F.struct(open_(n, at).alias("open"), rank(n, at).alias("rank"), n["tag"].alias("tag")))
    ranked = F.filter(F.transform(marked, lambda x, i: F.struct(x["rank"], (-i).alias("i"), x["tag"], x["open"])), lambda x: x["open"])
    tags = F.transform(F.sort_array(ranked, asc=False), lambda e: e["tag"])
    return F.slice(tags, 1, limit) if limit > 0 else tags


def expandable(react: Column, most_depth: int, explore_depth: int, leaf_target: int = 0, node_budget: int = 0, linear: Column | None = None) -> Column:
    """(tag, may) of every node: whether it may get children, being not terminal, not too deep, and neither enough valid leaves nor nodes there yet (0: no
    such bound). A linear rollout only ends at most_depth."""
    leaves = F.size(F.filter(react, lambda n: n["terminal"] & valid_final(n["final_answer"])))
    shown = F.size(F.filter(react, lambda n: F.coalesce(n["text"], F.lit("")) != ""))
    full = F.lit(False)
    if leaf_target > 0:
        full = full | (leaves >= leaf_target)
    if node_budget > 0:
        full = full | (shown >= node_budget)
    rolled = F.coalesce(linear, F.lit(False)) if linear is not None else F.lit(False)
    fits = lambda at: F.when(rolled, at["shown"] <= most_depth).otherwise((at["shown"] <= explore_depth) & (at["shown"] < most_depth))
    once = F.struct(full.alias("full"), intervals.standing(react).alias("at"))
    return let(once, lambda v: F.zip_with(react, v["at"], lambda n, at: F.struct(n["tag"].alias("tag"), (~n["terminal"] & fits(at) & (rolled | ~v["full"])).alias("may"))))


def may_expand(react: Column, tag: Column, most_depth: int, explore_depth: int, leaf_target: int = 0, node_budget: int = 0, linear: Column | None = None) -> Column:
    """`expandable` of the node with the tag; null where no node has it."""
    return F.get(F.filter(expandable(react, most_depth, explore_depth, leaf_target, node_budget, linear), lambda n: n["tag"] == tag), 0)["may"]


def so_far(react: Column) -> Column:
    """(tag, so_far) of every node: the stripped texts on the way to it, a line each."""
    told = lambda n: F.when(F.coalesce(n["text"], F.lit("")) != "", texts.strip(n["text"]))
    return F.zip_with(react, intervals.ways(react), lambda n, way: F.struct(n["tag"].alias("tag"), F.array_join(F.transform(way, lambda j: told(F.get(react, j))), "\n").alias("so_far")))


def state_map(nodes: DataFrame, record: str, tag: str, *columns: str) -> DataFrame:
    """A map from tag to node for each record, level by level, in the tags' natural order."""
    entry = F.struct(texts.depth(F.col(tag)).alias("d"), texts.natural_key(F.col(tag)).alias("k"), F.col(tag).alias("key"), F.struct(*columns).alias("value"))
    return nodes.groupBy(record).agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["key"], x["value"]))).alias("react"))


def cumulative_text(rows: DataFrame, keys: list[str], order: list[str], text: str, out: str = "so_far") -> DataFrame:
    """A path given as rows: each row with the texts up to it, a line each."""
    names = [c for c in rows.columns if c not in keys]
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in names if c not in order]))).alias("_path"))
    upto = F.transform("_path", lambda x, i: x.withField(out, F.array_join(F.transform(F.slice("_path", F.lit(1), i + 1), lambda y: y[text]), "\n")))
    return whole.select(*keys, F.inline(upto))


# rounds of a search -------------------------------------------------------------------------------------------------------------------
def first_texts(outputs: Column) -> Column:
    """Generated texts without repeats, compared stripped, in order."""
    stripped = F.transform(outputs, texts.strip)
    return let(stripped, lambda own: F.filter(outputs, lambda x, i: F.array_position(own, F.get(own, i)) == i + 1))


def beam_round(candidates: DataFrame, keys: list[str], order: list[str], width: Column, most_depth: int) -> DataFrame:
    """One step of a beam search over candidates(value, terminal, final_answer, depth): the best `width` of each tree, with `fate`.

    fate: `final` (a valid answer), `dropped` (another end, or too deep) or `current`, and `next_width`, less by one for each that isn't current.
    Of equal values the first made comes first."""
    names = [c for c in candidates.columns if c not in keys]
    entry = F.struct((-F.col("value")).alias("_v"), *order, F.struct(*names).alias("_c"))
    got = candidates.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["_c"]).alias("_all"), F.first(width).alias("_width"))
    fate = lambda c: F.when(c["terminal"] & valid_final(c["final_answer"]), "final").when(c["terminal"] | (c["depth"] > most_depth), "dropped").otherwise("current")
    top = got.withColumn("_top", F.transform(F.slice("_all", F.lit(1), F.greatest(F.col("_width"), F.lit(0))), lambda c: c.withField("fate", fate(c))))
    left = F.col("_width") - F.size(F.filter("_top", lambda c: c["fate"] != "current"))
    return top.withColumn("next_width", left).select(*keys, "next_width", F.inline("_top"))


def solutions(finals: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Final answers of each tree, best first (`rank` from 1), ties in the order they were found."""
    names = [c for c in finals.columns if c not in keys]
    entry = F.struct((-F.col(value)).alias("_v"), *order, F.struct(*names).alias("_c"))
    got = finals.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    return got.select(*keys, F.inline(F.transform("_all", lambda e, i: e["_c"].withField("rank", (i + 1).cast("bigint")))))
