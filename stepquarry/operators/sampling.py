"""Reproducible samples: order by md5(seed:id) in place of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades
from ..scratch import stored
from .dedupe import _free as free_name
from .dedupe import top_k
from .selection import first_of_each, first_rows, small, turns

def seeded(seed: int, key: str) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)]


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(*seeded(seed, key))


def stratified_take(df: DataFrame, stratum: str, k: int, seed: int, key: str) -> DataFrame:
    return top_k(df, [stratum], seeded(seed, key), k)


def short_strata(df: DataFrame, stratum: str, k: int, strata: list[int]) -> DataFrame:
    """(stratum, n) of the wanted strata that have fewer than k rows: what a strict sample fails on."""
    wanted = df.sparkSession.createDataFrame([(s,) for s in strata], f"{stratum} int")
    return wanted.join(df.groupBy(stratum).agg(F.count("*").alias("n")), stratum, "left").select(stratum, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)


def two_phase(df: DataFrame, rough: str, final: str, k: int, factor: float, seed: int, key: str) -> DataFrame:
    """Oversample by the rough grade, then take k of each final grade; numbered from 0 by (final, hash)."""
    more = max(k, int(k * max(1.0, factor)))
    kept = stratified_take(stratified_take(df, rough, more, seed, key), final, k, seed, key)
    return kept.withColumn("new_index", (F.row_number().over(Window.orderBy(final, *seeded(seed, key))) - 1).cast("long"))  # k rows a grade


def take(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The first n rows by hash, with no task that has them all."""
    return first_rows(df, n, seeded(seed, key))


def replay(df: DataFrame, ratio: float, new_items: int, seed: int, key: str) -> DataFrame:
    """round(ratio * new_items) rows, half to even; all of them for a negative ratio, or where there are no more."""
    return df if ratio < 0 else take(df, int(round(ratio * new_items)), seed, key)


def pair_preserving(df: DataFrame, pair: str, n: int, seed: int) -> DataFrame:
    """Both rows of n pairs."""
    return df.join(small(take(df.select(pair).distinct(), n, seed, pair)), pair, "left_semi")


def policy_and_value(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items that train the policy, and the others."""
    on = F.coalesce("train_lm", F.lit(False))
    return items.where(on), items.where(~on)


def delta_group(dataset: Column | None, delta: Column | None) -> Column:
    """The group by which items are balanced: the record, how far the grade is off, both, or none."""
    name = F.coalesce(F.when(dataset.cast("string") != "", dataset.cast("string")), F.lit("__missing_dataset__")) if dataset is not None else None
    parts = [x for x in (name, grades.delta_bucket(delta) if delta is not None else None) if x is not None]
    return F.concat_ws("\t", *parts) if parts else F.lit("__all__")


def round_robin(df: DataFrame, group: str, target: int, seed: int, key: str) -> DataFrame:
    """target rows, one from each group in turn, with `turn`; in no order."""
    sizes = stored(df.groupBy(group).agg(F.count("*").alias("n")), "sizes")
    return first_of_each(df, [group], seeded(seed, key), turns(sizes, group, target), rank="turn")


def balanced(df: DataFrame, group: str, target: int, seed: int, key: str, tag: str, suffix: str) -> DataFrame:
    """target rows, in turn from each group; where there are too few, repeats follow under tags of their own.

    The j-th repeat is row j mod size of group j mod groups. A negative target gives all rows; no rows give none."""
    rows = df.withColumn("repeat", F.lit(None).cast("long"))
    if target < 0:
        return rows
    taken = round_robin(df, group, target, seed, key).drop("turn").withColumn("repeat", F.lit(None).cast("long"))
    n = taken.count()
    if not 0 < n < target:
        return taken
    j = free_name(df, "_j")
    more = repeat_to(df, group, target - n, seed, key, target, j)
    old = F.coalesce(F.col(tag), F.concat(F.lit(f"{suffix}_"), F.col(j).cast("string")))
    renamed = more.withColumn(tag, F.concat(old, F.lit(f"#rebalance{suffix}"), F.col(j).cast("string"))).withColumn("repeat", F.col(j))
    return taken.unionByName(renamed.select(*taken.columns))


def repeat_to(df: DataFrame, group: str, target: int, seed: int, key: str, per_group: int, j: str = "j") -> DataFrame:
    """target rows: the j-th repeat (numbered in column j) is element j mod size of group j mod groups. Groups are cut to per_group rows first."""
    at, size, number, groups = (free_name(df, x) for x in ("_at", "_size", "_number", "_groups"))
    ranked = top_k(df, [group], seeded(seed, key), per_group, rank=at)
    sizes = ranked.groupBy(group).agg(F.count("*").alias(size)).orderBy(group).limit(target)  # the j-th repeat needs no later group
    many = ranked.select(group).distinct().agg(F.count("*").alias(groups))
    numbered = sizes.withColumn(number, F.row_number().over(Window.orderBy(group)) - 1)  # target rows at most
    repeats = df.sparkSession.range(target).withColumnRenamed("id", j).crossJoin(F.broadcast(many))  # one row
    picked = repeats.withColumn(number, F.col(j) % F.col(groups)).join(small(numbered), number).withColumn(at, F.col(j) % F.col(size) + 1)
    return picked.join(ranked, [group, at]).select(j, *df.columns)


def adjusted(df: DataFrame, group: str, total: int, seed: int, key: str, tag: str) -> DataFrame:
    """Exactly `total` rows: a sample of more, a balanced expansion of fewer; a negative total or no rows change nothing."""
    n = df.count() if total >= 0 else -1
    if n > total >= 0:
        return take(df, total, seed, key)
    if 0 < n < total:
        return balanced(df.drop("repeat"), group, total, seed, key, tag, "total")
    return df


def targets(counts: DataFrame, variant: str) -> DataFrame:
    """counts(name, policy, value) of two sets (of the baseline, for `baseline`) -> (name, target_policy, target_value, target_total).

    `own_values`: the least policy count, each set's own values; `least`: the least of both; `baseline`: the counts as they are."""
    whole = counts.agg(F.min("policy").alias("p"), F.min("value").alias("v"))
    x = counts.crossJoin(F.broadcast(whole))  # one row
    policy = F.col("policy") if variant == "baseline" else F.col("p")
    value = F.col("v") if variant == "least" else F.col("value")
    return x.select("name", policy.alias("target_policy"), value.alias("target_value"), (policy + value).alias("target_total"))
