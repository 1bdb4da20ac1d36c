"""First-wins and best-first dedupe, caps and top-k. Order is always given: partitions' order never decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts, udfs


def _free(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each group (Spark cuts groups to k before the shuffle)."""
    name = rank or _free(df, "_rank")
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_k(df, keys, order)


def distinct_in_order(df: DataFrame, value: str, order: Sequence[Column | str]) -> DataFrame:
    """Each value once, where it came first."""
    return first_wins(df, [value], order).orderBy(*order)


def without_used(df: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among used; null equals null."""
    names = {k: _free(df, f"_{k}") for k in keys}
    renamed = used.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct()
    match = F.lit(True)
    for k, n in names.items():
        match = match & F.col(k).eqNullSafe(F.col(n))
    return df.join(renamed, match, "left_anti")


def usage_keys(rows: DataFrame, source: str = "source", index: str = "dataset_index") -> DataFrame:
    """`source:index` of rows that have both: what training data has used."""
    good = (F.coalesce(F.col(source), F.lit("")) != "") & F.col(index).isNotNull()
    return rows.where(good).select(F.concat_ws(":", source, F.col(index).cast("string")).alias("used")).distinct()


def pending(requested: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Requested ids that aren't completed, numbers before other ids, each once."""
    ids = requested.select(F.col(key).cast("string").alias("id")).distinct()
    left = ids.join(completed.select(F.col(key).cast("string").alias("id")), "id", "left_anti")
    return left.orderBy(*numeric_first("id"))


def numeric_first(key: str) -> list[Column]:
    """Order of ids: numbers by value, then the others as text."""
    n = F.col(key).try_cast("long")
    return [n.isNull(), n, F.col(key)]


def repairs(requested: DataFrame, completed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stored records of requested ids that the output lacks: what a resumed run appends before it goes on."""
    name = _free(stored, "_wanted")
    done = completed.select(F.col(key).cast("string").alias(name))
    want = requested.select(F.col(key).cast("string").alias(name)).distinct().join(done, name, "left_anti")
    return stored.join(want, F.col(key).cast("string") == F.col(name), "left_semi").orderBy(*numeric_first(key))


# what a search may add under a node ---------------------------------------------------------------------------------------------------
def sibling_reviews(reviews: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """Reviews under one parent without those that mean the same as an earlier one; a review without a grade always stays."""
    name = _free(reviews, "_signature")
    x = reviews.withColumn(name, texts.review_signature(F.col(text)))
    first = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order)) == 1
    mark = _free(reviews, "_first")
    return x.withColumn(mark, first | F.col(name).isNull()).where(mark).drop(name, mark)


def fresh_steps(nodes: DataFrame, keys: Sequence[str], parent: str, steps: str, parent_bound: float = udfs.NEAR, sibling_bound: float = udfs.NEAR, least: int = udfs.LEAST_WORDS) -> DataFrame:
    """nodes(*keys, parent, steps array) -> a row for each step with `at`, its place, and `fresh`: not a near duplicate of the parent's step
    or of an earlier sibling that stayed. Steps of under `least` words are always fresh; a bound of 1 doesn't compare."""
    flags = udfs.fresh(texts.similarity_key(F.col(parent)), F.transform(steps, texts.similarity_key), F.lit(float(parent_bound)), F.lit(float(sibling_bound)), F.lit(least))
    return nodes.select(*keys, F.posexplode(F.arrays_zip(F.col(steps).alias("step"), flags.alias("fresh"))).alias("at", "x")).select(*keys, "at", "x.step", "x.fresh")
