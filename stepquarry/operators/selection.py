"""The first rows of each group by a hash, for any number of rows, without a global sort and without a task that has them all.

A group's rows are cut into buckets by their hash's leading bits, so many that a bucket has some BUCKET rows. The buckets' counts, added up in the
hash's order, tell which buckets lie wholly among the first rows, and which one the boundary runs through: only that one's rows are shuffled and sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .dedupe import _free as free_name

#: Rows of a bucket, some more as hashes fall, and how many rows are taken by a plain sort with a limit, which each task holds.
BUCKET, FEW = 1 << 16, 10_000
#: Sides of joins are broadcast only if they have no more rows than this; beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000
LEADING = 8


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its size allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _met(rows: DataFrame, table: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """rows joined with table, whose columns keys.values() equal rows' keys; null equals null."""
    match = F.lit(True)
    for own, other in keys.items():
        match = match & F.col(own).eqNullSafe(F.col(other))
    return rows.join(small(table), match, how).drop(*keys.values())


def first_of_each(df: DataFrame, by: Sequence[str], order: Sequence[Column], quota: int | DataFrame, rank: str | None = None) -> DataFrame:
    """The first `quota` rows of each group by order, whose first column is an md5 in hexadecimal digits; the others break its ties.

    quota is a number, or a table (*by, quota) with each group once; groups that it lacks give nothing. With `rank`, a column of that name
    numbers a group's rows from 1. Null groups are groups. Rows that equal each other in all of order may be taken in any order. df is read
    four times: give a stored table where it is costly."""
    named = df.withColumn(rank, F.lit(0)) if rank else df
    n, q, h, part, before, count, group = (free_name(named, x) for x in ("_n", "_quota", "_hash", "_part", "_before", "_count", "_group"))
    rows = df.withColumn(h, order[0]).withColumn(group, F.lit(0))
    by = [*by, group]
    as_ = {c: free_name(named, f"_{k}_{c}") for k, c in enumerate(by)}
    sizes = rows.groupBy(*by).agg(F.count("*").alias(n)).withColumnsRenamed(as_)
    if isinstance(quota, int):
        sizes = sizes.withColumn(q, F.lit(quota).cast("long"))
    else:
        own = {c: free_name(named, f"_own_{c}") for c in by[:-1]}
        given = quota.select(*[F.col(c).alias(own[c]) for c in by[:-1]], F.col("quota").cast("long").alias(q))
        sizes = _met(sizes, given, {as_[c]: own[c] for c in by[:-1]})
    rows = _met(rows, sizes.where(F.col(q) > 0), as_)
    parts = F.ceil(F.col(n) / BUCKET)
    rows = rows.withColumn(part, F.floor(F.conv(F.substring(h, 1, LEADING), 16, 10).cast("double") * parts / float(16**LEADING)))
    cut = rows if rank else rows.where(F.col(q) < F.col(n))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*by, part, q).agg(F.count("*").alias(count)).withColumn(before, F.coalesce(F.sum(count).over(earlier), F.lit(0)))
    there = {**as_, part: free_name(named, "_there")}
    starts = starts.where(F.col(before) < F.col(q)).select(*[F.col(c).alias(x) for c, x in there.items()], before, count)
    place = F.col(before) + F.row_number().over(Window.partitionBy(*by, part).orderBy(h, *order[1:]))
    work = [n, q, h, part, before, count, group]
    if rank:
        return _met(rows, starts, there).withColumn(rank, place).where(F.col(rank) <= F.col(q)).drop(*work)
    met = _met(cut, starts, there)
    inside = F.col(before) + F.col(count) <= F.col(q)
    border = met.where(~inside).withColumn(count, place).where(F.col(count) <= F.col(q))
    return rows.where(F.col(q) >= F.col(n)).drop(*work).unionByName(met.where(inside).drop(*work)).unionByName(border.drop(*work))


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows of df by order, as `first_of_each` has it; FEW by a limit."""
    return df.orderBy(*order).limit(n) if n <= FEW else first_of_each(df, [], order, n)


def turns(sizes: DataFrame, group: str, target: int) -> DataFrame:
    """sizes(group, n), stored -> (group, quota): what each group gives if groups give a row each in turn, in their order, until there are `target` rows.

    The last whole turn follows from how many groups have each size, of which there are no more than the root of twice the rows. Of the groups that have another
    row, the first ones in order give it: they are found by range partitions, of which the last is cut."""
    per_size = sizes.groupBy("n").agg(F.count("*").alias("groups"))
    up, down = Window.orderBy("n"), Window.orderBy(F.desc("n"))  # over sizes, not rows
    seen = per_size.select("n", F.lag("n", 1, 0).over(up).alias("below"), F.sum("groups").over(down).alias("having"), F.coalesce(F.sum(F.col("n") * F.col("groups")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ended"))
    full = F.col("ended") + F.col("below") * F.col("having")  # rows after `below` turns
    met = seen.where(full + (F.col("n") - F.col("below")) * F.col("having") >= target).orderBy("n").select("below", "having", full.alias("full")).limit(1).first()
    if met is None:
        return sizes.select(group, F.col("n").alias("quota"))
    more, rest = divmod(target - met["full"], met["having"])
    whole = met["below"] + more
    quota = sizes.select(group, F.least("n", F.lit(whole)).alias("quota"))
    if not rest:
        return quota.where("quota > 0")
    again = first_in_order(sizes.where(F.col("n") > whole).select(group), rest, [F.col(group)]).select(F.col(group).alias("_again"), F.lit(1).alias("_one"))
    return _met(quota, again, {group: "_again"}, "left").select(group, (F.col("quota") + F.coalesce("_one", F.lit(0))).alias("quota")).where("quota > 0")


def first_in_order(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows by any order: range partitions, counted; whole ones stay, the one at the boundary is sorted and cut."""
    if n <= FEW:
        return df.orderBy(*order).limit(n)
    rows, part, counts = _ranges(df, order)
    left = n
    for p, count in counts:
        if count >= left:
            return rows.where(F.col(part) < p).unionByName(rows.where(F.col(part) == p).orderBy(*order).limit(left)).drop(part)
        left -= count
    return rows.drop(part)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with its rows' places by an order, from 0: a window over each range partition, moved by how many rows come before it."""
    rows, part, counts = _ranges(df, order)
    before, total = [], 0
    for p, count in counts:
        before.append((p, total))
        total += count
    shift = rows.sparkSession.createDataFrame(before, f"{part} int, _shift long")  # a row for each partition
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1 + F.col("_shift")
    return rows.join(F.broadcast(shift), part).withColumn(name, place.cast("long")).drop(part, "_shift")


def _ranges(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, str, list[tuple[int, int]]]:
    """df in stored range partitions by order, the column of their numbers, and how many rows each has."""
    part = free_name(df, "_part")
    rows = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    return rows, part, sorted((r[part], r["count"]) for r in rows.groupBy(part).count().collect())
