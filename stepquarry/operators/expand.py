"""Row expanders: pairs, and the trees that linear rollouts stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import half_even


def pair_rows(df: DataFrame, pair: str, pos: str, neg: str) -> DataFrame:
    sides = F.array(F.struct(F.lit("pos").alias("pair_role"), F.col(pos).alias("response")), F.struct(F.lit("neg").alias("pair_role"), F.col(neg).alias("response")))
    return df.select(F.col(pair).alias("pair_id"), F.inline(sides)).where("response is not null")


def flat_tree(df: DataFrame, record: str, order: str, candidate: str) -> DataFrame:
    """Candidates as children c0, c1, ... of one root, each with an equal prior."""
    packed = df.groupBy(record).agg(F.sort_array(F.collect_list(F.struct(order, candidate))).alias("cs"))
    flat = packed.select(record, F.size("cs").alias("n"), F.posexplode("cs").alias("i", "c"))
    return flat.select(record, F.concat(F.lit("c"), F.col("i").cast("string")).alias("tag"), F.col(f"c.{candidate}").alias(candidate), half_even(1.0 / F.greatest(F.col("n"), F.lit(1)), 6).alias("prior"))


def chain_nodes(segments: Column, index: Column, candidates: Column) -> Column:
    """The chain of a candidate's segments: c0, c0.0, c0.0.0, ...; the first has the candidate's share as prior, the last is terminal."""
    root = F.concat(F.lit("c"), index.cast("string"))

    def node(text: Column, i: Column) -> Column:
        prior = F.when(i == 0, half_even(1.0 / F.greatest(candidates, F.lit(1)), 6)).otherwise(1.0)
        return F.struct(F.concat(root, F.repeat(F.lit(".0"), i)).alias("tag"), text.alias("text"), prior.alias("prior"), (i == F.size(segments) - 1).alias("terminal"))

    return F.transform(segments, node)


def chain_tree(df: DataFrame, record: str, candidate: str, order: str, segment: str) -> DataFrame:
    """Segments of numbered candidates as chains; a row for each node."""
    packed = df.groupBy(record, candidate).agg(F.sort_array(F.collect_list(F.struct(order, segment))).alias("s"))
    many = packed.groupBy(record).agg(F.sort_array(F.collect_list(F.struct(F.col(candidate).alias("i"), F.transform("s", lambda x: x[segment]).alias("s")))).alias("cs"))
    nodes = F.flatten(F.transform("cs", lambda c, i: chain_nodes(c["s"], i, F.size("cs"))))
    return many.select(record, F.inline(nodes))
