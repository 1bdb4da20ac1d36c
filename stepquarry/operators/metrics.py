"""Summaries of predictions, lengths and value sequences. Aggregates are null over no rows; divisions are guarded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import half_even


def pearson(x: Column, y: Column) -> Column:
    """From sums, so that no spread gives 0 and fewer than two rows give null."""
    both = x.isNotNull() & y.isNotNull()
    n, a, b = F.count_if(both), F.when(both, x).cast("double"), F.when(both, y).cast("double")
    cov = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    var = (n * F.sum(a * a) - F.sum(a) * F.sum(a)) * (n * F.sum(b * b) - F.sum(b) * F.sum(b))
    return F.when(n >= 2, F.when(var <= 1e-9, 0.0).otherwise(F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(1e-300))))))


def summary(predicted: Column, reference: Column) -> list[Column]:
    valid = predicted.isNotNull()
    error = F.when(valid, F.abs(predicted - reference))
    return [
        F.count("*").alias("n"),
        F.count_if(valid).alias("n_valid"),
        (half_even(F.count_if(valid) / F.greatest(F.count("*"), F.lit(1)), 4) + 0.0).alias("valid_rate"),
        (half_even(F.avg(error), 4) + 0.0).alias("mae"),
        (half_even(F.median(error).cast("double"), 4) + 0.0).alias("median_error"),
        (half_even(F.avg(F.when(valid, ((predicted >= 3) == (reference >= 3)).cast("double"))), 4) + 0.0).alias("boundary_accuracy"),
        (half_even(pearson(predicted, reference), 4) + 0.0).alias("pearson"),
    ]


def length_quantiles(df: DataFrame, value: str, rounded: bool = False) -> DataFrame:
    """Minimum, whole median, quantiles at index floor(p (n - 1)) (rounded: at the nearest index) and maximum, from a histogram: no task
    holds all values."""
    hist = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    packed = hist.agg(F.sum("c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "c"))).alias("h"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
    value_at = lambda k: F.aggregate("h", start, lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.coalesce(s["v"], F.when(s["seen"] + x["c"] > k, x["v"].cast("long"))).alias("v")), lambda s: s["v"])
    n = F.col("n")
    at = lambda p: F.least(n - 1, F.bround(F.lit(p) * (n - 1)).cast("long")) if rounded else F.floor(F.lit(p) * (n - 1))
    median = F.floor((value_at(F.floor((n - 1) / 2)) + value_at(F.floor(n / 2))) / 2).cast("long")
    return packed.select(F.col("least").cast("long").alias("least"), median.alias("median"), *[value_at(at(p)).alias(f"p{round(100 * p)}") for p in (0.9, 0.95, 0.99)], F.col("most").cast("long").alias("most"))


def sequence_stats(values: Column) -> dict[str, Column]:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean, low = total / F.size(values), F.array_min(values)
    return {"last": F.element_at(values, -1), "mean": mean, "min": low, "mix": 0.7 * mean + 0.3 * low, "max": F.array_max(values)}
