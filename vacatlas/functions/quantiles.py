"""Exact quantiles of value counts, without a group ever being held in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Value buckets per e-fold; with doubles this bounds a group to 1.5 million buckets.
BUCKETS_PER_FOLD = 1024


def value_bucket(value: Column) -> Column:
    """A coarse bucket that never decreases as the value grows."""
    bucket = F.signum(value) * F.floor(F.log1p(F.abs(value)) * BUCKETS_PER_FOLD)
    return F.coalesce(bucket.cast("bigint"), F.lit(0).cast("bigint"))


def quantiles(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group: the keys and a column per probability.

    ``counts`` has distinct (keys, value) with their counts; keys are not null.
    The values of a group may be too many for one task, so a first pass counts
    buckets of values, whose number is bounded, and finds the buckets the asked
    ranks fall into; only inside these are the values ordered.
    """
    keys = list(keys)
    known = F.col(value).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    # Both uses of `valued` must stay the same plan, or the counts behind them
    # are computed twice: hence the explicit null tests and the non-null bucket.
    valued = (
        counts.where(known)
        .select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    group = W.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)

    def rank(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def holds(r: Column) -> Column:
        return (r >= F.col("_from")) & (r < F.col("_to"))

    ranks = [edge(rank(p)) for p in probabilities.values() for edge in (F.floor, F.ceil)]
    hit = holds(ranks[0])
    for r in ranks[1:]:
        hit = hit | holds(r)
    buckets = (
        valued.groupBy(*keys, "_b").agg(F.sum("_w").alias("_n"))
        .withColumns({"_to": F.sum("_n").over(before), "_total": F.sum("_n").over(group)})
        .withColumn("_from", F.col("_to") - F.col("_n"))
        .where(hit)
        .select(*keys, "_b", F.col("_from").alias("_base"), "_total")
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = (
        valued.join(buckets, [*keys, "_b"])
        .withColumn("_to", F.col("_base") + F.sum("_w").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_w"))
    )

    def at(p: float, edge) -> Column:
        return F.max(F.when(holds(edge(rank(p))), F.col("_v")))

    bounds = []
    for name, p in probabilities.items():
        bounds += [at(p, F.floor).alias(f"_low_{name}"), at(p, F.ceil).alias(f"_high_{name}")]
    picked = ordered.groupBy(*keys).agg(F.max("_total").alias("_total"), *bounds)

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return (low + (high - low) * (rank(p) - F.floor(rank(p)))).alias(name)

    return picked.where(F.col("_total") > 0).select(*keys, *(between(n, p) for n, p in probabilities.items()))
