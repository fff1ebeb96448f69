"""Statistics of very large tables from mergeable sketches.

Exact medians and distinct counts need every distinct value. A sketch has a bounded size and two of them merge into that
of both inputs, so a snapshot is scanned once, its sketches are stored beside it, and statistics over any set of
snapshots merge these rows alone. Counts, sums and means stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.snapshots import read_latest, run_dates, write_snapshot

#: Size of a quantile sketch, and the part of the rows that a quantile's rank is off by at most, with 99 % confidence.
QUANTILE_SIZE, RANK_ERROR = 1024, 0.004
#: Binary logarithm of a distinct sketch's size, and the relative error of its estimate, with 99 % confidence.
DISTINCT_SIZE, DISTINCT_ERROR = 14, 0.02
#: Stage that stored sketches are a snapshot of.
STAGE = "market_sketches"

_DISTINCT = {"companies": "company", "categories": "cluster_label"}
_NUMBERS = {"salaries": "salary_max_annual", "years": "yoe_min"}
COLUMNS = ["region", "postings", *_DISTINCT, *_NUMBERS, "salary_sum", "salary_n"]


def is_sketched(df: DataFrame) -> bool:
    return set(COLUMNS) <= set(df.columns)


def market_sketches(
    df: DataFrame, *by: str, quantile_size: int = QUANTILE_SIZE, distinct_size: int = DISTINCT_SIZE
) -> DataFrame:
    """One row of counts and sketches per region, and per further columns ``by``: one pass, partial in the map tasks.

    Absent columns count as null. A table of sketches is taken as it is.
    """
    if is_sketched(df):
        return df

    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    salary = column("salary_max_annual", "double")
    return df.groupBy(column("region", "string").alias("region"), *by).agg(
        F.count("*").alias("postings"),
        *(F.hll_sketch_agg(column(c, "string"), F.lit(distinct_size)).alias(n) for n, c in _DISTINCT.items()),
        *(F.kll_sketch_agg_double(column(c, "double"), F.lit(quantile_size)).alias(n) for n, c in _NUMBERS.items()),
        F.sum(salary).alias("salary_sum"), F.count(salary).alias("salary_n"),
    )


def merged(df: DataFrame, *by: str) -> DataFrame:
    """The sketches of all rows with equal ``by`` as one row; of all rows without any."""
    return market_sketches(df).groupBy(*by).agg(
        F.coalesce(F.sum("postings"), F.lit(0)).cast("bigint").alias("postings"),
        *(F.hll_union_agg(n).alias(n) for n in _DISTINCT),
        *(F.kll_merge_agg_double(n).alias(n) for n in _NUMBERS),
        F.sum("salary_sum").alias("salary_sum"), F.coalesce(F.sum("salary_n"), F.lit(0)).cast("bigint").alias("salary_n"),
        F.countDistinct("region").alias("regions"),
    )


def quantile(sketch: str, p: float) -> Column:
    """The least value with a rank of at least p, within the sketch's rank error; null without values."""
    some = F.col(sketch).isNotNull() & (F.kll_sketch_get_n_double(sketch) > 0)
    return F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(sketch)), F.lit(p)))


def distinct(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def kpis(df: DataFrame) -> DataFrame:
    return merged(df).select(
        "postings", distinct("companies").alias("companies"), "regions", distinct("categories").alias("categories"),
        quantile("salaries", 0.5).alias("median_salary"), quantile("years", 0.5).alias("median_yoe"),
    )


def region_stats(df: DataFrame) -> DataFrame:
    return merged(df, "region").where(F.col("region").isNotNull()).select(
        "region", F.col("postings").alias("jobs"), distinct("companies").alias("companies"),
        quantile("salaries", 0.5).alias("median_salary"), quantile("years", 0.5).alias("median_yoe"),
    ).orderBy(F.desc("jobs"), "region")


def salary_stats(df: DataFrame) -> DataFrame:
    return merged(df).select(
        *(quantile("salaries", p).alias(n) for n, p in {"p25": 0.25, "median": 0.5, "p75": 0.75}.items()),
        F.try_divide("salary_sum", "salary_n").alias("mean"),
    )


def write_sketches(df: DataFrame, root: str, run_date: str) -> None:
    """Store the sketches of a snapshot of processed postings under its date."""
    write_snapshot(market_sketches(df), root, STAGE, run_date)


def read_sketches(spark: SparkSession, root: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The stored sketches of all snapshots, or of those from ``since`` to ``until``; no snapshot itself is read."""
    dates = [d for d in run_dates(spark, root, STAGE) if (since or d) <= d <= (until or d)]
    if not dates:
        raise FileNotFoundError(f"no sketches of these dates in {root}")
    parts = [read_latest(spark, root, STAGE, d) for d in dates]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
