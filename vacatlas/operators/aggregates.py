"""Market statistics.

Each takes processed postings, or a table of facts counted before, and names the
facts it reads; see ``facts``. Rows with the same count are ordered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..dictionaries import INTERNATIONAL_REGIONS, OTHER_REGION
from ..functions import text as X
from ..functions.quantiles import quantiles
from . import sketches
from .facts import facts

MEDIAN = {"median": 0.5}
YEAR_BINS = 20


def _sum_if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("bigint"))


def _is(fact: str) -> Column:
    return F.col("fact") == fact


def _mean_if(test: Column) -> Column:
    known = test & F.col("x").isNotNull()
    return F.try_divide(F.sum(F.when(known, F.col("x") * F.col("n"))), F.sum(F.when(known, F.col("n"))))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row tables side by side, without joining them."""
    return _merged([], *parts)


def _merged(keys: list[str], *parts: DataFrame) -> DataFrame:
    """Columns of several tables with one row per key side by side."""
    names = [c for part in parts for c in part.columns if c not in keys]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union.groupBy(*keys).agg(*(F.max(name).alias(name) for name in names))


def _values(df: DataFrame, fact: str) -> DataFrame:
    """Value counts (x, n) of a fact over all keys."""
    return facts(df, fact).where(F.col("x").isNotNull()).groupBy("x").agg(F.sum("n").alias("n"))


def _not_other() -> Column:
    return ~F.col("key").eqNullSafe(F.lit(OTHER_REGION))


def key_counts(df: DataFrame, fact: str, name: str) -> DataFrame:
    """Postings per key of a fact, without the null key: (name, n)."""
    return (
        facts(df, fact).where(F.col("key").isNotNull())
        .groupBy(F.col("key").alias(name)).agg(F.sum("n").alias("n"))
    )


def top(df: DataFrame, name: str, k: int, count: str = "n") -> DataFrame:
    """The k largest counts; ties by key."""
    return df.orderBy(F.desc(count), F.asc(name)).limit(k)


# -- headline numbers -------------------------------------------------------

def kpis(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row: postings, distinct companies, regions and categories, median salary and years.

    Not ``exact``: from sketches, of postings or stored ones; see ``sketches`` for their errors.
    """
    if not exact:
        return sketches.kpis(df)
    table = facts(df, "company", "category", "salary_region", "years_region")
    counts = table.where(F.col("fact").isin("company", "category")).agg(
        _sum_if(_is("company")).alias("postings"),
        F.countDistinct(F.when(_is("company"), F.col("item"))).alias("companies"),
        F.countDistinct(F.when(_is("company"), F.col("key"))).alias("regions"),
        F.countDistinct(F.when(_is("category"), F.col("key"))).alias("categories"),
    )
    values = (
        table.where(F.col("fact").isin("salary_region", "years_region") & F.col("x").isNotNull())
        .groupBy("fact", "x").agg(F.sum("n").alias("n"))
    )
    medians = quantiles(values, ["fact"], "x", "n", MEDIAN).agg(
        F.max(F.when(_is("salary_region"), F.col("median"))).alias("median_salary"),
        F.max(F.when(_is("years_region"), F.col("median"))).alias("median_yoe"),
    )
    return _one_row(counts, medians)


# -- counts -----------------------------------------------------------------

def category_counts(df: DataFrame, n: int = 12) -> DataFrame:
    return top(key_counts(df, "category", "cluster_label"), "cluster_label", n)


def category_share(df: DataFrame) -> DataFrame:
    """Postings and share of all labelled postings per category."""
    counts = key_counts(df, "category", "cluster_label")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def top_companies(df: DataFrame, n: int = 15) -> DataFrame:
    counts = (
        facts(df, "company").where(F.col("item").isNotNull())
        .groupBy(F.col("item").alias("company")).agg(F.sum("n").alias("n"))
    )
    return top(counts, "company", n)


def state_counts(df: DataFrame) -> DataFrame:
    return key_counts(df, "state", "state")


def region_counts(df: DataFrame) -> DataFrame:
    """Postings per region, without "Other"."""
    return key_counts(facts(df, "company").where(_not_other()), "company", "region")


# -- regions ----------------------------------------------------------------

def region_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per region, "Other" included: postings, distinct companies, median salary and years; or from sketches."""
    if not exact:
        return sketches.region_stats(df)
    table = facts(df, "company", "salary_region", "years_region").where(F.col("key").isNotNull())
    counts = table.where(_is("company")).groupBy("key").agg(
        F.sum("n").alias("jobs"), F.count("item").alias("companies")
    )
    values = table.where(F.col("fact").isin("salary_region", "years_region"))
    medians = quantiles(values, ["fact", "key"], "x", "n", MEDIAN).groupBy("key").agg(
        F.max(F.when(_is("salary_region"), F.col("median"))).alias("median_salary"),
        F.max(F.when(_is("years_region"), F.col("median"))).alias("median_yoe"),
    )
    return _merged(["key"], counts, medians).withColumnRenamed("key", "region").orderBy(F.desc("jobs"), "region")


def region_report(df: DataFrame, n: int = 10) -> DataFrame:
    """Per region without "Other": postings, mean salary and years; the n largest."""
    table = facts(df, "company", "salary_region", "years_region")
    means = table.where(_not_other() & F.col("key").isNotNull()).groupBy(F.col("key").alias("region")).agg(
        _sum_if(_is("company")).alias("jobs"),
        _mean_if(_is("salary_region")).alias("avg_salary"),
        _mean_if(_is("years_region")).alias("avg_yoe"),
    )
    return top(means, "region", n, "jobs")


def geo_trends(df: DataFrame) -> DataFrame:
    """The region with the most postings, without "Other", and the number of international ones."""
    counts = region_counts(df)
    abroad = counts.agg(
        F.coalesce(F.sum(F.when(F.col("region").isin(*INTERNATIONAL_REGIONS), F.col("n"))), F.lit(0).cast("bigint"))
        .alias("international")
    )
    leader = top(counts, "region", 1).select(F.col("region").alias("top_region"), F.col("n").alias("top_count"))
    return _one_row(leader, abroad)


# -- categories -------------------------------------------------------------

def cluster_summary(df: DataFrame, regions: int = 3) -> DataFrame:
    """Per category: postings, percent of all, mean salaries and years, its largest regions."""
    table = facts(df, "category", "floor_category", "salary_category", "years_category")
    stats = table.groupBy(F.col("key").alias("cluster")).agg(
        _sum_if(_is("category")).alias("count"),
        _mean_if(_is("floor_category")).alias("avg_salary_min"),
        _mean_if(_is("salary_category")).alias("avg_salary_max"),
        _mean_if(_is("years_category")).alias("avg_yoe"),
    )
    stats = stats.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(W.partitionBy()))
    by_count = W.partitionBy("key").orderBy(F.desc("n"), F.asc("item"))
    leading = (
        table.where(_is("category") & F.col("item").isNotNull())
        .withColumn("rank", F.row_number().over(by_count))
        .where(F.col("rank") <= regions)
        .groupBy(F.col("key").alias("cluster"))
        .agg(
            F.sort_array(
                F.collect_list(F.struct("rank", F.format_string("%s (%d)", "item", "n").alias("shown")))
            ).alias("ranked")
        )
        .select("cluster", F.array_join("ranked.shown", ", ").alias("top_regions"))
    )
    return (
        _merged(["cluster"], stats, leading)
        .where(F.col("cluster").isNotNull())
        .select("cluster", "count", "pct", "avg_salary_min", "avg_salary_max", "avg_yoe", "top_regions")
        .orderBy(F.desc("count"), "cluster")
    )


def category_trends(df: DataFrame, niche: int = 3) -> DataFrame:
    """The largest category ("hot"), and the smallest ones ("niche") if there are more than these."""
    counts = facts(df, "category").groupBy(F.col("key").alias("cluster_label")).agg(F.sum("n").alias("n"))
    every = W.partitionBy()
    named = (
        counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(every))
        .where(F.col("cluster_label").isNotNull())
        .withColumn("position", F.row_number().over(W.orderBy(F.desc("n"), F.asc("cluster_label"))))
        .withColumn("categories", F.count("*").over(every))
    )
    is_niche = (F.col("categories") > niche) & (F.col("position") > F.col("categories") - niche)
    kinds = F.array(
        F.when(F.col("position") == 1, F.lit("hot")), F.when(is_niche, F.lit("niche"))
    )
    return (
        named.withColumn("kind", F.explode(kinds)).where(F.col("kind").isNotNull())
        .select("kind", "position", "cluster_label", "n", "pct")
    )


def crosstab_wide(df: DataFrame, labels: list[str] | None = None, with_other: bool = False) -> DataFrame:
    """Regions by categories, a column per category, zeros filled in.

    Without ``labels`` the categories are looked up first.
    """
    table = _region_category(df, with_other)
    pivot = table.groupBy("region").pivot("cluster_label", labels).agg(F.sum("n"))
    return pivot.na.fill(0)


def crosstab_long(df: DataFrame, labels: list[str] | None = None, with_other: bool = True) -> DataFrame:
    """The same as rows: (region, cluster_label, n), zeros included."""
    wide = crosstab_wide(df, labels, with_other)
    cells = [F.col(f"`{c}`") for c in wide.columns if c != "region"]
    return wide.unpivot(["region"], cells, "cluster_label", "n")


def _region_category(df: DataFrame, with_other: bool) -> DataFrame:
    table = facts(df, "category").where(F.col("key").isNotNull() & F.col("item").isNotNull())
    if not with_other:
        table = table.where(F.col("item") != OTHER_REGION)
    return table.select(F.col("item").alias("region"), F.col("key").alias("cluster_label"), "n")


# -- salaries ---------------------------------------------------------------

def salary_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Quartiles and mean of the salaries; the quartiles from sketches if not ``exact``."""
    if not exact:
        return sketches.salary_stats(df)
    values = _values(df, "salary_region")
    points = quantiles(values, [], "x", "n", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    mean = values.agg(F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("mean"))
    return _one_row(points, mean)


def salary_benchmarks(df: DataFrame) -> DataFrame:
    return quantiles(_values(df, "salary_region"), [], "x", "n", {"median": 0.5, "p75": 0.75, "p90": 0.9})


def median_salary_rank(df: DataFrame, by: str = "cluster_label") -> DataFrame:
    """Median salary per category, or per region without "Other", highest first."""
    fact = {"cluster_label": "salary_category", "region": "salary_region"}[by]
    values = facts(df, fact).where(F.col("key").isNotNull())
    if by == "region":
        values = values.where(_not_other())
    medians = quantiles(values, ["key"], "x", "n", {"median_salary": 0.5})
    return medians.withColumnRenamed("key", by).orderBy(F.desc("median_salary"), by)


def box_stats(
    df: DataFrame, fact: str, with_other: bool = True, min_rows: int = 5, min_group: int = 3
) -> DataFrame:
    """Box plot numbers per key of a fact: quartiles, whiskers within 1.5 IQR, extremes, outliers.

    Only keys with enough values, and none if there are too few values in all.
    """
    table = facts(df, fact).where(F.col("key").isNotNull() & F.col("x").isNotNull())
    if not with_other:
        table = table.where(_not_other())
    boxes = quantiles(table, ["key"], "x", "n", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    stats = (
        table.select("key", "x", "n").join(boxes, "key").groupBy("key", "q1", "median", "q3")
        .agg(
            F.sum("n").alias("rows"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0).cast("bigint")).alias("outliers"),
        )
        .withColumn("_all", F.sum("rows").over(W.partitionBy()))
    )
    return stats.where((F.col("rows") >= min_group) & (F.col("_all") >= min_rows)).drop("_all")


def histogram(df: DataFrame, fact: str = "salary_region", bins: int = 30) -> DataFrame:
    """Equal-width bins from the least to the greatest value, empty ones included: (bin, low, high, n)."""
    values = _values(df, fact)
    span = values.agg(F.min("x").alias("low"), F.max("x").alias("high")).select(F.struct("low", "high")).scalar()
    empty = values.sparkSession.range(bins).select(
        F.lit(None).cast("double").alias("x"), F.lit(0).cast("bigint").alias("n"), F.col("id").alias("bin")
    )
    width = (F.col("span.high") - F.col("span.low")) / bins
    offset = F.coalesce(F.try_divide(F.col("x") - F.col("span.low"), width), F.lit(0.0))
    place = F.coalesce("bin", F.least(F.floor(offset), F.lit(bins - 1).cast("bigint")))
    return (
        values.withColumn("bin", F.lit(None).cast("bigint")).unionByName(empty)
        .withColumn("span", span)
        .where(F.col("span.low").isNotNull())
        .groupBy(place.alias("bin"), "span").agg(F.sum("n").alias("n"))
        .select(
            "bin",
            (F.col("span.low") + F.col("bin") * width).alias("low"),
            (F.col("span.low") + (F.col("bin") + 1) * width).alias("high"),
            "n",
        )
    )


def readable_histogram(df: DataFrame, fact: str = "salary_region", bins: int = 30) -> DataFrame:
    """Bins whose edges are multiples of a step of 1, 2 or 5 times a power of ten: (bin, low, high, n).

    The step is the least that needs at most ``bins`` bins from the one of the least value to that of the greatest, empty
    ones included; equal values are one bin of width 1. All follows from the value counts.
    """
    values = _values(df, fact)
    low, high = F.col("low"), F.col("high")
    power = F.pow(F.lit(10.0), F.floor(F.log10((high - low) / bins)))
    tried = F.array(*(power * step for step in (1.0, 2.0, 5.0, 10.0, 20.0)))
    fits = F.filter(tried, lambda step: F.floor(high / step) - F.floor(low / step) < bins)
    step = F.when(high > low, F.get(fits, F.lit(0))).otherwise(F.lit(1.0))
    span = (
        values.agg(F.min("x").alias("low"), F.max("x").alias("high"))
        .select(step.alias("step"), F.floor(low / step).alias("first"), F.floor(high / step).alias("last"))
        .select(F.struct("step", "first", "last")).scalar()
    )
    empty = values.sparkSession.range(bins).select(
        F.lit(None).cast("double").alias("x"), F.lit(0).cast("bigint").alias("n"), F.col("id").alias("bin")
    )
    place = F.coalesce("bin", F.floor(F.col("x") / F.col("span.step")) - F.col("span.first"))
    return (
        values.withColumn("bin", F.lit(None).cast("bigint")).unionByName(empty)
        .withColumn("span", span)
        .where(F.col("span.first").isNotNull())
        .groupBy(place.alias("bin"), "span").agg(F.sum("n").alias("n"))
        .where(F.col("bin") <= F.col("span.last") - F.col("span.first"))
        .select(
            "bin",
            ((F.col("span.first") + F.col("bin")) * F.col("span.step")).alias("low"),
            ((F.col("span.first") + F.col("bin") + 1) * F.col("span.step")).alias("high"),
            "n",
        )
    )


# -- experience -------------------------------------------------------------

def yoe_histogram(df: DataFrame) -> DataFrame:
    """Unit bins 0 to 20 of the clipped years, empty ones included, and the median of these."""
    clipped = (
        _values(df, "years_region").withColumn("x", X.clip(F.col("x"), 0.0, float(YEAR_BINS)))
        .groupBy("x").agg(F.sum("n").alias("n"))
    )
    median = quantiles(clipped, [], "x", "n", MEDIAN).scalar()
    empty = clipped.sparkSession.range(YEAR_BINS + 1).select(
        F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("n")
    )
    counted = clipped.select(F.floor("x").alias("bin"), "n")
    return counted.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("n")).withColumn("median", median)


def yoe_kpis(df: DataFrame) -> DataFrame:
    """Median, most common (least when tied) and percent asking for at most two years."""
    values = _values(df, "years_region")
    rest = values.agg(
        F.max_by("x", F.struct("n", -F.col("x"))).alias("mode"),
        (F.try_divide(_sum_if(F.col("x") <= 2), F.sum("n")) * 100).alias("entry_pct"),
    )
    return _one_row(quantiles(values, [], "x", "n", MEDIAN), rest)


def yoe_bands(df: DataFrame) -> DataFrame:
    """Postings asking for at most 2, over 2 to 5, and over 5 years; percent of the first; median."""
    values = _values(df, "years_region")
    bands = values.agg(
        _sum_if(F.col("x") <= 2).alias("entry"),
        _sum_if((F.col("x") > 2) & (F.col("x") <= 5)).alias("mid"),
        _sum_if(F.col("x") > 5).alias("senior"),
        (F.try_divide(_sum_if(F.col("x") <= 2), F.sum("n")) * 100).alias("entry_pct"),
    )
    return _one_row(bands, quantiles(values, [], "x", "n", MEDIAN))


# -- skills -----------------------------------------------------------------

def skill_frequency(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Postings per (category, skill)."""
    table = facts(df, "skill")
    if categories is not None:
        table = table.where(F.col("key").isin(*categories))
    return table.select(F.col("key").alias("category"), F.col("item").alias("skill"), "n")


def top_skills_by_category(df: DataFrame, n: int = 10) -> DataFrame:
    order = W.partitionBy("category").orderBy(F.desc("n"), F.asc("skill"))
    return (
        skill_frequency(df).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    )


def top_skills(df: DataFrame, n: int = 20) -> DataFrame:
    """Skills of all categories by the number of postings."""
    totals = skill_frequency(df).groupBy("skill").agg(F.sum("n").alias("n"))
    return top(totals, "skill", n)


# -- places -----------------------------------------------------------------

def _located(df: DataFrame) -> DataFrame:
    return facts(df, "place").where(F.col("x").isNotNull() & F.col("y").isNotNull())


def city_density(df: DataFrame) -> DataFrame:
    """Postings per point."""
    return (
        _located(df).groupBy(F.col("x").alias("latitude"), F.col("y").alias("longitude"))
        .agg(F.sum("n").alias("n"))
    )


def map_centre(df: DataFrame) -> DataFrame:
    """Mean coordinates of the located postings."""
    return _located(df).agg(
        F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("latitude"),
        F.try_divide(F.sum(F.col("y") * F.col("n")), F.sum("n")).alias("longitude"),
    )


def cluster_density(df: DataFrame, min_located: int = 2) -> DataFrame:
    """Postings per category and point, for categories with enough located postings."""
    points = _located(df).where(F.col("key").isNotNull())
    return (
        points.withColumn("_located", F.sum("n").over(W.partitionBy("key")))
        .where(F.col("_located") >= min_located)
        .select(
            F.col("key").alias("cluster_label"), X.slug(F.col("key")).alias("name"),
            F.col("x").alias("latitude"), F.col("y").alias("longitude"), "n",
        )
    )
