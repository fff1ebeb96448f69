"""Filters of the explorer: null-passing, and no-ops on absent columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..dictionaries import INTERNATIONAL_REGIONS, OTHER_REGION
from ..functions import text as X

YEARS_DOMAIN = (0, 20)


def in_or_null(column: str, values: Sequence) -> Column:
    return F.col(column).isin(*values) | F.col(column).isNull()


def between_or_null(column: str, low, high) -> Column:
    return F.col(column).between(low, high) | F.col(column).isNull()


def filter_in(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose value is listed or null; an empty list keeps only the nulls."""
    if values is None or column not in df.columns:
        return df
    return df.where(in_or_null(column, values) if len(values) else F.col(column).isNull())


def filter_between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose value lies in [low, high] or is null."""
    return df.where(between_or_null(column, low, high)) if column in df.columns else df


def apply_filters(
    df: DataFrame,
    regions: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    salary_range: tuple[float, float] | None = None,
    yoe_range: tuple[float, float] | None = None,
) -> DataFrame:
    df = filter_in(df, "region", regions)
    df = filter_in(df, "cluster_label", categories)
    if salary_range is not None:
        df = filter_between(df, "salary_max_annual", *salary_range)
    if yoe_range is not None:
        df = filter_between(df, "yoe_min", *yoe_range)
    return df


def filter_domain(df: DataFrame) -> DataFrame:
    """What the filters can choose from, as one row.

    The salary bounds are usable only where they differ; years go from 0 to 20.
    The sets hold regions and categories, which come from dictionaries.
    """

    def choices(name: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.sort_array(F.collect_set(name)) if name in df.columns else F.first(empty)

    def bound(fn, name: str) -> Column:
        return fn(name) if name in df.columns else fn(F.lit(None).cast("double"))

    return df.agg(
        choices("region").alias("regions"),
        choices("cluster_label").alias("categories"),
        bound(F.min, "salary_max_annual").alias("salary_low"),
        bound(F.max, "salary_max_annual").alias("salary_high"),
    ).select(
        "*",
        F.coalesce(F.col("salary_low") < F.col("salary_high"), F.lit(False)).alias("salary_usable"),
        F.lit(YEARS_DOMAIN[0]).alias("yoe_low"),
        F.lit(YEARS_DOMAIN[1]).alias("yoe_high"),
    )


def search(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """Rows whose title, company or location matches the lower-cased term.

    The term is a regular expression unless ``literal``. No term, all rows.
    """
    if not term:
        return df
    hit = F.lit(False)
    for name in ("title", "company", "location"):
        if name in df.columns:
            value = F.lower(F.coalesce(name, F.lit("")))
            term_hit = F.contains(value, F.lit(term.lower())) if literal else F.rlike(value, F.lit(term.lower()))
            hit = hit | term_hit
    return df.where(hit)


def project_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def exclude_other(df: DataFrame, column: str = "region") -> DataFrame:
    """All but "Other"; null regions stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(OTHER_REGION)))


def drop_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def international(df: DataFrame) -> DataFrame:
    return df.where(F.col("region").isin(*INTERNATIONAL_REGIONS))


def international_points(df: DataFrame) -> DataFrame:
    """Located international postings with what a map marker shows."""
    located = drop_null(international(df), ["latitude", "longitude"])
    return project_existing(located, ["latitude", "longitude", "title", "company", "location", "cluster_label"])


def min_support(df: DataFrame, key: str, value: str, min_rows: int = 5, min_group: int = 3) -> DataFrame:
    """Rows with key and value whose group has enough of them; none if there are too few in all.

    Groups are counted with map-side partial counts and only their keys come
    back through a semi join, which splits a hot key over tasks; a window over
    the key would hold all of its rows in one.
    """
    valued = df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    groups = valued.groupBy(key).agg(F.count("*").alias("_n"))
    rows = groups.agg(F.sum("_n")).scalar()
    valid = groups.where((F.col("_n") >= min_group) & (rows >= min_rows)).select(key)
    return valued.join(valid, key, "left_semi")
