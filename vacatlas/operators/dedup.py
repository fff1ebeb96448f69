"""Duplicate postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .enrich import clean_text

KEY = ["title", "company", "location"]


def dedup(df: DataFrame, order: str = "posting_id", clean_first: bool = False) -> DataFrame:
    """First posting per (title, company, location), then first of those per url.

    ``order`` identifies a posting and says which comes first. Nulls equal each
    other. The winners are found on the key columns alone, so the descriptions
    are neither read nor moved for it: both groupings collapse inside each map
    task (a key held by a third of all rows leaves one row per task). The rows are
    kept by a predicate on ``order``, which Spark moves below the expressions and
    joins that make the wide columns, where a semi join would stay above them and
    shuffle them all.
    """
    if clean_first:
        df = clean_text(df)
    keys = [c for c in KEY if c in df.columns]
    has_url = "url" in df.columns
    if not keys and not has_url:
        return df
    winners = df.select(order, *keys, *(["url"] if has_url else []))
    if keys:
        kept = [F.min_by("url", order).alias("url")] if has_url else []
        winners = winners.groupBy(*keys).agg(F.min(order).alias(order), *kept)
    if has_url:
        winners = winners.groupBy("url").agg(F.min(order).alias(order))
    return among(df, order, winners)


def among(df: DataFrame, order: str, kept: DataFrame) -> DataFrame:
    """The rows whose ``order`` is one of those of ``kept``; null is none."""
    query = f"SELECT * FROM {{rows}} WHERE `{order}` IN (SELECT `{order}` FROM {{kept}})"
    return df.sparkSession.sql(query, rows=df, kept=kept)
