"""Naming clusters from counted keywords and title words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..dictionaries import CATEGORIES, TITLE_STOP_WORDS
from ..functions import patterns as P, text as X

TITLE_WORDS = 3


def title_word_counts(titles: DataFrame, by: str) -> DataFrame:
    """Words that say something about the field, of counted titles (by, title, n): (by, word, n)."""
    words = F.explode(F.split(X.strip(F.lower("title")), f"{P.SPACE}+"))
    return (
        titles.where(F.col("title").isNotNull()).select(by, words.alias("word"), "n")
        .groupBy(by, "word").agg(F.sum("n").alias("n"))
        .where(~F.col("word").isin(*TITLE_STOP_WORDS) & (F.length("word") > 2))
    )


def leading_words(counts: DataFrame, by: str, n: int = TITLE_WORDS) -> DataFrame:
    """The n most common of counted words (by, word, n) per group, in title case: (by, words)."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), F.asc("word")))
    return (
        counts.withColumn("rank", rank).where(F.col("rank") <= n)
        .groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("ranked"))
        .select(by, X.title_case(F.array_join("ranked.word", " ")).alias("words"))
    )


def labels_from_counts(
    scores: DataFrame, titles: DataFrame, k: int | None = None, categories: Mapping[str, Sequence[str]] = CATEGORIES
) -> DataFrame:
    """A label per cluster: (cluster_id, cluster_label).

    ``scores`` has (cluster_id, category, n), ``titles`` has (cluster_id, title, n).
    The category with the most keyword occurrences, the earlier one when tied;
    else the common title words; else "Cluster i". Repeated labels are numbered
    from the second on, by cluster. With ``k``, clusters without rows are labelled too.
    """
    ordinal = F.array_position(F.array(*(F.lit(c) for c in categories)), F.col("category"))
    best = (
        scores.where(F.col("n") > 0)
        .groupBy("cluster_id").agg(F.max_by("category", F.struct("n", -ordinal)).alias("category"))
    )
    seen = scores.select("cluster_id")
    parts = [best, leading_words(title_word_counts(titles, "cluster_id"), "cluster_id"), seen]
    if k is not None:
        parts.append(scores.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part, allowMissingColumns=True)
    base = found.groupBy("cluster_id").agg(F.max("category").alias("category"), F.max("words").alias("words")).select(
        "cluster_id",
        F.coalesce("category", F.nullif("words", F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster_id")))
        .alias("label"),
    )
    nth = F.row_number().over(W.partitionBy("label").orderBy("cluster_id"))
    numbered = F.when(F.col("nth") > 1, F.format_string("%s (%d)", "label", "nth")).otherwise(F.col("label"))
    return base.withColumn("nth", nth).select("cluster_id", numbered.alias("cluster_label"))
