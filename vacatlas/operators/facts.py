"""Value counts: the one small table all market statistics are read from.

Every posting contributes a row per fact ("this region and company", "this
region and salary", ...), and equal rows are counted. The counting starts inside
the map tasks, right behind the scan, so one pass over the postings and one
shuffle of distinct values serve any number of statistics, and a region that
holds a third of all postings arrives as its distinct values only. Counts,
means, modes, quantiles and histograms follow exactly from the value counts.

Postings that are clustered but not labelled yet are labelled on the way: the
keyword counts the labels hang on are facts as well, so the texts need no pass
of their own for them, and labels are put on the counts, not on the postings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..dictionaries import CATEGORIES
from ..functions import skills as K
from ..session import shared_folder
from .labels import labels_from_counts

#: fact -> where its (key, item, x, y) come from.
FACTS = {
    "company": ("region", "company", None, None),
    "category": ("cluster_label", "region", None, None),
    "state": ("state", None, None, None),
    "salary_region": ("region", None, "salary_max_annual", None),
    "salary_category": ("cluster_label", None, "salary_max_annual", None),
    "floor_category": ("cluster_label", None, "salary_min_annual", None),
    "years_region": ("region", None, "yoe_min", None),
    "years_category": ("cluster_label", None, "yoe_min", None),
    "place": ("cluster_label", None, "latitude", "longitude"),
    "skill": ("key_skills", None, None, None),
    "title": ("cluster_label", "title", None, None),
}
#: Facts that only serve to label clusters: keyword occurrences and titles.
SCORE, TITLE = "score", "title"
MARKET = [name for name in FACTS if name != TITLE]
LABEL_FACTS = [name for name in MARKET if FACTS[name][0] == "cluster_label"]
COLUMNS = ["fact", "key", "item", "x", "y", "n"]


def facts(df: DataFrame, *names: str) -> DataFrame:
    """Counted facts of the postings: (fact, key, item, x, y, n).

    Given a table of facts, just its rows of the named facts. Absent columns
    count as null.
    """
    names = names or tuple(MARKET)
    if set(COLUMNS) <= set(df.columns):
        return df.where(F.col("fact").isin(*names))
    if not _to_label(df, names):
        return _counted(df, names)
    return _labelled(_counted(_marked(df), [*names, SCORE, TITLE]))


def kept_facts(df: DataFrame, *names: str) -> DataFrame:
    """The same, counted now and kept in the shared folder: one pass for all that is read from it."""
    shared_folder(df.sparkSession)
    names = names or tuple(MARKET)
    if not _to_label(df, names):
        return _counted(df, names).checkpoint()
    return _labelled(_counted(_marked(df), [*names, SCORE, TITLE]).checkpoint()).checkpoint()


def _to_label(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether facts by label are asked for of postings that have clusters only."""
    clustered = "cluster_label" not in df.columns and "cluster_id" in df.columns
    return clustered and bool(set(names) & set(LABEL_FACTS))


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster_label", F.col("cluster_id").cast("string"))


def _labelled(counted: DataFrame) -> DataFrame:
    """Facts by cluster as facts by label."""
    labels = _labels(counted).select(F.col("cluster_id").cast("string").alias("_id"), "cluster_label")
    by_label = F.col("fact").isin(*LABEL_FACTS)
    named = counted.where(~F.col("fact").isin(SCORE, TITLE)).join(
        labels, by_label & (F.col("key") == F.col("_id")), "left"
    )
    key = F.when(by_label, F.col("cluster_label")).otherwise(F.col("key")).alias("key")
    return named.select("fact", key, "item", "x", "y", "n")


def cluster_labels(
    df: DataFrame, k: int | None = None, categories: Mapping[str, Sequence[str]] = CATEGORIES
) -> DataFrame:
    """A label per cluster of the postings, read off one pass; see ``labels_from_counts``."""
    return _labels(_counted(_marked(df), [SCORE, TITLE], categories), k, categories)


def _labels(
    counted: DataFrame, k: int | None = None, categories: Mapping[str, Sequence[str]] = CATEGORIES
) -> DataFrame:
    def part(fact: str, name: str) -> DataFrame:
        of_fact = (F.col("fact") == fact) & F.col("key").isNotNull()
        return counted.where(of_fact).select(
            F.col("key").cast("int").alias("cluster_id"), F.col("item").alias(name), "n"
        )

    return labels_from_counts(part(SCORE, "category"), part(TITLE, "title"), k, categories)


def with_scores(df: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """Add ``_scores``, the keyword occurrences of each category, so that labels can be counted without the texts."""
    lowered = df.withColumn("_lowered", F.lower(F.coalesce("description", F.lit(""))))
    counts = {f"_c{i}": K.keyword_count("_lowered", words) for i, words in enumerate(categories.values())}
    return lowered.withColumns(counts).withColumn("_scores", F.array(*counts)).drop("_lowered", *counts)


def _row(fact: str, key: Column, item: Column, x: Column, y: Column, weight: Column) -> Column:
    return F.struct(
        F.lit(fact).alias("fact"), key.cast("string").alias("key"), item.cast("string").alias("item"),
        x.cast("double").alias("x"), y.cast("double").alias("y"), weight.cast("bigint").alias("weight"),
    )


def _counted(
    df: DataFrame, names: Sequence[str], categories: Mapping[str, Sequence[str]] = CATEGORIES
) -> DataFrame:
    none, one = F.lit(None), F.lit(1)

    def part(name: str | None) -> Column:
        return F.col(name) if name in df.columns else none

    rows = [
        _row(name, *(part(column) for column in FACTS[name]), one)
        for name in names if name in FACTS and name != "skill"
    ]
    lists = []
    if SCORE in names and ("_scores" in df.columns or "description" in df.columns):
        if "_scores" in df.columns:
            scores = [F.col("_scores")[i] for i in range(len(categories))]
        else:
            df = df.withColumn("_lowered", F.lower(F.coalesce("description", F.lit(""))))
            df = df.withColumns({f"_c{i}": K.keyword_count("_lowered", w) for i, w in enumerate(categories.values())})
            scores = [F.col(f"_c{i}") for i in range(len(categories))]
        rows += [
            _row(SCORE, F.col("cluster_label"), F.lit(category), none, none, score)
            for category, score in zip(categories, scores, strict=True)
        ]
    if "skill" in names and "key_skills" in df.columns:
        lists.append(
            F.flatten(
                F.transform(
                    F.map_entries("key_skills"),
                    lambda e: F.transform(e["value"], lambda skill: _row("skill", e["key"], skill, none, none, one)),
                )
            )
        )
    empty = F.array().cast(f"array<{_ROW_TYPE}>")
    every = F.array(*rows) if rows else empty
    if lists:
        every = F.concat(every, *(F.coalesce(part, empty) for part in lists))
    one_row = len(rows) == 1 and not lists
    spread = df.select((rows[0] if one_row else F.explode(every)).alias("row")).select("row.*")
    counted = spread.groupBy("fact", "key", "item", "x", "y").agg(F.sum("weight").alias("n"))
    # A filter on a plain grouping column would move below the counting and give
    # each reader of the table its own pass over the postings. Columns looked up
    # by way of the count stay above it, so that all readers share the one shuffle.
    first = F.when(F.col("n").isNull(), 1).otherwise(0)
    return counted.select(*(F.get(F.array(c), first).alias(c) for c in COLUMNS[:-1]), "n")


_ROW_TYPE = "struct<fact: string, key: string, item: string, x: double, y: double, weight: bigint>"


def skill_rows(df: DataFrame, key: str) -> DataFrame:
    """A row per posting, category and skill.

    The map is exploded with its empty rows, which are dropped after: a plain
    explode would have the map tested for being empty before, and with it the
    whole extraction run twice.
    """
    categories = df.select(key, F.explode_outer("key_skills").alias("category", "_skills"))
    found = categories.where(F.col("category").isNotNull())
    return found.select(key, "category", F.explode("_skills").alias("skill"))
