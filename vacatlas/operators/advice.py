"""Career advice drawn from the market statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..dictionaries import EMERGING_SKILLS
from ..functions import text as X
from . import aggregates as A
from .facts import facts

# The wording of the advice. Each takes the texts in braces.
SENTENCES = {
    "TRENDING SKILLS": "The most in-demand emerging skills are: {skills}. Prioritize learning these to stay competitive.",
    "MUST-HAVE SKILLS": "The top 5 most requested skills are: {skills}. Ensure proficiency in these fundamentals.",
    "CLOUD PLATFORM": "{skill} is the most requested cloud platform. Consider getting certified.",
    "HOT CATEGORY": "'{category}' represents {pct}% of all openings ({n} jobs). This is the highest-demand area.",
    "NICHE OPPORTUNITIES": (
        "Consider specializing in less crowded areas like {categories} for potentially less competition "
        "and unique career positioning."
    ),
    "SALARY BENCHMARKS": (
        "Median max salary is {median}. Top 25% earn above {p75}, and top 10% earn above {p90}. "
        "Use these as negotiation benchmarks."
    ),
    "HIGHEST PAYING": (
        "'{category}' roles have the highest median salary at {median}. "
        "Transitioning to this area could boost earning potential."
    ),
    "TOP PAYING REGION": (
        "'{region}' offers the highest median salary at {median}. Consider opportunities in this area."
    ),
    "TOP HUB": "'{region}' leads with {n} openings. Major tech hubs continue to dominate DS/ML hiring.",
    "INTERNATIONAL": (
        "{n} openings found in Singapore/Hong Kong. International experience can differentiate your profile "
        "and expand opportunities."
    ),
    "EXPERIENCE": (
        "Median YOE requirement is {median} years. Distribution: Entry-level (0-2yr): {entry}, "
        "Mid-level (3-5yr): {mid}, Senior (5+yr): {senior}."
    ),
    "ENTRY-LEVEL": (
        "{pct}% of roles require 0-2 years. New graduates should focus on building strong portfolios "
        "and contributing to open-source projects."
    ),
    "PORTFOLIO": (
        "Build end-to-end ML projects that demonstrate business impact, not just model accuracy. Include deployment."
    ),
    "NETWORKING": (
        "Engage with the DS/ML community through conferences (NeurIPS, ICML, KDD), local meetups, "
        "and online communities."
    ),
    "CONTINUOUS LEARNING": (
        "The field evolves rapidly. Dedicate at least 5 hours per week to learning new tools, reading papers, "
        "and taking courses on platforms like Coursera or fast.ai."
    ),
    "COMMUNICATION": (
        "Strong communication skills differentiate senior from junior roles. Practice presenting technical "
        "concepts to non-technical stakeholders."
    ),
}
ORDER = list(SENTENCES)
GENERAL = ORDER[-4:]


def skill_gaps(df: DataFrame, emerging: Sequence[str] = EMERGING_SKILLS) -> DataFrame:
    """Skills to learn: the 5 leading emerging ones, the 5 leading ones, the leading cloud one."""
    counts = A.skill_frequency(df)
    totals = counts.groupBy("skill").agg(F.sum("n").alias("n"))

    def leading(rows: DataFrame, kind: str, k: int) -> DataFrame:
        ranked = A.top(rows.select("skill", "n"), "skill", k)
        rank = F.row_number().over(W.orderBy(F.desc("n"), F.asc("skill")))
        return ranked.select(F.lit(kind).alias("kind"), rank.alias("rank"), "skill", "n")

    return (
        leading(totals.where(F.col("skill").isin(*emerging)), "emerging", 5)
        .unionByName(leading(totals, "required", 5))
        .unionByName(leading(counts.where(F.col("category") == "cloud"), "cloud", 1))
    )


def general_advice(df: DataFrame) -> DataFrame:
    """The advice that does not depend on the data."""
    rows = [(ORDER.index(label), label, SENTENCES[label]) for label in GENERAL]
    return df.sparkSession.createDataFrame(rows, "position int, label string, body string")


def suggestions(df: DataFrame) -> DataFrame:
    """All advice in order, as (position, label, body); parts without data are absent.

    Reads facts only, so it is given a table of facts, or counts the postings once.
    """
    table = facts(df)
    parts = [
        *_skill_advice(table), *_category_advice(table), *_salary_advice(table),
        *_place_advice(table), *_experience_advice(table), general_advice(df),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.orderBy("position")


def _say(rows: DataFrame, label: str, **texts: Column) -> DataFrame:
    """One row of advice per row, its sentence filled in."""
    pieces, rest = [], SENTENCES[label]
    for name, value in texts.items():
        before, rest = rest.split("{" + name + "}")
        pieces += [F.lit(before), value.cast("string")]
    body = F.concat(*pieces, F.lit(rest))
    return rows.select(F.lit(ORDER.index(label)).alias("position"), F.lit(label).alias("label"), body.alias("body"))


def _joined(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Names of a few ranked rows as one text; no row when there are none."""
    listed = rows.agg(F.sort_array(F.collect_list(F.struct(order, name))).alias("rows"))
    return listed.where(F.size("rows") > 0).select(F.array_join(f"rows.{name}", ", ").alias("names"))


def _skill_advice(table: DataFrame) -> list[DataFrame]:
    gaps = skill_gaps(table)

    def kind(name: str) -> DataFrame:
        return gaps.where(F.col("kind") == name)

    return [
        _say(_joined(kind("emerging"), "rank", "skill"), "TRENDING SKILLS", skills=F.col("names")),
        _say(_joined(kind("required"), "rank", "skill"), "MUST-HAVE SKILLS", skills=F.col("names")),
        _say(kind("cloud"), "CLOUD PLATFORM", skill=F.upper("skill")),
    ]


def _category_advice(table: DataFrame) -> list[DataFrame]:
    trends = A.category_trends(table)
    hot = trends.where(F.col("kind") == "hot")
    niche = _joined(trends.where(F.col("kind") == "niche"), "position", "cluster_label")
    return [
        _say(hot, "HOT CATEGORY", category=F.col("cluster_label"), pct=X.decimal(F.col("pct")), n=F.col("n")),
        _say(niche, "NICHE OPPORTUNITIES", categories=F.col("names")),
    ]


def _salary_advice(table: DataFrame) -> list[DataFrame]:
    marks = A.salary_benchmarks(table)
    best = A.median_salary_rank(table, "cluster_label").limit(1)
    best_region = A.median_salary_rank(table, "region").limit(1)
    usd = X.usd(F.col("median_salary"))
    return [
        _say(
            marks, "SALARY BENCHMARKS",
            median=X.usd(F.col("median")), p75=X.usd(F.col("p75")), p90=X.usd(F.col("p90")),
        ),
        _say(best, "HIGHEST PAYING", category=F.col("cluster_label"), median=usd),
        _say(best_region, "TOP PAYING REGION", region=F.col("region"), median=usd),
    ]


def _place_advice(table: DataFrame) -> list[DataFrame]:
    places = A.geo_trends(table).where(F.col("top_region").isNotNull())
    return [
        _say(places, "TOP HUB", region=F.col("top_region"), n=F.col("top_count")),
        _say(places.where(F.col("international") > 0), "INTERNATIONAL", n=F.col("international")),
    ]


def _experience_advice(table: DataFrame) -> list[DataFrame]:
    bands = A.yoe_bands(table).where(F.col("median").isNotNull())
    return [
        _say(
            bands, "EXPERIENCE", median=X.decimal(F.col("median"), 0),
            entry=F.col("entry"), mid=F.col("mid"), senior=F.col("senior"),
        ),
        _say(bands.where(F.col("entry") > 0), "ENTRY-LEVEL", pct=X.decimal(F.col("entry_pct"), 0)),
    ]
