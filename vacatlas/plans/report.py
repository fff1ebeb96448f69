"""The market report as tables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from ..operators import advice, aggregates as A
from ..operators.facts import kept_facts
from ..sources.snapshots import write_snapshot

log = logging.getLogger(__name__)
T, U = TypeVar("T"), TypeVar("U")

#: Tables of the report, in the order of its sections.
TABLES = {
    "kpis": A.kpis,
    "category_counts": A.category_counts,
    "category_share": A.category_share,
    "region_report": A.region_report,
    "region_stats": A.region_stats,
    "state_counts": A.state_counts,
    "region_counts": A.region_counts,
    "region_categories": A.crosstab_long,
    "city_density": A.city_density,
    "cluster_density": A.cluster_density,
    "cluster_summary": A.cluster_summary,
    "salary_stats": A.salary_stats,
    "salary_histogram": A.histogram,
    "salary_by_region": lambda t: A.box_stats(t, "salary_region", with_other=False),
    "salary_by_category": lambda t: A.box_stats(t, "salary_category"),
    "yoe_histogram": A.yoe_histogram,
    "yoe_by_category": lambda t: A.box_stats(t, "years_category"),
    "top_skills": A.top_skills,
    "skills_by_category": A.top_skills_by_category,
    "top_companies": A.top_companies,
    "suggestions": advice.suggestions,
}


def report_tables(df: DataFrame, skipped: list[tuple[str, Exception]] | None = None) -> dict[str, DataFrame]:
    """All tables of the report.

    One that cannot be built raises, unless a list for ``skipped`` ones is given, which then holds (name, error) of each.
    The postings are read in one pass, for their facts; all tables come from these.
    """
    table = kept_facts(df)
    return _each(TABLES, lambda name, build: build(table), skipped)


def write_report(
    df: DataFrame, root: str, run_date: str, skipped: list[tuple[str, Exception]] | None = None
) -> dict[str, str]:
    """Store the tables of the report under its date: the folder of each. ``skipped`` as for ``report_tables``; a table
    that fails while it is written is skipped too, and its last snapshot stays."""
    tables = report_tables(df, skipped)
    return _each(tables, lambda name, table: write_snapshot(table, root, name, run_date), skipped)


def _each(parts: Mapping[str, T], make: Callable[[str, T], U], skipped: list[tuple[str, Exception]] | None) -> dict[str, U]:
    made = {}
    for name, part in parts.items():
        try:
            made[name] = make(name, part)
        except (PySparkException, Py4JJavaError, ValueError) as error:
            if skipped is None:
                raise
            log.warning("skipping %s: %s", name, error)
            skipped.append((name, error))
    return made
