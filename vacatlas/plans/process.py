"""The stages every posting goes through, composed lazily."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import enrich as E
from ..operators.dedup import dedup
from ..operators.scan import scan_texts


def enrich_rows(df: DataFrame, *read: str) -> DataFrame:
    """Row-level part of processing; the same for batches and streams.

    With kinds of what to ``read`` off the descriptions, "years" among them, one scan reads all of them, in batches, and
    the descriptions stay only with "text"; see ``scan_texts``. Without, all are lazy expressions, and what nobody uses
    is not computed.
    """
    df = E.clean_text(df, E.TEXT_COLUMNS[:-1]) if read else E.clean_text(df)
    df = E.geocode(df)
    df = E.assign_region(df)
    df = E.assign_state(df)
    if read:
        df = scan_texts(E.normalize_salaries(df), *read)
        return E.extract_years(df).drop("_near_years")
    return E.normalize_salaries(E.extract_years(df))


def process(df: DataFrame, order: str = "posting_id", read: Sequence[str] = ()) -> DataFrame:
    """Drop duplicates, clean, locate, read experience and salaries; ``read`` as for ``enrich_rows``."""
    return enrich_rows(dedup(df, order), *read)


def describe(df: DataFrame, items: int | None = 10) -> DataFrame:
    """Summary, skills and the first ``items`` responsibilities of each description; all of them for None."""
    if "description" not in df.columns:
        return df
    return E.extract_responsibilities(E.extract_skills(E.summarize(df)), items)
