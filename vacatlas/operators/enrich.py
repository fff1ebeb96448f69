"""Row-level enrichment. Everything here is a projection: no shuffle, no join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..dictionaries import (
    CITY_COORDINATES, CITY_STATES, HOME_COUNTRY, IMPORTANT_WORDS, OTHER_REGION, REGIONS, SEARCH_COUNTRIES, SKILLS,
)
from ..functions import matching, patterns as P, skills as K, text as X
from .dictionary import MOST_PLAIN, extract_many
from .scan import scan_texts, years_source

UNKNOWN_COMPANY = "Unknown"


TEXT_COLUMNS = ("title", "company", "location", "description")


def clean_text(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Fill nulls, strip, and turn descriptions to plain text; absent columns are skipped."""
    cleaned = {
        "title": lambda c: X.strip(F.coalesce(c, F.lit(""))),
        "company": lambda c: X.strip(F.coalesce(c, F.lit(UNKNOWN_COMPANY))),
        "location": lambda c: X.strip(F.coalesce(c, F.lit(""))),
        "description": X.plain_text,
    }
    return df.withColumns({name: rule(F.col(name)) for name, rule in cleaned.items() if name in df.columns and name in columns})


def read_text(df: DataFrame, *kinds: str) -> DataFrame:
    """``clean_text``, with all that ``kinds`` name read off the descriptions on the way; see ``scan_texts``."""
    return clean_text(scan_texts(df, *kinds), TEXT_COLUMNS[:-1])


def geocode(df: DataFrame, cities: Mapping[str, tuple[float, float]] = CITY_COORDINATES) -> DataFrame:
    """Coordinates of the first city named in the location; null for none."""

    def axis(i: int) -> Column:
        return matching.first_match("location", {city: float(point[i]) for city, point in cities.items()})

    return df.withColumns({"latitude": axis(0), "longitude": axis(1)})


def assign_region(df: DataFrame, regions: Mapping[str, Sequence[str]] = REGIONS) -> DataFrame:
    """First region with a city named in the location, else "Other"."""
    entries: dict[str, str] = {}
    for region, cities in regions.items():
        for city in cities:
            entries.setdefault(city, region)
    return df.withColumn("region", matching.first_match("location", entries, OTHER_REGION))


def assign_state(df: DataFrame, states: Mapping[str, str] = CITY_STATES, case_fold: bool = True) -> DataFrame:
    """State of the first city named in the location.

    With ``case_fold`` off, a location without a known city yields the state
    code after its comma (``"Dallas, TX"``); folded text has no such code.
    """
    code = f"nullif(regexp_extract(location, {matching.sql_literal(P.STATE_CODE)}, 1), '')"
    return df.withColumn("state", F.expr(matching.first_match_sql("location", states, "NULL" if case_fold else code)))


def extract_years(df: DataFrame) -> DataFrame:
    """Years of experience asked for: yoe_min, yoe_max, from the description or from what ``scan_texts`` leaves of it."""
    text = F.coalesce(years_source(df), F.lit(""))
    return (
        df.withColumn("_phrases", X.years_phrases(text))
        .withColumn("_years", X.years_phrase(text, F.col("_phrases")))
        .withColumns({"yoe_min": X.years_min(F.col("_years")), "yoe_max": X.years_max(F.col("_years"))})
        .drop("_phrases", "_years")
    )


def normalize_salaries(df: DataFrame) -> DataFrame:
    """Annual salaries; an absent salary column gives nulls."""

    def pay(name: str) -> Column:
        return X.annual_salary(F.col(name)) if name in df.columns else F.lit(None).cast("double")

    return df.withColumns({"salary_min_annual": pay("salary_min"), "salary_max_annual": pay("salary_max")})


def extract_skills(
    df: DataFrame, skills: Mapping[str, Sequence[str]] = SKILLS, word_boundary: bool = False
) -> DataFrame:
    """``key_skills``: category to the keywords found in the description.

    A dictionary of more than ``MOST_PLAIN`` keywords is matched by one automaton instead of one search for each.
    """
    if sum(map(len, skills.values())) > MOST_PLAIN:
        return extract_many(df, skills, word_boundary)
    found = {category: f"_skills{i}" for i, category in enumerate(skills)}
    return (
        df.withColumn("_lowered", F.lower(F.coalesce("description", F.lit(""))))
        .withColumns(
            {found[category]: K.found_keywords("_lowered", words, word_boundary) for category, words in skills.items()}
        )
        .withColumn("key_skills", K.skill_map(found))
        .drop("_lowered", *found.values())
    )


def summarize(df: DataFrame, sentences: int = 3, important: Sequence[str] | None = None) -> DataFrame:
    """``summary``: the sentences richest in keywords, earlier ones favoured, in text order.

    All inside the row. Equal scores go to the later sentence.
    """
    if important is None:
        important = [word for words in SKILLS.values() for word in words] + IMPORTANT_WORDS
    text = F.coalesce("description", F.lit(""))
    long_ones = F.filter(
        F.transform(F.split(text, P.SENTENCE_END), X.strip), lambda s: F.length(s) > 20
    )

    def scored(sentence: Column, i: Column) -> Column:
        lowered = F.lower(sentence)
        words = F.when(F.col("_blanks"), F.split(lowered, " ")).otherwise(F.split(lowered, f"{P.SPACE}+"))
        hits = F.size(F.filter(words, lambda w: w.isin(*important)))
        boost = F.greatest(F.lit(0.0), F.lit(1.0) - (i / F.size("_sentences")) * F.lit(0.5))
        return F.struct((hits * (F.lit(1.0) + boost)).alias("score"), i.alias("i"), sentence.alias("sentence"))

    best = F.slice(F.sort_array(F.transform("_sentences", scored), asc=False), 1, sentences)
    in_order = F.sort_array(F.transform(best, lambda s: F.struct(s["i"].alias("i"), s["sentence"].alias("sentence"))))
    picked = F.transform(in_order, lambda s: s["sentence"])
    summary = (
        F.when(F.length(text) < 50, text)
        .when(F.size("_sentences") <= sentences, F.array_join("_sentences", " "))
        .otherwise(F.array_join(picked, " "))
    )
    staged = df.withColumns({"_sentences": long_ones, "_blanks": X.has_only_blanks(text)})
    return staged.withColumn("summary", summary).drop("_sentences", "_blanks")


def extract_responsibilities(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``responsibilities``: all listed items of the description, or the first ``limit`` of them."""
    return df.withColumn("responsibilities", X.listed_items(F.coalesce("description", F.lit("")), limit))


def search_country(column: str) -> Column:
    """Country a search in the column's place is made in."""
    return matching.first_match(column, SEARCH_COUNTRIES, HOME_COUNTRY)


def is_home(column: str) -> Column:
    return ~matching.contains_any(column, SEARCH_COUNTRIES)
