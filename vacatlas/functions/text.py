"""Text and scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P


def strip(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.btrim(text, F.lit(P.SPACE_CHARS))


def has_only_blanks(text: Column) -> Column:
    """Whether a plain ASCII text has no white space but blanks; null is no.

    Plain searches cost a fraction of a regular expression over the text.
    """
    other = F.contains(text, F.lit(P.CONTROL_SPACES[0]))
    for space in P.CONTROL_SPACES[1:]:
        other = other | F.contains(text, F.lit(space))
    return F.coalesce((F.octet_length(text) == F.char_length(text)) & ~other, F.lit(False))


def plain_text(html: Column) -> Column:
    """Tags to blanks, white space to single blanks, ends stripped; null to ""."""
    untagged = F.regexp_replace(F.coalesce(html, F.lit("")), P.HTML_TAG, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(untagged, P.SPACE_NOT_BLANK, " "), P.BLANKS, " "))


def years_phrases(text: Column) -> Column:
    """The phrases of a text that start with a figure, which ``years_phrase`` looks at."""
    return F.array_join(F.regexp_extract_all(text, F.lit(P.YEARS_PHRASE), F.lit(0)), "\n")


def years_phrase(text: Column, phrases: Column | None = None) -> Column:
    """The phrase that states the experience asked for, or null.

    A phrase with two figures starts with ``2:``, one with a single figure with
    ``1:``. The patterns are tried in order. Those that start with a figure look
    only at the phrases one pass over the text has collected; the one that does
    not reads the text where no pattern before it has matched. Given a column that holds the ``phrases``, they are
    collected once, else by each pattern that is tried.
    """
    phrases = years_phrases(text) if phrases is None else phrases
    figures, minimum, relevant = P.YEARS_SINGLE

    def found(tag: str, source: Column, pattern: str) -> Column:
        return F.concat(F.lit(tag), F.nullif(F.regexp_extract(source, pattern, 0), F.lit("")))

    return F.coalesce(
        found("2:", phrases, P.YEARS_RANGE), found("1:", phrases, figures),
        found("1:", text, minimum), found("1:", phrases, relevant),
    )


def years_min(phrase: Column) -> Column:
    figure = F.regexp_extract(phrase, f"^..[^{P.DIGIT}]*({P.DIGIT}+)", 1)
    return figure.try_cast("int")


def years_max(phrase: Column) -> Column:
    figure = F.regexp_extract(phrase, f"^2:({P.DIGIT}+)[^{P.DIGIT}]+({P.DIGIT}+)", 2)
    return F.when(F.startswith(phrase, F.lit("2:")), figure.try_cast("int"))


# Amounts below these are hourly or monthly pay.
HOURLY_BELOW, HOURS_PER_YEAR = 1000, 2080
MONTHLY_BELOW, MONTHS_PER_YEAR = 10000, 12


def annual_salary(pay: Column) -> Column:
    """Yearly amount of a pay given as a number or as text, else null."""
    text = strip(pay.cast("string"))
    number = F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "").try_cast("double")
    bare = F.regexp_extract(F.translate(text, ",$", ""), P.SALARY_NUMBER, 1).try_cast("double")
    amount = F.coalesce(number, bare)
    amount = F.when(F.abs(amount) < float("inf"), amount)  # neither infinite nor NaN, which is above all
    return (
        F.when(amount < HOURLY_BELOW, amount * HOURS_PER_YEAR)
        .when(amount < MONTHLY_BELOW, amount * MONTHS_PER_YEAR)
        .otherwise(amount)
    )


def listed_items(text: Column, limit: int | None = None) -> Column:
    """Distinct bulleted, then numbered items longer than 20 characters; all of them, or the first ``limit``."""
    hits = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in P.LISTED_ITEMS]
    items = F.array_distinct(F.transform(F.concat(*hits), strip))
    found = F.filter(items, lambda item: F.length(item) > 20)
    return found if limit is None else F.slice(found, 1, limit)


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def usd(amount: Column) -> Column:
    """``$1,234``, half to even."""
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def decimal(number: Column, digits: int = 1) -> Column:
    """Fixed number of digits without grouping, half to even."""
    return F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))


def percent(share: Column, digits: int = 1) -> Column:
    """A share of 100 as ``12.3%``."""
    return F.concat(decimal(share, digits), F.lit("%"))


def label_part(text: Column) -> Column:
    """What stands before the first colon; null where there is none."""
    return F.when(F.contains(text, F.lit(":")), strip(F.split(text, ":", 2)[0]))


def body_part(text: Column) -> Column:
    """What stands after the first colon; all of it where there is none."""
    parts = F.split(text, ":", 2)
    return F.when(F.contains(text, F.lit(":")), strip(F.get(parts, F.lit(1)))).otherwise(text)


def slug(label: Column) -> Column:
    return F.lower(F.translate(label, "/ ", "__"))


def display_name(key: Column) -> Column:
    return title_case(F.translate(key, "_", " "))


def clip(number: Column, low: float, high: float) -> Column:
    """Bound to [low, high]; null stays null."""
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(low)), F.lit(high)))


def run_date(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")
