"""First-match lookup against a dictionary that is itself a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def match_dictionary(
    df: DataFrame, text: str, dictionary: DataFrame, key: str, ordinal: str, values: list[str]
) -> DataFrame:
    """Add the ``values`` of the first dictionary row whose key occurs in ``text``.

    Substring tests are no equi-join, so the distinct texts are cut into their
    substrings of the lengths the dictionary has, and those join on equality:
    both sides shuffle, neither is broadcast, and no pair is formed that does
    not match. Texts are short (locations), so a text has few substrings.
    """
    terms = dictionary.select(
        F.lower(key).alias("_term"), F.col(ordinal).alias("_ordinal"), F.struct(*values).alias("_values")
    ).where(F.length("_term") > 0)
    lengths = terms.agg(F.sort_array(F.collect_set(F.length("_term")))).scalar()
    lowered = F.lower(text)
    pieces = (
        df.select(lowered.alias("_text")).where(F.col("_text").isNotNull()).distinct()
        .withColumn("_lengths", lengths)
        .withColumn("_length", F.explode(F.filter("_lengths", lambda n: n <= F.length("_text"))))
        .withColumn("_start", F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_length") + 1)))
        .select("_text", F.substring("_text", F.col("_start"), F.col("_length")).alias("_term"))
    )
    first = pieces.join(terms, "_term").groupBy("_text").agg(F.min_by("_values", "_ordinal").alias("_values"))
    return (
        df.withColumn("_text", lowered)
        .join(first, "_text", "left")
        .select(*df.columns, *(F.col(f"_values.{v}").alias(v) for v in values))
    )
