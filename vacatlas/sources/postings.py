"""Collecting raw postings, and tables as text."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from datetime import date, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..dictionaries import SEARCH_LOCATIONS, SEARCH_TITLES
from ..operators.enrich import is_home, search_country
from ..schema import KEY_SKILLS, NUMERIC_COLUMNS, RAW_POSTING
from ..session import stored

log = logging.getLogger(__name__)

# Column names of the collectors, in order of precedence from
# least to most, and the names they become.
COLLECTED_NAMES = {
    "title": ["title"],
    "company": ["company_name", "company"],
    "location": ["location"],
    "description": ["description"],
    "salary_min": ["min_amount"],
    "salary_max": ["max_amount"],
    "url": ["job_url"],
    "date_posted": ["date_posted"],
    "site": ["site"],
    "search_query": ["search_query"],
    "search_location": ["search_location"],
}


def empty_jobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_POSTING)


def union_batches(
    batches: Iterable[tuple[DataFrame | Callable[[], DataFrame], str, str]], spark: SparkSession | None = None,
    skipped: list[tuple[str, str, Exception]] | None = None, eager: bool = False,
) -> DataFrame:
    """Batches of (rows or a loader of rows, search query, search location) as one table.

    Columns are united by name. A loader that fails raises, unless a list for ``skipped`` batches is given, which
    then holds (query, location, error) of each. With ``eager`` each batch is read and stored at once, so that one whose
    rows cannot be read fails here too, and not when the result is used. Without any batch the result is the empty posting
    table.
    """
    parts = []
    for batch, query, location in batches:
        try:
            rows = batch() if callable(batch) else batch
            if eager:
                rows = stored(rows, "batch")
        except (PySparkException, Py4JJavaError, OSError) as error:
            if skipped is None:
                raise
            log.warning("skipping %r in %r: %s", query, location, error)
            skipped.append((query, location, error))
            continue
        parts.append(rows.withColumns({"search_query": F.lit(query), "search_location": F.lit(location)}))
    if not parts:
        return empty_jobs(spark or SparkSession.active())
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of each Parquet file of a folder, the error null where all of it can be decoded.

    Files are decoded in the tasks, a group of rows at a time, and nothing of them is kept.
    """

    def decode(batches):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                error = None
                try:
                    file = pq.ParquetFile(io.BytesIO(content.as_buffer()))
                    for group in range(file.num_row_groups):
                        file.read_row_group(group)
                except (pa.ArrowException, OSError, ValueError) as problem:
                    error = f"{type(problem).__name__}: {problem}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([error], pa.string())], ["file", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", "content").mapInArrow(decode, "file string, error string")


def read_batches(
    spark: SparkSession, path: str, skip_corrupt: bool = False, quarantine: str | None = None
) -> DataFrame:
    """A folder of collected Parquet batches.

    An unreadable file raises, or is skipped where the caller asks for it. With ``quarantine``, a folder, each file is
    decoded first: a damaged one leaves a row (file, error) there, and none of its rows is taken; all others load. The
    names of the files pass through the driver, as they do for any read.
    """
    reader = spark.read.option("ignoreCorruptFiles", skip_corrupt).option("mergeSchema", "true")
    if quarantine is None:
        return reader.parquet(path)
    checked = stored(damaged_files(spark, path), "checked-files")
    bad = checked.where("error IS NOT NULL")
    bad.coalesce(1).write.mode("append").parquet(quarantine)
    for row in bad.limit(20).collect():
        log.warning("quarantined %s: %s", row["file"], row["error"])
    good = [row["file"] for row in checked.where("error IS NULL").select("file").collect()]
    return reader.option("basePath", path).parquet(*good) if good else empty_jobs(spark)


def search_grid(
    spark: SparkSession, titles: Sequence[str] = SEARCH_TITLES, locations: Sequence[str] = SEARCH_LOCATIONS
) -> DataFrame:
    """Every title in every location, and the country to search: (title, location, is_us, country)."""
    rows = spark.createDataFrame([(title, list(locations)) for title in titles], "title string, l array<string>")
    grid = rows.select("title", F.explode("l").alias("location"))
    return grid.withColumns({"is_us": is_home("location"), "country": search_country("location")})


def standardize_columns(df: DataFrame) -> DataFrame:
    """Posting columns under their standard names; absent ones are null, others dropped."""
    columns = []
    for field in RAW_POSTING:
        present = [name for name in COLLECTED_NAMES[field.name] if name in df.columns]
        source = F.col(present[-1]) if present else F.lit(None)
        columns.append(source.cast(field.dataType).alias(field.name))
    kept = [F.col("posting_id")] if "posting_id" in df.columns else []
    return df.select(*kept, *columns)


def recent(df: DataFrame, as_of: str | datetime, hours: int = 168, column: str = "date_posted") -> DataFrame:
    """Postings not older than ``hours`` at ``as_of``; the bound reaches the scan as a literal."""
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    bound: datetime | date = moment - timedelta(hours=hours)
    if dict(df.dtypes)[column] == "date":
        midnight = bound == bound.replace(hour=0, minute=0, second=0, microsecond=0)
        bound = bound.date() if midnight else bound.date() + timedelta(days=1)
    return df.where(F.col(column) >= F.lit(bound))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; skill maps as JSON. Line breaks in texts are escaped, so that a row stays one line."""
    nested = [name for name, kind in df.dtypes if kind.startswith(("map", "array", "struct"))]
    df = df.withColumns({name: F.to_json(name) for name in nested})
    df = df.withColumns({
        name: F.replace(F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        for name, kind in df.dtypes if kind == "string"
    })
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def _unescaped(name: str) -> Column:
    """Escaped line breaks and backslashes as they were; a private character keeps escaped backslashes apart."""
    out = F.replace(name, F.lit("\\\\"), F.lit("\ue001"))
    for code, char in (("\\n", "\n"), ("\\r", "\r"), ("\ue001", "\\")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def load_typed(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV table with its numbers as numbers and its skills as a map.

    What is no number becomes null, what is no map an empty one. Line breaks that ``export_csv`` escaped come back;
    files of others with bare line breaks need ``multiline``, which reads a file in one piece and unescapes nothing.
    """
    df = (
        spark.read.option("header", "true").option("escape", '"').option("multiLine", multiline).csv(path)
    )
    if not multiline:
        df = df.withColumns({name: _unescaped(name) for name in df.columns})
    typed = {name: F.col(name).try_cast(kind) for name, kind in NUMERIC_COLUMNS.items() if name in df.columns}
    if "key_skills" in df.columns:
        empty = F.create_map().cast(KEY_SKILLS)
        typed["key_skills"] = F.coalesce(F.from_json("key_skills", KEY_SKILLS), empty)
    return df.withColumns(typed)
