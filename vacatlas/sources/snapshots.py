"""Dated snapshots of a stage, replaced as a whole.

A snapshot is written to a folder of its own, then a row that names it is added to the stage's commits. Both writes go
through Spark's committers, so they work on any store that Spark reaches. A reader takes the last committed version of a
date: it never sees a snapshot half written, and a run that fails leaves the one before in place.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Working columns that are not stored.
TRANSIENT = ["embedding"]
COMMIT = "run_date string, number bigint, version string"


def _commits(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """One row per version: its date, its number, and the name of its folder."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{root}/{stage}_commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def _last(spark: SparkSession, root: str, stage: str, run_date: str):
    found = _commits(spark, root, stage).where(F.col("run_date") == run_date)
    return found.orderBy(F.desc("number"), F.desc("version")).first()


def write_snapshot(df: DataFrame, root: str, stage: str, run_date: str) -> str:
    """Store a stage under its date and return its folder.

    A second run of the date replaces only that date, also by no rows at all, once all of its rows are written. Versions
    that are replaced stay readable for those who read them, until their folders are removed.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    path = f"{root}/{stage}/run_date={run_date}/version={version}"
    df.drop(*TRANSIENT).write.parquet(path)
    last = _last(spark, root, stage, run_date)
    row = spark.createDataFrame([(run_date, last["number"] + 1 if last else 1, version)], COMMIT)
    row.coalesce(1).write.mode("append").parquet(f"{root}/{stage}_commits")
    return path


def run_dates(spark: SparkSession, root: str, stage: str) -> list[str]:
    """Dates of the stored snapshots, empty ones included."""
    return sorted(r["run_date"] for r in _commits(spark, root, stage).select("run_date").distinct().collect())


def snapshot_path(spark: SparkSession, root: str, stage: str, run_date: str | None = None) -> str:
    """The folder of the newest snapshot of a stage, or of the one of a date."""
    if run_date is None:
        dates = run_dates(spark, root, stage)
        if not dates:
            raise FileNotFoundError(f"no snapshots of {stage} in {root}")
        run_date = dates[-1]
    last = _last(spark, root, stage, run_date)
    if last is None:
        raise FileNotFoundError(f"no snapshot of {stage} of {run_date} in {root}")
    return f"{root}/{stage}/run_date={run_date}/version={last['version']}"


def replaced_versions(spark: SparkSession, root: str, stage: str) -> list[str]:
    """Folders of committed versions that a later one has replaced; they can be removed once nobody reads them."""
    commits = _commits(spark, root, stage)
    last = commits.groupBy("run_date").agg(F.max(F.struct("number", "version")).alias("last"))
    old = commits.join(last, "run_date").where(F.col("version") != F.col("last.version"))
    return sorted(f"{root}/{stage}/run_date={r['run_date']}/version={r['version']}" for r in old.collect())


def read_latest(spark: SparkSession, root: str, stage: str, run_date: str | None = None) -> DataFrame:
    """The newest snapshot of a stage, or the one of a date; only its files are read."""
    return spark.read.parquet(snapshot_path(spark, root, stage, run_date))
