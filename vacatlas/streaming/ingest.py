"""Postings as a stream of files: the weekly run, made incremental."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.dedup import KEY, among
from ..plans.process import enrich_rows
from ..session import stored, work_path
from .keystore import KeyStore

#: How long a posting counts as recent; also how late one may arrive.
HORIZON = "168 hours"
WEEK = "7 days"
#: Windows are counted from the epoch, a Thursday; this moves them to Sundays.
WEEK_START = "3 days"


def posting_stream(
    spark: SparkSession, path: str, schema: StructType | None = None, names: str | None = None
) -> DataFrame:
    """New Parquet files of a folder, or those whose ``names`` fit; without a schema, that of the files there now."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    return (reader.option("pathGlobFilter", names) if names else reader).parquet(path)


def enrich_stream(df: DataFrame) -> DataFrame:
    """The row-level stages, as in a batch: by row, no state. Descriptions are read in one scan."""
    return enrich_rows(df, "text", "years", "skills")


def with_posted_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("posted_ts", F.col("date_posted").cast("timestamp"))


def dedup_stream(df: DataFrame) -> DataFrame:
    """One posting per url among those of the recency horizon; state beyond it is dropped."""
    return with_posted_ts(df).withWatermark("posted_ts", HORIZON).dropDuplicatesWithinWatermark(["url"])


def weekly_counts(df: DataFrame, by: str, moment: str = "date_posted", start: str = WEEK_START) -> DataFrame:
    """Postings per week, from Sunday, and group: (week, by, n). Works on streams and on tables."""
    stamped = df.withColumn("_ts", F.col(moment).cast("timestamp"))
    if df.isStreaming:
        stamped = stamped.withWatermark("_ts", HORIZON)
    weeks = F.window("_ts", WEEK, startTime=start)
    counts = stamped.groupBy(weeks.alias("_window"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("_window.start").cast("date").alias("week"), by, "n")


def _last_moment(spark: SparkSession, path: str, batch: int) -> datetime | None:
    """The latest event time of all batches before this one, or null."""
    try:
        seen = spark.read.schema("last timestamp, batch bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return seen.where(F.col("batch") < batch).agg(F.max("last").alias("last")).first()["last"]


def run_weekly(
    stream: Callable[[], DataFrame], root: str, by: str, moment: str = "date_posted", delay: str = HORIZON,
    start: str = WEEK_START,
) -> list[dict]:
    """One run over the new files of a stream: closed weeks are added to ``closed`` below ``root``, late rows to ``late``.

    The watermark is the latest event time of all runs before, less ``delay``. A row is late if the watermark has passed
    the end of its week: the week is closed and its state dropped, so the row counts in ``late`` alone. A week is closed,
    and written once, by the run that moves the watermark past its end; until then it is state. So a row is in one of
    closed, late and open weeks. Rows without a moment are in none. Both tables have (week, by, n); one week and group
    can have several rows in ``late``, one for each run. Progress is kept below ``root``, and another call goes on there;
    a run that failed half way is repeated as a whole, in the same batches. Progress reports are returned.

    Rows are counted in the map tasks first, and state holds a row per open week and group, whatever the input.
    """
    counted = stream()
    spark = counted.sparkSession
    stamped = counted.withColumn("_ts", F.col(moment).cast("timestamp"))
    weeks = F.window("_ts", WEEK, startTime=start)

    def note_late(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        counts = rows.groupBy(weeks.alias("_window"), by).agg(F.count("*").alias("n"), F.max("_ts").alias("last")).persist()
        try:
            counts.agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{root}/seen/batch={batch}")
            last = _last_moment(session, f"{root}/seen", batch)
            bound = F.lit(last).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            late = counts.where(F.col("_window.end") <= bound)
            late.select(F.col("_window.start").cast("date").alias("week"), by, "n").write.mode("overwrite").parquet(
                f"{root}/late/batch={batch}"
            )
        finally:
            counts.unpersist()

    first = (
        stamped.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/late_state")
        .foreachBatch(note_late).start()
    )
    first.awaitTermination()
    grouped = stamped.withWatermark("_ts", delay).groupBy(weeks.alias("_window"), by).agg(F.count("*").alias("n"))
    closed = grouped.select(F.col("_window.start").cast("date").alias("week"), by, "n")
    second = (
        closed.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/closed_state")
        .outputMode("append").format("parquet").option("path", f"{root}/closed").start()
    )
    second.awaitTermination()
    return [json.loads(p.json) for p in second.recentProgress]


def drain(
    stream: DataFrame, operator: Callable[[DataFrame], DataFrame], mode: str = "append", path: str | None = None
) -> DataFrame:
    """Run a stream over all files there are and return what it wrote.

    In append mode rows are added to a file sink; in complete mode each batch
    replaces the result.
    """
    spark = stream.sparkSession
    path = path or work_path(spark, "stream-out")
    result = operator(stream)
    writer = result.writeStream.trigger(availableNow=True).option("checkpointLocation", work_path(spark, "stream-state"))
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


def posting_key(df: DataFrame) -> Column:
    """Digest of title, company and location as they came; nulls count as values."""
    return F.md5(F.to_json(F.struct(*(c for c in KEY if c in df.columns))))


def refresh_snapshot(
    stream: DataFrame, root: str, stage: str, order: str = "posting_id", checkpoint: str | None = None,
    build: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Add the new postings of a stream to a stored stage, without duplicates of stored ones.

    Each batch writes its own partition of the stage and of two stores of keys, those seen and the urls kept, replacing
    it if the batch is run again. A batch is first collapsed to one row per key and per url, then compared with the files
    of the stores that may hold one of its keys (see ``keystore``), so that neither side of the comparison has a hot value
    and a long history is not read. The result is that of deduplicating all batches together. Progress is kept beside the
    stage, so that another call goes on where the last one ended.

    A batch reaches Spark's planner as finished rows, so what a stream is made of is moved with them. ``build`` makes the
    postings of a batch of the stream instead: then columns and the choice of rows reach below it, and where it joins wide
    texts, only keys are compared, and texts are read and written without being moved for it. ``build`` goes by row: what
    it makes of all batches together is what it makes of each.
    """
    rows_path = f"{root}/{stage}"

    def refresh(arrived: DataFrame, batch: int) -> None:
        session = arrived.sparkSession
        rows = build(arrived) if build else arrived
        url_kind = dict(rows.dtypes)["url"]
        seen = KeyStore(session, f"{root}/{stage}_keys")
        urls = KeyStore(session, f"{root}/{stage}_urls", url_kind)
        keyed = rows.select(order, posting_key(rows).alias("key"), "url")
        first = keyed.groupBy("key").agg(F.min(order).alias(order), F.min_by("url", order).alias("url"))
        new = stored(first.join(seen.known(first, batch), "key", "left_anti"), "new-keys")
        by_url = new.groupBy(F.col("url").alias("key")).agg(F.min(order).alias(order))
        old = urls.known(by_url, batch).withColumnRenamed("key", "old_url")
        kept = stored(by_url.join(old, F.col("key").eqNullSafe(F.col("old_url")), "left_anti"), "kept-urls")
        fresh = among(rows, order, kept)
        enrich_rows(fresh).write.mode("overwrite").option("compression", "zstd").parquet(f"{rows_path}/batch={batch}")
        seen.add(new, batch)
        urls.add(kept, batch)

    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or f"{root}/{stage}_state")
        .foreachBatch(refresh).start()
    )
    query.awaitTermination()
