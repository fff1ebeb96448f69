"""The named queries: each reads the supplied tables whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..dictionaries import CITY_COORDINATES
from ..operators import advice, aggregates as A, clustering as C, enrich as E, filters as B, gazetteer, sketches
from ..operators.dedup import dedup
from ..operators.dictionary import keyword_hits
from ..operators.facts import LABEL_FACTS, kept_facts, skill_rows
from ..operators.vocabulary import most_frequent
from ..plans import report
from ..plans.process import process
from ..session import stored, work_path
from ..sources import postings as S, snapshots
from ..streaming import ingest
from .tables import STOP_WORDS, postings, spread, table

Query = Callable[[SparkSession, str], DataFrame]

#: Groups of postings that stand in for fitted clusters, whose ids are arbitrary.
GROUPS = 9


def processed(spark: SparkSession, folder: str, *read: str) -> DataFrame:
    return process(postings(spark, folder), read=read)


def grouped(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster_id", (F.col("posting_id") % GROUPS).cast("int"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Processed postings with the label of their group, without the texts.

    The enriched rows are stored, as the explorer's table is: a filter on a column then reaches the scan of that
    column, instead of having its expression copied below the stages. Texts are read once, with the label counts.
    """
    df = stored(grouped(processed(spark, folder, "years", "scores")), "processed")
    return C.apply_labels(df, C.label_clusters(df)).drop("_scores")


def _facts_of(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    """Facts of the processed postings by labelled group, counted once. Texts are read for labels and years only."""
    read = ["years"] if {"years_region", *LABEL_FACTS} & set(names) else []
    read += ["scores"] if set(LABEL_FACTS) & set(names) else []

    def counted(spark: SparkSession, folder: str) -> DataFrame:
        return kept_facts(grouped(processed(spark, folder, *read)), *names)

    return counted


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _on(source: Callable[[SparkSession, str], DataFrame], operator: Callable[..., DataFrame], *round_: str, **args):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(operator(source(spark, folder), **args), *round_)

    return query


def _digest(column: str) -> Column:
    return F.md5(F.col(column)).alias(column)


# -- sources ----------------------------------------------------------------

def union_batches(spark: SparkSession, folder: str) -> DataFrame:
    raw = postings(spark, folder).drop("search_query", "search_location")
    batches = [
        (raw.where("site = 'linkedin'").drop("salary_min"), "Data Scientist", "New York, NY"),
        (raw.where("site = 'indeed'").drop("salary_max"), "ML Engineer", "Singapore"),
    ]
    return S.union_batches(batches).select(
        "posting_id", "site", "search_query", "search_location", "salary_min", "salary_max"
    )


def search_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The grid of searches with the number of postings each would have found."""
    found = (
        E.clean_text(postings(spark, folder).select("title", "location"))
        .groupBy("title", "location").agg(F.count("*").alias("found"))
    )
    grid = S.search_grid(spark)
    keys = [grid.title == found.title, grid.location == found.location]
    return grid.join(found, keys, "left").select(
        grid.title, grid.location, "is_us", "country", F.coalesce("found", F.lit(0).cast("bigint")).alias("found")
    )


def standardize(spark: SparkSession, folder: str) -> DataFrame:
    collected = postings(spark, folder).withColumnsRenamed(
        {"company": "company_name", "salary_min": "min_amount", "salary_max": "max_amount", "url": "job_url"}
    ).drop("search_location")
    return S.standardize_columns(collected).withColumn("description", _digest("description"))


def recent(spark: SparkSession, folder: str) -> DataFrame:
    return S.recent(postings(spark, folder), "2001-08-01").select("posting_id", "date_posted")


def snapshot_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Two dated snapshots, the second written twice; the newest one read back."""
    root = work_path(spark, "snapshots")
    rows = normalized(spark, folder).select("posting_id", "salary_min_annual", "salary_max_annual")
    snapshots.write_snapshot(rows.where("salary_max_annual > 100000"), root, "processed_jobs", "2024-01-07")
    snapshots.write_snapshot(rows.where("salary_max_annual > 100000"), root, "processed_jobs", "2024-01-14")
    snapshots.write_snapshot(rows, root, "processed_jobs", "2024-01-14")
    return snapshots.read_latest(spark, root, "processed_jobs")


def typed_load(spark: SparkSession, folder: str) -> DataFrame:
    """Postings through CSV and back: bad numbers and bad skill maps become empty."""
    path = work_path(spark, "csv")
    bad = F.when(F.col("posting_id") % 13 == 0, F.lit("{'python'"))
    skills = F.when(F.col("posting_id") % 3 == 0, F.lit('{"languages": ["python", "sql"], "cloud": ["aws"]}'))
    rows = postings(spark, folder).select(
        "posting_id", "salary_min", "salary_max", F.coalesce(bad, skills).alias("key_skills")
    )
    S.export_csv(rows, path)
    loaded = S.load_typed(spark, path)
    return loaded.select(
        F.col("posting_id").cast("bigint").alias("posting_id"), "salary_min", "salary_max",
        F.coalesce(F.array_join(F.col("key_skills")["languages"], ","), F.lit("")).alias("languages"),
        F.size("key_skills").cast("bigint").alias("categories"),
    )


# -- rows -------------------------------------------------------------------

def dedup_postings(spark: SparkSession, folder: str) -> DataFrame:
    return dedup(postings(spark, folder)).select("posting_id", "title", "company", "location", "url")


def clean_postings(spark: SparkSession, folder: str) -> DataFrame:
    return E.clean_text(postings(spark, folder)).select(
        "posting_id", "title", "company", "location", _digest("description")
    )


def clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").withColumn("description", F.col("html"))
    return E.clean_text(pages).select("page_id", _digest("description"))


def _located(spark: SparkSession, folder: str) -> DataFrame:
    return E.clean_text(postings(spark, folder).select("posting_id", "location"))


def geocode(spark: SparkSession, folder: str) -> DataFrame:
    return E.geocode(_located(spark, folder))


def geocode_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same against a gazetteer that is a table."""
    rows = [(i, city, lat, lon) for i, (city, (lat, lon)) in enumerate(CITY_COORDINATES.items())]
    cities = spark.createDataFrame(rows, "ordinal int, city string, latitude double, longitude double")
    return gazetteer.match_dictionary(
        _located(spark, folder), "location", cities, "city", "ordinal", ["latitude", "longitude"]
    )


def regions(spark: SparkSession, folder: str) -> DataFrame:
    return E.assign_region(_located(spark, folder))


def states(spark: SparkSession, folder: str) -> DataFrame:
    strict = E.assign_state(_located(spark, folder)).withColumnRenamed("state", "state_folded")
    return E.assign_state(strict, case_fold=False)


def yoe(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.clean_text(postings(spark, folder).select("posting_id", "description"))
    return E.extract_years(rows).drop("description")


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return E.normalize_salaries(postings(spark, folder).select("posting_id", "salary_min", "salary_max"))


def _texts(spark: SparkSession, folder: str, *read: str) -> DataFrame:
    rows = dedup(postings(spark, folder)).select("posting_id", "title", "description")
    return E.read_text(rows, *read) if read else E.clean_text(rows)


def skills_long(spark: SparkSession, folder: str) -> DataFrame:
    """A row per posting, category and skill."""
    return skill_rows(_skilled(spark, folder), "posting_id")


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return E.summarize(_texts(spark, folder)).select("posting_id", _digest("summary"))


def responsibilities(spark: SparkSession, folder: str) -> DataFrame:
    found = E.extract_responsibilities(_texts(spark, folder))
    return found.select("posting_id", F.posexplode("responsibilities").alias("position", "item"))


def title_words(spark: SparkSession, folder: str) -> DataFrame:
    return C.title_words(grouped(_texts(spark, folder)), "cluster_id")


# -- filters ----------------------------------------------------------------

_EXPLORED = ["posting_id", "title", "company", "location", "region", "salary_max_annual", "yoe_min", "cluster_label"]


def filters_combined(spark: SparkSession, folder: str) -> DataFrame:
    chosen = B.apply_filters(
        labelled(spark, folder), ["SF Bay Area", "Greater NYC", "Other"],
        ["LLM/GenAI", "Computer Vision", "Fraud Detection/Risk"], (90000.0, 200000.0), (0, 5),
    )
    return B.project_existing(chosen, _EXPLORED)


def region_stats_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Region statistics merged from the sketches of monthly snapshots, taken in one pass over the postings."""
    months = processed(spark, folder).withColumn("month", F.trunc("date_posted", "month"))
    monthly = stored(sketches.market_sketches(months, "month", quantile_size=1 << 15), "monthly-sketches")
    return A.region_stats(monthly, exact=False)


def filter_domain(spark: SparkSession, folder: str) -> DataFrame:
    domain = B.filter_domain(labelled(spark, folder))
    lists = {name: F.array_join(name, "|") for name in ("regions", "categories")}
    return domain.withColumns(lists)


def search_text(spark: SparkSession, folder: str) -> DataFrame:
    return B.search(processed(spark, folder), "Engineer|hong.kong").select("posting_id", "title", "company", "location")


def min_support(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.min_support(processed(spark, folder), "company", "salary_max_annual", min_rows=5, min_group=10)
    return rows.select("posting_id", "company", "salary_max_annual")


def exclude_other(spark: SparkSession, folder: str) -> DataFrame:
    return B.exclude_other(processed(spark, folder)).select("posting_id", "region")


def international(spark: SparkSession, folder: str) -> DataFrame:
    return B.international_points(labelled(spark, folder))


# -- clustering -------------------------------------------------------------

def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Total count, idf and total weight of every term of the vocabulary, over all documents."""
    documents = spread(table(spark, folder, "documents"), "doc_id")
    weights = C.tfidf_weights(documents, "doc_id", "text", stop_words=STOP_WORDS)
    totals = weights.groupBy("term").agg(
        F.sum("n").alias("n"), F.max("idf").alias("idf"), F.sum("weight").alias("weight")
    )
    return rounded(totals, "idf", "weight")


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The 5,000 most frequent terms of all documents, by summaries that overflow on larger tables, and an exact recount."""
    return C.vocabulary(spread(table(spark, folder, "documents"), "doc_id"), "text", stop_words=STOP_WORDS, capacity=1 << 14)


def keyword_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and occurrences of each keyword of a large dictionary, the most frequent long words of the documents."""
    documents = spread(table(spark, folder, "documents"), "doc_id")
    longer = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3)
    words = [r["term"] for r in most_frequent(documents.select(longer.alias("w")), "w", 2000).collect()]
    hits = keyword_hits(documents.select("doc_id", "text"), "text", words).select(F.explode("hits").alias("hit"))
    return hits.groupBy(F.col("hit.word").alias("word")).agg(F.count("*").alias("documents"), F.sum("hit.n").alias("n"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return C.embed_column(table(spark, folder, "embeddings").where("embedding IS NOT NULL"), "embedding")


def _first_vectors(vectors: DataFrame, n: int) -> np.ndarray:
    """Given centres: the vectors of the n least ids."""
    return np.array([r["embedding"].toArray() for r in vectors.orderBy("vec_id").limit(n).collect()])


def kmeans_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Three steps of Lloyd's iteration from given centres: rows, least and greatest id of each cluster, and the cost of all."""
    vectors = _vectors(spark, folder)
    model = C.fit_kmeans(vectors, "vec_id", 10, initial=_first_vectors(vectors, 10), iterations=3, tolerance=0.0)
    found = model.transform(vectors.select("vec_id", "embedding")).groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last")
    )
    return rounded(found.withColumn("cost", F.lit(float(model.cost))), "cost")


def choose_k(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of clusters with their Euclidean silhouettes over all rows, after two steps from given centres."""
    vectors = _vectors(spark, folder)
    k, _, scores = C.choose_k(
        vectors, "vec_id", sample=None, initial=_first_vectors(vectors, 15), iterations=2, tolerance=0.0
    )
    rows = [(number, round(float(score), 6), number == k) for number, score in sorted(scores.items())]
    return spark.createDataFrame(rows, "k int, score double, chosen boolean")


def silhouette_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouettes by Euclidean distance of every row, in pairs of blocks."""
    rows = table(spark, folder, "embeddings")
    widths = C.euclidean_silhouette(rows, "vec_id", "embedding", ["label"])
    return rounded(widths.select("vec_id", F.col("label").cast("int").alias("label"), "width"), "width")


def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    widths = C.silhouette(_vectors(spark, folder), "vec_id", "embedding", "label")
    return rounded(widths, "width")


def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = C.label_clusters(grouped(_texts(spark, folder, "scores")))
    return C.apply_labels(grouped(_texts(spark, folder)), labels).groupBy("cluster_id", "cluster_label").agg(
        F.count("*").alias("n")
    )


def cluster_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Postings clustered by TF-IDF of their descriptions: sizes per label."""
    found = C.cluster(stored(_texts(spark, folder, "text", "scores"), "texts"))
    return found.groupBy("cluster_id", "cluster_label").agg(F.count("*").alias("n"))


# -- advice and report ------------------------------------------------------

def _skilled(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, "skills")


def _skill_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Counted skills of the postings, kept: one pass for all rankings."""
    return kept_facts(_skilled(spark, folder), "skill")


def skilled_market(spark: SparkSession, folder: str) -> DataFrame:
    """Processed postings with skills and groups, for the advice and the report."""
    return grouped(processed(spark, folder, "years", "scores", "skills"))


def suggestions(spark: SparkSession, folder: str) -> DataFrame:
    return advice.suggestions(kept_facts(skilled_market(spark, folder)))


def report_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The number of rows of each table of the written report."""
    written = report.write_report(skilled_market(spark, folder), work_path(spark, "report"), "2024-01-14")
    counts = [
        spark.read.parquet(path).agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        for name, path in written.items()
    ]
    union = counts[0]
    for part in counts[1:]:
        union = union.unionByName(part)
    return union


# -- streams ----------------------------------------------------------------

def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.drain(_raw_stream(spark, folder), ingest.enrich_stream).select(
        "posting_id", "region", "state", "yoe_min", "salary_max_annual"
    )


def _raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw postings as orders come in; the documents are a fixed table. No copy is written."""
    return postings(spark, folder, _order_stream(spark, folder))


def _order_stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/orders.parquet"
    orders = spark.read.parquet(path)
    if [file.rpartition("/")[2] for file in orders.inputFiles()] == ["orders.parquet"]:  # a file, streamed from its folder
        path = folder
    return ingest.posting_stream(spark, path, orders.schema, "orders.parquet" if path == folder else None)


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Postings kept per url. Only ids and urls are written, so the texts are neither moved nor stored."""

    def kept(df: DataFrame) -> DataFrame:
        return ingest.dedup_stream(df).select("posting_id", "url")

    return ingest.drain(_raw_stream(spark, folder), kept).groupBy("url").agg(F.count("*").alias("n"))


def stream_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    root = work_path(spark, "refreshed")
    ingest.refresh_snapshot(
        _order_stream(spark, folder), root, "processed_jobs",
        build=lambda orders: postings(orders.sparkSession, folder, orders),
    )
    return spark.read.parquet(f"{root}/processed_jobs").select("posting_id", "region", "salary_max_annual")


def weekly_counts(spark: SparkSession, folder: str) -> DataFrame:
    def counts(df: DataFrame) -> DataFrame:
        return ingest.weekly_counts(E.assign_region(E.clean_text(df)), "region")

    return ingest.drain(_raw_stream(spark, folder), counts, mode="complete")


#: Every tenth posting arrives so many days after its date.
DELAYED, DELAY_DAYS = 10, 550


def weekly_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Weeks closed by the watermark, and late rows apart, of postings that arrive in yearly runs, some much delayed."""
    root = work_path(spark, "weekly")
    rows = E.assign_region(E.clean_text(postings(spark, folder).select("posting_id", "location", "date_posted")))
    delay = F.when(F.col("posting_id") % DELAYED == 0, DELAY_DAYS).otherwise(0)
    arrived = stored(
        rows.select("date_posted", "region", F.year(F.date_add("date_posted", delay)).alias("run")), "arrivals"
    )
    runs = [r.run for r in arrived.where(F.col("run").isNotNull()).select("run").distinct().orderBy("run").collect()]
    for run in runs:
        arrived.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{root}/in")
        ingest.run_weekly(lambda: ingest.posting_stream(spark, f"{root}/in", arrived.drop("run").schema), root, "region")
    schema = "week date, region string, n bigint"
    kinds = [
        spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/{kind}").select(F.lit(kind).alias("kind"), "*")
        for kind in ("closed", "late")
    ]
    return kinds[0].unionByName(kinds[1]).groupBy("kind", "week", "region").agg(F.sum("n").alias("n"))


def weekly_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts over the events, in one batch."""
    events = table(spark, folder, "events")
    return ingest.weekly_counts(events, "event_type", "ts")


QUERIES: dict[str, Query] = {
    # sources
    "union_batches": union_batches,
    "search_grid": search_grid,
    "standardize": standardize,
    "recent": recent,
    "snapshot_roundtrip": snapshot_roundtrip,
    "typed_load": typed_load,
    # rows
    "dedup_postings": dedup_postings,
    "clean_postings": clean_postings,
    "clean_pages": clean_pages,
    "geocode": geocode,
    "geocode_table": geocode_table,
    "regions": regions,
    "states": states,
    "yoe": yoe,
    "salary_annual": normalized,
    "skills_long": skills_long,
    "summaries": summaries,
    "responsibilities": responsibilities,
    "title_words": title_words,
    "keyword_dictionary": keyword_dictionary,
    # filters
    "filters_combined": filters_combined,
    "filter_domain": filter_domain,
    "search_text": search_text,
    "min_support": min_support,
    "international": international,
    "exclude_other": exclude_other,
    # statistics
    "kpis": _on(_facts_of("company", "category", "salary_region", "years_region"), A.kpis),
    "category_counts": _on(_facts_of("category"), A.category_counts),
    "category_share": _on(_facts_of("category"), A.category_share, "share"),
    "top_companies": _on(processed, A.top_companies),
    "state_counts": _on(processed, A.state_counts),
    "region_counts": _on(processed, A.region_counts),
    "region_stats": _on(processed, A.region_stats, "median_salary", "median_yoe"),
    "region_stats_sketched": region_stats_sketched,
    "region_report": _on(processed, A.region_report, "avg_salary", "avg_yoe"),
    "cluster_summary": _on(
        _facts_of("category", "floor_category", "salary_category", "years_category"),
        A.cluster_summary, "pct", "avg_salary_min", "avg_salary_max", "avg_yoe",
    ),
    "salary_stats": _on(processed, A.salary_stats, "p25", "median", "p75", "mean"),
    "salary_benchmarks": _on(processed, A.salary_benchmarks, "median", "p75", "p90"),
    "median_salary_rank": _on(_facts_of("salary_category"), A.median_salary_rank, "median_salary"),
    "median_salary_by_region": _on(processed, A.median_salary_rank, "median_salary", by="region"),
    "box_stats_region": _on(processed, A.box_stats, "q1", "median", "q3", fact="salary_region", with_other=False),
    "box_stats_region_all": _on(processed, A.box_stats, "q1", "median", "q3", fact="salary_region"),
    "box_stats_cluster": _on(
        _facts_of("salary_category"), A.box_stats, "q1", "median", "q3", fact="salary_category"
    ),
    "box_yoe_cluster": _on(
        _facts_of("years_category"), A.box_stats, "q1", "median", "q3", fact="years_category"
    ),
    "yoe_histogram": _on(_facts_of("years_region"), A.yoe_histogram, "median"),
    "salary_histogram": _on(_facts_of("salary_region"), A.histogram, "low", "high"),
    "years_histogram": _on(_facts_of("years_region"), A.histogram, "low", "high", fact="years_region", bins=20),
    "salary_histogram_readable": _on(_facts_of("salary_region"), A.readable_histogram, "low", "high"),
    "years_histogram_readable": _on(
        _facts_of("years_region"), A.readable_histogram, "low", "high", fact="years_region", bins=20
    ),
    "yoe_kpis": _on(_facts_of("years_region"), A.yoe_kpis, "median", "entry_pct"),
    "yoe_bands": _on(_facts_of("years_region"), A.yoe_bands, "median", "entry_pct"),
    "crosstab_wide": _on(
        _facts_of("category"), A.crosstab_wide, labels=["LLM/GenAI", "Computer Vision", "Fraud Detection/Risk"]
    ),
    "crosstab_long": _on(_facts_of("category"), A.crosstab_long),
    "skill_frequency": _on(_skilled, A.skill_frequency),
    "top_skills": _on(_skilled, A.top_skills),
    "top_skills_by_category": _on(_skilled, A.top_skills_by_category),
    "skill_gaps": _on(_skill_facts, advice.skill_gaps),
    "category_trends": _on(_facts_of("category"), A.category_trends, "pct"),
    "geo_trends": _on(processed, A.geo_trends),
    "city_density": _on(processed, A.city_density),
    "map_centre": _on(processed, A.map_centre, "latitude", "longitude"),
    "cluster_density": _on(_facts_of("place"), A.cluster_density),
    # clustering
    "tfidf_weights": tfidf_weights,
    "kmeans_embeddings": kmeans_embeddings,
    "choose_k": choose_k,
    "silhouette": silhouette,
    "silhouette_euclidean": silhouette_euclidean,
    "vocabulary": vocabulary,
    "cluster_labels": cluster_labels,
    "cluster_postings": cluster_postings,
    # advice and report
    "suggestions": suggestions,
    "report_tables": report_tables,
    # streams
    "stream_ingest": stream_ingest,
    "stream_dedup": stream_dedup,
    "stream_snapshot": stream_snapshot,
    "weekly_counts": weekly_counts,
    "weekly_closed": weekly_closed,
    "weekly_events": weekly_events,
}
