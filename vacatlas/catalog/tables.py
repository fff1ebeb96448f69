"""The supplied tables, and the postings derived from them.

No supplied table holds postings, so they are derived from ``orders`` and
``documents``: one posting per order, its text a whole document, its other
columns read off the order's keys. The SQL below runs unchanged on both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POSTINGS_SQL = """
SELECT
  o.o_orderkey AS posting_id,
  CASE o.o_orderkey % 7
    WHEN 0 THEN 'Data Scientist' WHEN 1 THEN ' Machine Learning Engineer '
    WHEN 2 THEN 'Senior Applied Scientist' WHEN 3 THEN 'Research Scientist II'
    WHEN 4 THEN 'ML Engineer' WHEN 5 THEN 'Data Science Manager' ELSE NULL END AS title,
  CASE WHEN o.o_custkey % 41 = 40 THEN NULL
    ELSE 'Company ' || CAST(o.o_custkey - o.o_custkey % 4 AS VARCHAR(10)) END AS company,
  CASE o.o_orderkey % 16
    WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'San Francisco, CA' WHEN 2 THEN 'Seattle, WA'
    WHEN 3 THEN 'Boston, MA' WHEN 4 THEN 'Los Angeles, CA' WHEN 5 THEN 'Chicago, IL'
    WHEN 6 THEN 'Austin, TX' WHEN 7 THEN 'Washington, DC' WHEN 8 THEN 'Denver, CO'
    WHEN 9 THEN 'Singapore' WHEN 10 THEN 'Hong Kong' WHEN 11 THEN 'Brooklyn, New York'
    WHEN 12 THEN 'Spokane, Washington' WHEN 13 THEN 'Dallas, TX' WHEN 14 THEN '  PALO ALTO  '
    ELSE NULL END AS location,
  '<p>' || d.text || '</p> <b>' ||
  CASE o.o_orderkey % 9
    WHEN 0 THEN 'Build Python and SQL pipelines on Spark, trusted by the team.'
    WHEN 1 THEN 'Computer vision with PyTorch; object detection on AWS S3.'
    WHEN 2 THEN 'LLM fine-tuning, RAG and prompt engineering in Python.'
    WHEN 3 THEN 'Fraud and credit risk models in R, SQL and scikit-learn.'
    WHEN 4 THEN 'A/B testing and causal inference; product analytics metrics.'
    WHEN 5 THEN 'JavaScript and Go services, Kubernetes, Docker, MLOps.'
    WHEN 6 THEN 'Demand forecasting and time series pricing.'
    WHEN 7 THEN 'Storage systems in C++ and Scala.' ELSE '' END || '</b> ' ||
  CASE o.o_orderkey % 11
    WHEN 0 THEN '3-5 years of experience.' WHEN 1 THEN '5+ years of experience.'
    WHEN 2 THEN 'At least 2 years.' WHEN 3 THEN '2 to 4 years experience.'
    WHEN 4 THEN 'Minimum 7 years.' WHEN 5 THEN '10 years relevant.'
    WHEN 6 THEN '5+ years.' WHEN 7 THEN '1 year of exp.'
    WHEN 8 THEN '8+ years of experience or 4-6 years experience with a PhD.'
    WHEN 9 THEN '25+ years of experience.'
    ELSE 'No minimum.' END AS description,
  CASE o.o_orderkey % 6
    WHEN 1 THEN CAST(20 + o.o_orderkey % 80 AS VARCHAR(20))
    WHEN 2 THEN CAST(4000 + o.o_orderkey % 5000 AS VARCHAR(20))
    WHEN 3 THEN '$' || CAST(100 + o.o_orderkey % 90 AS VARCHAR(20)) || ',000'
    WHEN 4 THEN CAST(80000 + o.o_orderkey % 120000 AS VARCHAR(20))
    WHEN 5 THEN 'negotiable' ELSE NULL END AS salary_min,
  CASE o.o_orderkey % 6
    WHEN 1 THEN CAST(40 + o.o_orderkey % 80 AS VARCHAR(20))
    WHEN 2 THEN CAST(5000 + o.o_orderkey % 5000 AS VARCHAR(20))
    WHEN 3 THEN '$' || CAST(130 + o.o_orderkey % 90 AS VARCHAR(20)) || ',000'
    WHEN 4 THEN CAST(110000 + o.o_orderkey % 120000 AS VARCHAR(20))
    ELSE NULL END AS salary_max,
  CASE WHEN o.o_orderkey % 101 = 0 THEN NULL
    WHEN o.o_orderkey % 10 = 9 THEN 'https://jobs.example.com/' || CAST(o.o_orderkey - 1 AS VARCHAR(20))
    ELSE 'https://jobs.example.com/' || CAST(o.o_orderkey AS VARCHAR(20)) END AS url,
  CAST(o.o_orderdate AS DATE) AS date_posted,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'linkedin' ELSE 'indeed' END AS site,
  'Data Scientist' AS search_query,
  'New York, NY' AS search_location
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM documents) AS doc FROM orders) o
JOIN documents d ON d.doc_id = o.doc
"""

#: Words the weighted terms leave out, in the supplied texts.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "it", "that", "this", "for", "on", "with", "as", "by", "at", "from",
    "an", "are", "be", "or", "was", "he", "she", "they", "we", "you", "not", "but", "have", "has", "had",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as its files are split; the session's split size decides, nothing is moved."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filled(df: DataFrame) -> int:
    """Partitions that have rows. Only row counts of the files are read, no column."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that lies in fewer partitions than there are cores, dealt by ``key``; any other one as it is.

    A row group is read by one task, however many splits its file is cut into, so splits that have rows are counted.
    A table of many splits is never small enough to need it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 8 * cores or filled(df) >= cores:
        return df
    return df.repartition(cores, key)


def postings(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> DataFrame:
    """Raw postings over the whole of both tables, or over a stream of orders.

    Each document is the text of many postings, so the documents are spread before the join multiplies them.
    """
    sql = POSTINGS_SQL.replace("FROM orders)", "FROM {orders})").replace("JOIN documents", "JOIN {spread}").replace("documents", "{documents}")
    documents = table(spark, folder, "documents")
    return spark.sql(
        sql, orders=orders or table(spark, folder, "orders"), documents=documents, spread=spread(documents, "doc_id")
    )
