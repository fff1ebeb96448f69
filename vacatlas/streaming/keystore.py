"""A growing set of stored keys that a batch can be compared with, without reading the whole history.

Keys lie in files by batch and bucket, a bucket being a part of the range of a key's hash. Each file has a Bloom filter,
kept in a table of its own, about ten bits for a key. A batch asks the filters of its buckets first, and reads the
files alone whose filter says that one of its keys may be there: for keys that are new, hardly any.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

#: Buckets of a store, bits of a filter for each key, and places that a key has in it.
BUCKETS, BITS, PLACES = 64, 10, 7


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(keys, PLACES): where a key stands in a filter of so many bits."""
    with np.errstate(over="ignore"):
        own = hashes.astype(np.uint64)
        mixed = (own ^ (own >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        mixed = (mixed ^ (mixed >> np.uint64(33))) | np.uint64(1)
        return (own[:, None] + np.arange(PLACES, dtype=np.uint64) * mixed[:, None]) % np.uint64(bits)


def bloom_filter(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(hashes) * BITS // 8) * 8)
    places = _places(hashes, bits).ravel()
    out = np.zeros(bits // 8, np.uint8)
    np.bitwise_or.at(out, (places >> np.uint64(3)).astype(np.int64), (1 << (places & np.uint64(7))).astype(np.uint8))
    return out.tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> bool:
    """Whether a filter may hold any of the keys; never no for one that it was made of."""
    data = np.frombuffer(bloom, np.uint8)
    places = _places(hashes, 8 * len(data))
    hit = data[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)
    return bool((hit & 1).all(axis=1).any())


def key_hash(key: str | Column) -> Column:
    """Null is a key too."""
    return F.xxhash64(key)


def _bucket() -> Column:
    return F.pmod("hash", F.lit(BUCKETS)).cast("int")


class KeyStore:
    """Distinct keys of one column, below ``path``. ``kind`` is the key's type. A batch written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string"):
        self.spark, self.path, self.kind = spark, path, kind

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def filters(self) -> DataFrame:
        return self._read("filters", "bucket int, bloom binary, batch bigint")

    def keys(self) -> DataFrame:
        return self._read("keys", f"key {self.kind}, batch bigint, bucket int")

    def files_for(self, keys: DataFrame, batch: int) -> list[str]:
        """``batch/bucket`` of the files of other batches that may hold one of the keys."""
        asked = keys.select(key_hash("key").alias("hash")).distinct().withColumn("bucket", _bucket())

        def ask(filters: pa.Table, own: pa.Table) -> pa.Table:
            hashes = own["hash"].to_numpy()
            found = [
                f"{b}/{k}" for b, k, bloom in zip(filters["batch"].to_pylist(), filters["bucket"].to_pylist(), filters["bloom"], strict=True)
                if len(hashes) and may_hold(bloom.as_py(), hashes)
            ]
            return pa.table({"file": pa.array(found, pa.string())})

        others = self.filters().where(F.col("batch") != batch)
        met = others.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(ask, "file string")
        return sorted(r["file"] for r in met.collect())

    def known(self, keys: DataFrame, batch: int) -> DataFrame:
        """Stored keys of other batches among which all that equal one of ``keys`` are; most files are not read."""
        files = self.files_for(keys, batch)
        named = F.concat_ws("/", F.col("batch").cast("string"), F.col("bucket").cast("string"))
        return self.keys().where(named.isin(*files) if files else F.lit(False)).select("key")

    def add(self, keys: DataFrame, batch: int) -> None:
        """Store the distinct keys of a batch, each of them one row of ``keys``."""
        hashed = keys.select("key", key_hash("key").alias("hash")).withColumn("bucket", _bucket()).persist()
        try:
            rows = hashed.select("key", "bucket").repartition("bucket")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/keys/batch={batch}")

            def build(table: pa.Table) -> pa.Table:
                bloom = bloom_filter(table["hash"].to_numpy())
                return pa.table({"bucket": table["bucket"][:1], "bloom": pa.array([bloom], pa.binary())})

            made = hashed.groupBy("bucket").applyInArrow(build, "bucket int, bloom binary")
            made.write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")
        finally:
            hashed.unpersist()
