"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MOST_ROUNDS = 60


def _kept(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder, so that a lost executor costs no earlier round."""
    from ..session import shared_folder

    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): the least id its links reach.

    Large-star and small-star rounds: every id points its larger, then its other neighbours at the least id near it,
    until nothing changes. No round has more links than the input, the least neighbour is combined before it is
    shuffled, and an id of many links is split by the join it goes through. Links of an id to itself, repeated links
    and null ends count for nothing; an empty table gives none.
    """
    edges = _kept(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct()
    )
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        # large-star: the larger neighbours of an id point at the least of it and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
        # small-star: the smaller neighbours of an id, and it, point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = (
            large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        )
        edges = _kept(small)
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        edges.select(F.col("b"), F.col("b"))
    ).distinct()
