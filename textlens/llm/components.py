"""Connected components of a link table, as Spark jobs.

Large-star / small-star contraction: each round points every node's larger
neighbours, then its smaller ones, at the smallest node around.  Both steps
are a grouped minimum (combined before its shuffle, so a hub sends one row per
task) joined back to the links.  The minima are written before the join: a
small table is then broadcast by its measured size, and in a large one a hub's
links can be split by adaptive skew handling.  Rounds are written to the
shared folder, which cuts the lineage, and a round's tables are freed when the
next is written; the driver sees only a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import released, staged


def _large_star(e: DataFrame, paths: list[str]) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lows", paths)
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")


def _small_star(e: DataFrame, paths: list[str]) -> DataFrame:
    low = staged(e.groupBy("a").agg(F.min("b").alias("low")), "lows", paths)
    moved = e.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def _state(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``links``: root is the smallest node
    reachable, a root itself included.  Self links and links with a null end
    are ignored; repeated links and either direction are fine; no links give
    an empty result.  Nodes of any ordered type.
    """
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    last: list[str] = []
    e = staged(e.where("x is not null and y is not null and a > b").select("a", "b").distinct(), "links", last)
    seen = _state(e)
    while seen[0]:
        used, now_at = last, []
        large = staged(_large_star(e, used), "links", used)
        e = staged(_small_star(large, used), "links", now_at)
        now = _state(e)
        released(links.sparkSession, used)  # the round before, and what this one went through
        last = now_at
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
