"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the links; nothing is gathered per node or sent to the
driver but a count and a checksum. Rounds are cut by tables in the shared folder.

A centre with more links than HOT, or than a share of all links that leaves at most 2 * CENTRES such centres, doesn't
meet its links in one task: its least neighbour, found by partial aggregates, is broadcast and joined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import count_rows, cut

HOT = 500
CENTRES = 100_000  # two ends a link: at most twice as many rows of 16 bytes are broadcast


def _with_least(links: DataFrame, hot: int) -> DataFrame:
    """links (u, v) with m, the least v of u."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    few = F.broadcast(least.where(F.col("n") > hot).select("u", "m"))
    spread = links.join(few, "u")
    rest = links.join(few.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hot).select("u", "m"), "u")
    return spread.unionByName(rest)


def _large_star(links: DataFrame, hot: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, hot).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(links: DataFrame, hot: int) -> DataFrame:
    moved = _with_least(links, hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(links.groupBy("u").agg(F.min("v").alias("v")))


def components(links: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root) for every node of links (u, v) but the roots; root: the smallest node reachable."""
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, n = None, count_rows(links)
    while True:
        most = max(hot, n // CENTRES)
        links = cut(_large_star(links, most), "large")
        links = cut(_small_star(links, most).distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = now, now[0]
