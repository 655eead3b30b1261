"""Connected components of a graph that is a table of links, by alternating stars.

Each round hangs larger neighbours on the smallest one (large star) and then smaller neighbours on the
smallest of those (small star), until nothing changes; the number of rounds grows with the logarithm
of the graph. Rounds are written to the shared folder, so a lost executor costs one step. Only a count
and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.durable import written_once


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a < b, after one half round."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The centre's smallest neighbour, itself included; minima combine before they are moved.
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    asked = both if large else links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    joined = asked.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        moved = joined.select(F.col("m").alias("a"), "b").unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return moved.where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in links (a, b): the smallest node it can reach.

    Links may be in any direction, repeated or from a node to itself; no links give no rows.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = written_once(ordered, "links")
    before = None
    while (state := _checksum(now)) != before and state[0]:
        before = state
        now = written_once(_star(_star(now, True), False), "links")
    # What is left are stars on the smallest node.
    return nodes.join(now.select(F.col("b").alias("node"), F.col("a").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
