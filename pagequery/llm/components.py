"""Connected components of a link table, by alternating star contractions in DataFrame joins.

Each round replaces the links of every node by links to the smallest neighbour; a node's neighbours are
never gathered: the smallest comes from a partial aggregate and is written first, so the join that hands it out has plain exchanges
on both sides, which Spark splits where a hub is hot. Every round is written to the shared folder, so lineage stays short and a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """links: u > v."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") > F.col("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    """A fingerprint of the link set: equal sets give equal values."""
    r = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")).first()
    return r["n"], r["x"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """links (u, v), in any direction, self-links ignored -> (node, root) for every node that has a link and isn't its component's smallest."""
    turned = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    now = written(turned, "links")
    state = _state(now)
    while state[0]:
        now = written(_small(_large(now)), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
