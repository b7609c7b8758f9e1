"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of undirected ``edges`` of long ids; root is the smallest.

    Rows with a null end and loops are ignored. Each round is joins and minima by
    node; a node with very many neighbours is one row of the minima, and its edges
    are split by the skew handling of the join, as minima are written first.
    No edges give no rows.
    """
    edges = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    state = None
    while True:
        edges = _star(edges, both=True)
        edges = _star(edges, both=False)
        now = edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v"))
        ).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step on edges u > v.

    ``both``: every node's larger neighbours move to the least node near it (large
    star); else its smaller neighbours and itself do (small star).
    """
    ways = edges
    if both:
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(ways.groupBy("u").agg(F.min("v").alias("m")), "least")
    if both:
        moved = (
            ways.filter("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        )
    else:
        moved = edges.join(least, "u").select("v", "m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    result = written(moved.filter("u != v").distinct(), "edges")
    dropped(least)
    dropped(edges)
    return result
