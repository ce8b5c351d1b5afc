"""Connected components of a graph that is given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b: longs); label is the smallest node of its component.

    Alternates large-star and small-star steps: each node hands its neighbours to its least
    neighbour, until no link changes. Minima are partially aggregated and written before they meet the links again, so a
    hub's links may be split over tasks. Null ends and self links are ignored; repeats do no harm.
    """
    clean = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(clean, "edges")
    before = _state(edges)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.filter("m < a").select("a", F.col("m").alias("b"))
        stars = materialize(large.unionByName(own).filter("a <> b").distinct(), "edges")
        release(edges, least)
        least = materialize(stars.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = stars.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(stars, least)
        state = _state(edges)
        if state == before:
            break
        before = state
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return labels.unionByName(roots)
