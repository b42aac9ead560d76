"""Triangles, wedges and clustering coefficients of the simple undirected graph beneath a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, make_undirected, to_directed


def triangles(g: Graph) -> DataFrame:
    """(a, b, c) of each triangle once.

    Edges point from the end of lower degree (ties: lower id) to the other, which bounds the wedges at hubs by the
    square root of the number of edges.
    """
    simple = to_directed(g.edges)
    degree = make_undirected(simple).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    rows = simple.join(degree.toDF("src", "ds"), "src").join(degree.toDF("dst", "dd"), "dst")
    turn = (F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") > F.col("dst")))
    arcs = rows.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("x"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("y"))
    first, second, closing = arcs.toDF("a", "b"), arcs.toDF("a", "c"), arcs.toDF("b", "c")
    wedges = first.join(second, "a").where("b <> c")
    return wedges.join(closing, ["b", "c"]).select("a", "b", "c")


def local_triangles_and_wedges(g: Graph) -> DataFrame:
    """(id, triangles, open_wedges) for every vertex: triangles through it, and open wedges centred at it."""
    corners = triangles(g).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    degree = make_undirected(to_directed(g.edges)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    rows = g.vertices.join(degree, "id", "left").join(corners, "id", "left")
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    return rows.select("id", t.alias("triangles"), ((d * (d - 1) / 2).cast("long") - t).alias("open_wedges"))


def triangles_and_wedges(g: Graph) -> DataFrame:
    """One row (triangles, open_wedges)."""
    total = local_triangles_and_wedges(g).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("t"), F.coalesce(F.sum("open_wedges"), F.lit(0)).alias("w"))
    return total.select((F.col("t") / 3).cast("long").alias("triangles"), F.col("w").alias("open_wedges"))


def local_clustering(g: Graph) -> DataFrame:
    """(id, score): triangles over pairs of neighbours, 0 below two neighbours."""
    rows = local_triangles_and_wedges(g)
    pairs = F.col("triangles") + F.col("open_wedges")
    return rows.select("id", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0).alias("score"))


def average_clustering(g: Graph) -> DataFrame:
    """One row (score): the mean over all vertices, NaN where there are none."""
    return local_clustering(g).agg(F.coalesce(F.avg("score"), F.lit(float("nan"))).alias("score"))


def global_clustering(g: Graph, definition: str = "reference") -> DataFrame:
    """One row (score): T / (T + open wedges), or with 'transitivity' 3T / (3T + open wedges); NaN where both are 0."""
    k = {"reference": 1, "transitivity": 3}[definition]
    rows = triangles_and_wedges(g)
    t = F.col("triangles") * k
    whole = t + F.col("open_wedges")
    return rows.select(F.when(whole > 0, t / whole).otherwise(F.lit(float("nan"))).alias("score"))
