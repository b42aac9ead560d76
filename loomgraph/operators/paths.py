"""Shortest paths: single source, all pairs, path counts, visits, diameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import FWD, UNREACHABLE, Graph
from loomgraph.plans.iterate import levels, relax
from loomgraph.runtime import materialise


def _start(g: Graph, s: int) -> DataFrame:
    return g.vertices.where(F.col("id") == s).select(F.col("id").alias("s"), F.col("id").alias("v"))


def _starts(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("s"), F.col("id").alias("v"))


def _distances(g: Graph, starts: DataFrame, direction: str, eps: float) -> DataFrame:
    return relax(g.edges, starts, direction, eps) if g.weighted else levels(g.edges, starts, direction)


def single_source_distance(g: Graph, s: int, direction: str = FWD, unreachable=UNREACHABLE, eps: float = 1e-9) -> DataFrame:
    """(v, dist) for all vertices; those not reached have `unreachable` (infinity where the graph is weighted)."""
    far = float("inf") if g.weighted and unreachable == UNREACHABLE else unreachable
    found = _distances(g, _start(g, s), direction, eps)
    return g.vertices.select(F.col("id").alias("v")).join(found.select("v", "dist"), "v", "left").select("v", F.coalesce("dist", F.lit(far)).alias("dist"))


def all_pairs_distance(g: Graph, direction: str = FWD, sources: DataFrame | None = None, eps: float = 1e-9) -> DataFrame:
    """(s, v, dist) for the pairs that have a path, from all vertices or from sources(id)."""
    return _distances(g, _starts(g.vertices if sources is None else sources), direction, eps)


def single_source_path_counts(g: Graph, s: int, direction: str = FWD) -> DataFrame:
    """(v, dist, npaths): hops and number of shortest paths; (UNREACHABLE, 0) where there is none."""
    found = levels(g.edges, _start(g, s), direction, paths=True)
    rows = g.vertices.select(F.col("id").alias("v")).join(found.drop("s"), "v", "left")
    return rows.select("v", F.coalesce("dist", F.lit(UNREACHABLE)).alias("dist"), F.coalesce("npaths", F.lit(0.0)).alias("npaths"))


def all_pairs_path_counts(g: Graph, direction: str = FWD, sources: DataFrame | None = None) -> DataFrame:
    return levels(g.edges, _starts(g.vertices if sources is None else sources), direction, paths=True)


def visit_by_distance(g: Graph, s: int, expand: Callable[[Column, Column], Column], direction: str = FWD) -> DataFrame:
    """(v, dist) of the vertices met from s; where expand(v, dist) is false the search does not go on from v."""
    return levels(g.edges, _start(g, s), direction, expand=expand).select("v", "dist")


def eccentricities(g: Graph, direction: str = FWD, sources: DataFrame | None = None) -> DataFrame:
    """(id, ecc): the largest finite distance from each source."""
    return all_pairs_distance(g, direction, sources).groupBy(F.col("s").alias("id")).agg(F.max("dist").alias("ecc"))


def diameter(g: Graph, sweeps: int = 4, batch: int = 256) -> DataFrame:
    """One row (diameter): the largest finite directed distance; null for no vertices.

    Double sweeps give a lower bound. Within a strongly connected component ecc(v) <= d(v, c) + ecc(c) for a swept
    centre c, so only vertices whose bound is above the best distance so far are searched from, in batches.
    """
    spark = g.vertices.sparkSession
    kind = "double" if g.weighted else "int"
    if g.num_vertices() <= batch:  # one batch holds all sources
        return all_pairs_distance(g).agg(F.max("dist").alias("diameter"))
    hub = g.degrees().orderBy(F.desc("degree"), "id").first()
    best, bound, at = 0, None, hub["id"]
    for _ in range(sweeps):
        there = _distances(g, _start(g, at), FWD, 1e-9)
        top = there.orderBy(F.desc("dist"), "v").first()
        best = max(best, top["dist"])
        # ecc(v) <= d(v, at) + ecc(at) for v that reaches `at` and is reached from it
        back = _distances(g, _start(g, at), "bwd", 1e-9).select("v", F.col("dist").alias("to"))
        own = back.join(there.select("v"), "v").select(F.col("v").alias("id"), (F.col("to") + F.lit(top["dist"])).alias("bound"))
        bound = own if bound is None else bound.union(own)
        if top["v"] == at:
            break
        at = top["v"]
    bound = bound.groupBy("id").agg(F.min("bound").alias("bound"))
    rest = g.vertices.join(bound, "id", "left")
    while True:
        todo = rest.where(F.col("bound").isNull() | (F.col("bound") > F.lit(best))).orderBy(F.desc_nulls_first("bound"), "id").limit(batch).select("id")
        todo = materialise(todo, "sweep")
        if todo.isEmpty():
            return spark.createDataFrame([(best,)], f"diameter {kind}")
        found = all_pairs_distance(g, sources=todo).agg(F.max("dist")).first()[0]
        best = max(best, found or 0)
        rest = materialise(rest.join(todo, "id", "left_anti"), "unswept")
