"""Level-synchronous searches: one planned job for each level, the levels written in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import FWD, improved, oriented
from loomgraph.runtime import materialise


def levels(edges: DataFrame, starts: DataFrame, direction: str = FWD, max_depth: int | None = None, expand: Callable[[Column, Column], Column] | None = None, paths: bool = False) -> DataFrame:
    """Breadth-first search from starts(s, v): (s, v, dist), and npaths (double) with paths=True.

    Every s searches on its own. `expand(v, dist)` may be false for vertices whose out-edges are not to be followed;
    they are still visited. Parallel edges count as several paths.
    """
    arcs = oriented(edges, direction).select(F.col("src").alias("v"), F.col("dst").alias("w"))
    keep = ["s", "v", "dist", *(["npaths"] if paths else [])]
    first = starts.select("s", "v", F.lit(0).alias("dist"), F.lit(1.0).alias("npaths")).select(*keep)
    front = materialise(first, "level")
    seen, found, depth = front.select("s", "v"), front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        grow = front if expand is None else front.where(expand(F.col("v"), F.col("dist")))
        step = grow.join(arcs, "v").groupBy("s", F.col("w").alias("v"))
        step = step.agg(F.sum("npaths").alias("npaths")) if paths else step.agg(F.lit(0).alias("z"))
        front = materialise(step.join(seen, ["s", "v"], "left_anti").withColumn("dist", F.lit(depth)).select(*keep), "level")
        if front.isEmpty():
            break
        seen, found = seen.union(front.select("s", "v")), found.union(front)
    return found


def relax(edges: DataFrame, starts: DataFrame, direction: str = FWD, eps: float = 1e-9, max_rounds: int = 100_000) -> DataFrame:
    """Weighted distances from starts(s, v): (s, v, dist) for what is reached; weights must not be negative.

    Rounds of relaxation over the vertices that improved in the last one, until none improves by more than eps.
    """
    if not edges.where("weight < 0").isEmpty():
        raise ValueError("a weight is negative")
    arcs = oriented(edges, direction).select(F.col("src").alias("v"), F.col("dst").alias("w"), "weight")
    best = materialise(starts.select("s", "v", F.lit(0.0).alias("dist"), F.lit(True).alias("new")), "relaxed")
    for _ in range(max_rounds):
        step = best.where("new").join(arcs, "v").groupBy("s", F.col("w").alias("v")).agg(F.min(F.col("dist") + F.col("weight")).alias("reach"))
        both = best.drop("new").join(step, ["s", "v"], "full")
        better = F.col("reach").isNotNull() & (F.col("dist").isNull() | improved(F.col("reach"), F.col("dist"), eps))
        best = materialise(both.select("s", "v", F.when(better, F.col("reach")).otherwise(F.col("dist")).alias("dist"), better.alias("new")), "relaxed")
        if best.where("new").isEmpty():
            return best.select("s", "v", "dist")
    raise RuntimeError("the distances did not settle")
