"""Vertex and edge centralities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import BWD, UNREACHABLE, Graph
from loomgraph.operators.paths import all_pairs_distance
from loomgraph.plans.iterate import levels
from loomgraph.runtime import materialise


def degree_centrality(g: Graph) -> DataFrame:
    """(id, score): out-degree as a double."""
    return g.degrees().select("id", F.col("degree").cast("double").alias("score"))


def closeness(g: Graph, unreachable: float = UNREACHABLE) -> DataFrame:
    """(id, score): 1 over the sum of distances d(v, id); every pair without a path adds `unreachable`."""
    n = g.num_vertices()
    got = all_pairs_distance(g).groupBy(F.col("v").alias("id")).agg(F.sum(F.col("dist").cast("double")).alias("total"), F.count("*").alias("k"))
    total = F.col("total") + (F.lit(n) - F.col("k")) * F.lit(float(unreachable))
    return got.select("id", F.when(total > 0, 1.0 / total).otherwise(F.lit(float("inf"))).alias("score"))


def closeness_by(g: Graph, weigh) -> DataFrame:
    """(id, score): the sum of weigh(distance) over what reaches each vertex, for any column expression."""
    return all_pairs_distance(g).groupBy(F.col("v").alias("id")).agg(F.sum(weigh(F.col("dist"))).alias("score"))


def pagerank(g: Graph, rounds: int = 300, damping: float = 0.85, dangling: str = "none", personal: DataFrame | None = None, cut_every: int = 10) -> DataFrame:
    """(id, score) after so many rounds of x = (1 - C) p + C P'x, from x = p.

    p is uniform, or personal(id, prob) with 0 elsewhere. Mass of vertices without out-edges is lost with 'none',
    spread like p with 'uniform', and kept where it is from one round to the next with 'retained', where the first
    round also carries no (1 - C) p term. The state is written every `cut_every` rounds.
    """
    if dangling not in ("none", "uniform", "retained"):
        raise ValueError(f"no such treatment of dangling vertices: {dangling}")
    n = g.num_vertices()
    p = g.vertices.select("id", F.lit(1.0 / n if n else 0.0).alias("p"))
    if personal is not None:
        p = g.vertices.join(personal.toDF("id", "p"), "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))
    out = g.edges.groupBy("src").agg(F.count("*").alias("deg"))
    arcs = materialise(g.edges.select("src", "dst").join(out, "src"), "arcs_with_degree")
    state = p.join(out.select(F.col("src").alias("id"), F.lit(True).alias("has_out")), "id", "left")
    state = materialise(state.select("id", "p", F.coalesce("has_out", F.lit(False)).alias("has_out"), F.col("p").alias("x"), F.lit(0.0).alias("before")), "pagerank")
    for k in range(1, rounds + 1):
        flow = state.select(F.col("id").alias("src"), "x").join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") / F.col("deg")).alias("flow"))
        x = F.col("p") * (1 - damping) + damping * F.coalesce("flow", F.lit(0.0))
        joined = state.join(flow, "id", "left")
        if dangling == "uniform":
            lost = state.where("not has_out").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))
            joined = joined.crossJoin(F.broadcast(lost))  # one row
            x = x + damping * F.col("lost") * F.col("p")
        elif dangling == "retained":
            x = F.when(~F.col("has_out"), F.col("before")).otherwise(0.0) + x if k > 1 else damping * F.coalesce("flow", F.lit(0.0))
        state = joined.select("id", "p", "has_out", x.alias("x"), F.col("x").alias("before"))
        if k % cut_every == 0:
            state = materialise(state, "pagerank")
    return state.select("id", F.col("x").alias("score"))


def edge_betweenness(g: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, score) of each distinct arc: the mean share of shortest paths through it over ordered pairs.

    pairs(s, t, k) are the pairs with how often each was drawn; without them all ordered pairs count, so that the sum
    is divided by n (n - 1). Searches run from the sources and back from the targets; an arc u -> v is met by a pair
    where d(s, u) + 1 + d(v, t) = d(s, t). Pairs without a path count in the divisor.
    """
    simple = g.edges.select("src", "dst").distinct()
    if pairs is None:
        n = g.num_vertices()
        total, ids = n * (n - 1), g.vertices
        ahead = materialise(levels(simple, ids.select(F.col("id").alias("s"), F.col("id").alias("v")), paths=True), "ahead")
        drawn = ahead.where("s <> v").select("s", F.col("v").alias("t"), F.lit(1).alias("k"))
        behind = ahead.select(F.col("v").alias("t"), F.col("s").alias("v"), "dist", "npaths")
    else:
        pairs = materialise(pairs, "pairs")
        total = pairs.agg(F.sum("k")).first()[0] or 0
        drawn = pairs
        ahead = materialise(levels(simple, pairs.select("s", F.col("s").alias("v")).distinct(), paths=True), "ahead")
        behind = materialise(levels(simple, pairs.select(F.col("t").alias("s"), F.col("t").alias("v")).distinct(), BWD, paths=True), "behind").withColumnRenamed("s", "t")
    if not total:
        return simple.withColumn("score", F.lit(0.0))
    goal = ahead.select("s", F.col("v").alias("t"), F.col("dist").alias("whole"), F.col("npaths").alias("all"))
    goal = drawn.join(goal, ["s", "t"])
    legs = goal.join(ahead.select("s", F.col("v").alias("src"), F.col("dist").alias("before"), F.col("npaths").alias("nb")), "s").where("before < whole")
    legs = legs.join(simple, "src").join(behind.select("t", F.col("v").alias("dst"), F.col("dist").alias("after"), F.col("npaths").alias("na")), ["t", "dst"])
    through = legs.where("before + 1 + after = whole").groupBy("src", "dst").agg(F.sum(F.col("k") * F.col("nb") * F.col("na") / F.col("all")).alias("sum"))
    return simple.join(through, ["src", "dst"], "left").select("src", "dst", (F.coalesce("sum", F.lit(0.0)) / total).alias("score"))


def sample_pairs(g: Graph, samples: int = 1000, seed: int = 0) -> DataFrame | None:
    """(s, t, k): ordered pairs drawn with replacement; None (all pairs) where there are no more than `samples`."""
    n = g.num_vertices()
    if n * (n - 1) <= samples:
        return None
    from loomgraph.graph import relabel

    ids = materialise(relabel(g), "ranks")
    draws = g.vertices.sparkSession.range(samples)
    a = F.pmod(F.xxhash64(F.lit(seed), F.lit("s"), "id"), F.lit(n))
    b = F.pmod(F.xxhash64(F.lit(seed), F.lit("t"), "id"), F.lit(n - 1))
    ranks = draws.select(a.alias("rs"), b.alias("rt")).select("rs", (F.col("rt") + (F.col("rt") >= F.col("rs")).cast("int")).alias("rt"))
    rows = ranks.join(ids.select(F.col("id").alias("s"), F.col("new_id").alias("rs")), "rs").join(ids.select(F.col("id").alias("t"), F.col("new_id").alias("rt")), "rt")
    return rows.groupBy("s", "t").agg(F.count("*").alias("k"))


def edge_betweenness_sampled(g: Graph, samples: int = 1000, seed: int = 0) -> DataFrame:
    return edge_betweenness(g, sample_pairs(g, samples, seed))


def merge_directions(scores: DataFrame) -> DataFrame:
    """(src, dst, score) with src <= dst: the scores of both arcs of an undirected edge added."""
    return scores.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("score").alias("score"))
