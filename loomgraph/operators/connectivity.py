"""Components of graphs as DataFrame loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import BWD, Graph, relabel, to_directed
from loomgraph.plans.iterate import levels
from loomgraph.runtime import discard, materialise, spread


def _forests(batches):
    """Contract the edges of each batch to a forest: (vertex, least vertex it reaches in the batch); loops stay."""
    for batch in batches:
        u, v = (batch.column(k).to_numpy() for k in (0, 1))
        if not len(u):
            continue
        ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = flat[: len(u)], flat[len(u) :]
        label = np.arange(ids.size)
        while True:  # least labels along edges, then along labels
            new = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = np.minimum(new, label)[np.minimum(new, label)]
            if (new == label).all() and (label[a] == label[b]).all():
                break
            label = new
        loop = np.zeros(ids.size, bool)
        loop[a[a == b]] = True
        own = np.flatnonzero((label != np.arange(ids.size)) | loop)
        yield pa.record_batch([pa.array(ids[own]), pa.array(ids[label[own]])], names=["u", "v"])


def _at_once(batches):
    """All components of the edges of one task: (id, component)."""
    rows = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    label: dict[int, int] = {}
    for batch in _forests(rows.combine_chunks().to_batches()):
        label |= dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    ids = pa.compute.unique(pa.chunked_array([*rows["u"].chunks, *rows["v"].chunks], pa.int64()))
    yield pa.record_batch([ids, pa.array([label.get(i, i) for i in ids.to_pylist()], pa.int64())], names=["id", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = 50_000) -> DataFrame:
    """(id, component): the weak component of every endpoint of edges(src, dst), named by its least id.

    Alternating large-star and small-star rounds, each written in the shared folder; tasks first contract their own
    edges, so what is shuffled is a forest of each. The number of rounds grows with the logarithm of the largest
    component. Forests of at most `small` edges are joined in one task. Loops are allowed; null endpoints are not.
    """
    pairs = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    first = materialise(pairs.mapInArrow(_forests, "u long, v long").distinct(), "components")
    if small and first.count() <= small:
        return materialise(first.repartition(1).mapInArrow(_at_once, "id long, component long"), "components")
    loops, now = first.where("u = v").select("u"), first.where("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.where("u > v").distinct()
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialise(small.where("u <> v").distinct(), "components")
        mark = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        discard(now)
        now = new
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("id")).union(loops.select(F.col("u").alias("id"))).distinct().join(now.select(F.col("u").alias("id")), "id", "left_anti")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def is_connected(g: Graph) -> DataFrame:
    """One row (connected): whether every vertex is reached forward from the one of least id; true for no vertices."""
    first = g.vertices.agg(F.min("id").alias("id")).where("id is not null")
    reached = levels(g.edges, first.select(F.col("id").alias("s"), F.col("id").alias("v")))
    n = g.vertices.agg(F.count("*").alias("n"))
    return reached.agg(F.count("*").alias("k")).crossJoin(n).select((F.col("k") == F.col("n")).alias("connected"))  # one row each


def strongly_connected_components(g: Graph, max_rounds: int = 100_000) -> DataFrame:
    """(id, component, round): components named by their least id.

    Each round first trims vertices without in- or out-edges among the rest, then gives every vertex the least id
    that reaches it, and takes as the component of that id what reaches it within its colour.
    """
    rest = materialise(g.vertices.select("id"), "scc_rest")
    arcs = materialise(g.edges.where("src <> dst").select("src", "dst").distinct(), "scc_arcs")
    done = None

    def add(rows):
        nonlocal done
        done = rows if done is None else done.union(rows)

    for k in range(max_rounds):
        if rest.isEmpty():
            break
        ends = arcs.select(F.col("src").alias("id")).intersect(arcs.select(F.col("dst").alias("id")))
        alone = materialise(rest.join(ends, "id", "left_anti"), "scc_alone")
        if not alone.isEmpty():
            add(alone.select("id", F.col("id").alias("component"), F.lit(k).alias("round")))
            rest = materialise(rest.join(alone, "id", "left_anti"), "scc_rest")
            arcs = materialise(arcs.join(alone.select(F.col("id").alias("src")), "src", "left_anti").join(alone.select(F.col("id").alias("dst")), "dst", "left_anti"), "scc_arcs")
            continue
        colour = materialise(rest.select("id", F.col("id").alias("c"), F.lit(True).alias("new")), "scc_colour")
        while not colour.where("new").isEmpty():
            got = colour.where("new").select(F.col("id").alias("src"), "c").join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            lower = F.col("m").isNotNull() & (F.col("m") < F.col("c"))
            colour = materialise(colour.drop("new").join(got, "id", "left").select("id", F.when(lower, F.col("m")).otherwise(F.col("c")).alias("c"), F.coalesce(lower, F.lit(False)).alias("new")), "scc_colour")
        same = arcs.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        roots = colour.where("id = c").select(F.col("id").alias("s"), F.col("id").alias("v"))
        found = materialise(levels(materialise(same, "scc_same"), roots, BWD).select(F.col("v").alias("id"), F.col("s").alias("component")), "scc_found")
        add(found.select("id", "component", F.lit(k).alias("round")))
        rest = materialise(rest.join(found, "id", "left_anti"), "scc_rest")
        gone = found.select("id")
        arcs = materialise(arcs.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"), "scc_arcs")
    if done is None:
        return g.vertices.select("id", F.col("id").alias("component"), F.lit(0).alias("round")).limit(0)
    return done


def largest_component(g: Graph) -> Graph:
    """The largest weak component (ties: the one of the least id), its ids made dense in ascending order."""
    found = connected_components(g.edges)
    named = g.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    named = materialise(named, "components")
    best = named.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    ids = materialise(relabel(Graph(named.join(best, "component", "left_semi").select("id"), g.edges)), "dense")
    arcs = g.edges.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst")
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    return Graph(ids.select(F.col("new_id").alias("id")), arcs.select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest))


def by_component(g: Graph, kernel, schema: str, most_edges: int = 5_000_000) -> DataFrame:
    """Run kernel(pairs) -> pandas frame on the simple undirected edges of each weak component, one task each.

    For kernels that are sequential by nature. A component of more than `most_edges` edges fails loudly.
    """
    simple = materialise(to_directed(g.edges), "simple_edges")
    found = connected_components(simple)
    rows = simple.join(found.select(F.col("id").alias("src"), "component"), "src")
    rows = materialise(rows.select("component", "src", "dst"), "component_edges")
    if not rows.groupBy("component").count().where(F.col("count") > most_edges).isEmpty():
        raise ValueError(f"a component has more than {most_edges} edges")

    def run(pdf):
        pairs = sorted(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))
        return kernel(int(pdf["component"].iloc[0]), pairs)

    return spread(rows, "component").groupBy("component").applyInPandas(run, schema)


def low_links(pairs: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """The bridges of a simple undirected graph, by a depth-first search without recursion."""
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    out = set()
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(near[root]))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w == parent:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(near[w])))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > order[parent]:
                        out.add((min(v, parent), max(v, parent)))
    return out


def _covered_tree_edges(simple: DataFrame, roots: DataFrame) -> DataFrame:
    """The bridges (src, dst) of components too large for a task, by random labels on a breadth-first tree.

    Every edge outside the tree gets 128 random bits, a vertex the exclusive or of its edges' bits, and a subtree that
    of its vertices: what covers the edge above it. That is zero for bridges, and for others with probability 2^-128. Labels
    go up the tree level by level; each level is one aggregation, so no task holds a component.
    """
    both = materialise(simple.select("src", "dst").union(simple.select("dst", "src")), "both_arcs")
    depth = materialise(levels(both, roots.select(F.col("id").alias("s"), F.col("id").alias("v"))).select(F.col("v").alias("id"), F.col("dist").alias("depth")), "tree_depths")
    above = both.join(depth.toDF("src", "ds"), "src").join(depth.toDF("dst", "dd"), "dst").where("ds = dd + 1")
    tree = materialise(above.groupBy(F.col("src").alias("id"), F.col("ds").alias("depth")).agg(F.min("dst").alias("up")), "tree")
    tree_edges = tree.select(F.least("id", "up").alias("src"), F.greatest("id", "up").alias("dst"))
    rest = simple.join(tree_edges, ["src", "dst"], "left_anti")
    bits = [F.xxhash64(F.lit(side), "src", "dst").alias(f"b{side}") for side in (11, 12)]
    ends = rest.select(F.explode(F.array("src", "dst")).alias("id"), *bits)
    own = ends.groupBy("id").agg(F.expr("bit_xor(b11)").alias("b11"), F.expr("bit_xor(b12)").alias("b12"))
    left = materialise(tree.join(own, "id", "left").na.fill(0, ["b11", "b12"]), "labels")
    found, carried = None, None
    for d in range(left.agg(F.max("depth")).first()[0] or 0, 0, -1):
        here = left.where(F.col("depth") == d).select("id", "up", "b11", "b12")
        if carried is not None:
            here = here.join(carried.toDF("id", "c11", "c12"), "id", "left").select("id", "up", *[F.col(f"b{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))).alias(f"b{k}") for k in (11, 12)])
        here = materialise(here, "level_labels")
        cut = here.where("b11 = 0 and b12 = 0").select(F.least("id", "up").alias("src"), F.greatest("id", "up").alias("dst"))
        found = cut if found is None else found.union(cut)
        carried = here.groupBy("up").agg(F.expr("bit_xor(b11)"), F.expr("bit_xor(b12)"))
    return found if found is not None else tree_edges.limit(0)


def bridges(g: Graph, most_edges: int = 200_000) -> DataFrame:
    """(src, dst) with src < dst: the edges of the simple undirected graph whose loss parts a component.

    Components of up to `most_edges` edges are searched in a task each, larger ones by all tasks together.
    """
    import pandas as pd

    simple = materialise(to_directed(g.edges).select("src", "dst"), "simple_edges")
    named = simple.join(connected_components(simple).select(F.col("id").alias("src"), "component"), "src")
    named = materialise(named.select("component", "src", "dst"), "component_edges")
    large = materialise(named.groupBy("component").count().where(F.col("count") > most_edges).select("component"), "large_components")

    def run(pdf):
        return pd.DataFrame(sorted(low_links(sorted(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True)))), columns=["src", "dst"])

    found = named.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, "src long, dst long")
    if large.isEmpty():
        return found
    # A component is named by its least vertex, which is the root of its tree.
    return found.union(_covered_tree_edges(named.join(large, "component", "left_semi").select("src", "dst"), large.select(F.col("component").alias("id"))))


def two_edge_components(g: Graph, most_edges: int = 200_000) -> DataFrame:
    """(id, component): vertices joined by two edge-disjoint paths, named by their least id."""
    rest = to_directed(g.edges).join(bridges(g, most_edges), ["src", "dst"], "left_anti")
    found = connected_components(rest)
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
