"""All-pairs edge connectivity by cut trees of the simple undirected graph beneath a graph.

Components and two-edge-connected parts are found over all tasks; each such core then gets its tree in one task by
Gusfield's method: packed trees settle most vertices, unit-capacity flows the others. Bridges join the cores with weight 1 and components hang together with
weight 0, so the tree spans all vertices. Any correct tree is as good as another: results are to be compared by
connectivity values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import UnionFind
from loomgraph.graph import Graph, GraphError, to_directed
from loomgraph.operators.connectivity import bridges, by_component, connected_components
from loomgraph.runtime import materialise


class UnitFlow:
    """Maximum flow with one unit each way on every undirected edge: paths are sought from both ends, the smaller front first.

    Searches stay near the ends where the graph spreads fast, and only arcs that carried flow are reset for each pair.
    """

    def __init__(self, n: int, pairs: list[tuple[int, int]]):
        self.near: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (arc number, head); arc k goes back as k ^ 1
        for k, (a, b) in enumerate(pairs):
            self.near[a].append((2 * k, b))
            self.near[b].append((2 * k + 1, a))
        self.room = [1] * (2 * len(pairs))
        self.side: tuple[bool, set[int]] = (True, set())

    def _path(self, s: int, t: int) -> list[int] | None:
        """Arcs of a path with room, or None; then one end's side is searched in full and kept."""
        near, room = self.near, self.room
        came, goes = {s: -1}, {t: -1}  # the arc by which a vertex was reached, from s and towards t
        tails: dict[int, int] = {}  # of the arcs in came; the heads of those in goes are found the same way
        fronts = [[s], [t]]
        work = [len(near[s]), len(near[t])]
        while True:
            forward = work[0] <= work[1]
            mine, other = (came, goes) if forward else (goes, came)
            after, more = [], 0
            for v in fronts[not forward]:
                for k, w in near[v]:
                    if w in mine or not room[k if forward else k ^ 1]:
                        continue
                    k = k if forward else k ^ 1
                    mine[w] = k
                    tails[k if forward else ~k] = v
                    if w in other:
                        path, x = [], w
                        while (k := came[x]) >= 0:
                            path.append(k)
                            x = tails[k]
                        x = w
                        while (k := goes[x]) >= 0:
                            path.append(k)
                            x = tails[~k]
                        return path
                    after.append(w)
                    more += len(near[w])
            if not after:
                self.side = (forward, set(mine))
                return None
            fronts[not forward] = after
            work[not forward] = more

    def max_flow(self, s: int, t: int) -> int:
        room, most, moved = self.room, min(len(self.near[s]), len(self.near[t])), []
        total = 0
        while total < most and (path := self._path(s, t)) is not None:
            for k in path:
                room[k] -= 1
                room[k ^ 1] += 1
            moved.extend(path)
            total += 1
        if total == most:  # an end alone is a side
            self.side = (True, {s}) if len(self.near[s]) == most else (False, {t})
        for k in moved:
            room[k] = room[k ^ 1] = 1
        return total

    def from_source(self, v: int) -> bool:
        """Whether v is on the source's side of the last minimum cut."""
        forward, side = self.side
        return (v in side) == forward


def gusfield(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Tree edges (u, v, w) of a connected simple graph: a flow between each vertex and its present parent.

    The root has the highest degree. Vertices that packed trees reach as often as their degree come first: they alone
    are a least cut from the root, which moves no other vertex, so they need no flow.
    """
    degree: dict[int, int] = {}
    for v in (v for e in pairs for v in e):
        degree[v] = degree.get(v, 0) + 1
    if not degree:
        return []
    root = min(degree, key=lambda v: (-degree[v], v))
    bound = greedy_tree_packing(pairs, root)
    plain = sorted(v for v in degree if v != root and bound[v] == degree[v])
    ids = [root, *sorted((v for v in degree if v != root and bound[v] < degree[v]), key=lambda v: (-degree[v], v))]
    tree = [(v, root, degree[v]) for v in plain]
    at = {v: k for k, v in enumerate([*ids, *plain])}
    flow = UnitFlow(len(at), [(at[a], at[b]) for a, b in pairs])
    parent = [0] * len(ids)
    for v in range(1, len(ids)):
        above = parent[v]
        tree.append((ids[v], ids[above], flow.max_flow(v, above)))
        forward, side = flow.side
        for w in side if forward and len(side) < len(ids) - v else range(v + 1, len(ids)):
            if v < w < len(ids) and parent[w] == above and flow.from_source(w):
                parent[w] = v
    return tree


def greedy_tree_packing(pairs: list[tuple[int, int]], root: int) -> dict[int, int]:
    """How many of greedily packed trees, each on arcs unused so far, reach every vertex from the root.

    Every edge has an arc each way, as in flows, so the number is a lower bound of the vertex's connectivity with the root.
    """
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    size = {v: len(own) for v, own in near.items()}
    for own in near.values():
        own.sort(key=lambda w: (-size[w], w))  # taken from the end: low degrees first
    bound = dict.fromkeys(near, 0)
    for _ in range(len(near.get(root, ()))):
        seen, stack, kept = {root}, [root], {root: []}
        while stack:
            v = stack[-1]
            own = near[v]
            while own:
                w = own.pop()
                if w in seen:
                    kept[v].append(w)
                    continue
                seen.add(w)
                bound[w] += 1
                kept[w] = []
                stack.append(w)
                break
            else:
                near[v] = kept[v][::-1]
                stack.pop()
        if len(seen) <= 1:
            break
    return bound


def cut_tree(g: Graph, most_edges: int = 2_000_000) -> DataFrame:
    """(u, v, w): a spanning tree of all vertices; the connectivity of two is the least w on their path.

    Weights are 0 between components, 1 on bridges and at least 2 within two-edge-connected cores.
    """
    import pandas as pd

    simple = materialise(to_directed(g.edges), "simple_edges")
    alone = Graph(g.vertices, simple)
    cut = materialise(bridges(alone), "bridges")
    core = Graph(g.vertices, simple.join(cut, ["src", "dst"], "left_anti"))
    trees = by_component(core, lambda component, pairs: pd.DataFrame(gusfield(pairs), columns=["u", "v", "w"]), "u long, v long, w long", most_edges)
    named = g.vertices.join(connected_components(simple), "id", "left").select(F.coalesce("component", "id").alias("root")).distinct()
    first = named.agg(F.min("root").alias("first"))
    links = named.crossJoin(first).where("root <> first").select(F.col("root").alias("u"), F.col("first").alias("v"), F.lit(0).cast("long").alias("w"))  # one row
    whole = trees.union(cut.select("src", "dst", F.lit(1).cast("long"))).union(links)
    return materialise(whole, "cut_tree")


def plain_cut_tree(g: Graph, most_edges: int = 2_000_000) -> DataFrame:
    """The same by Gusfield's method on whole components."""
    import pandas as pd

    simple = Graph(g.vertices, to_directed(g.edges))
    trees = by_component(simple, lambda component, pairs: pd.DataFrame(gusfield(pairs), columns=["u", "v", "w"]), "u long, v long, w long", most_edges)
    named = g.vertices.join(connected_components(simple.edges), "id", "left").select(F.coalesce("component", "id").alias("root")).distinct()
    first = named.agg(F.min("root").alias("first"))
    links = named.crossJoin(first).where("root <> first").select(F.col("root"), F.col("first"), F.lit(0).cast("long"))  # one row
    return materialise(trees.union(links), "cut_tree")


def pair_flows(g: Graph, pairs: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """pairs(u, v) with `flow`, by one maximum flow each: every task loads the edges once (so their size is checked)."""
    import pandas as pd

    simple = to_directed(g.edges)
    if simple.count() > most_edges:
        raise GraphError(f"more than {most_edges} edges")
    arcs = g.edges.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in simple.collect()))

    def run(frames):
        ids = sorted({v for e in arcs.value for v in e})
        at = {v: k for k, v in enumerate(ids)}
        flow = UnitFlow(len(ids), [(at[a], at[b]) for a, b in arcs.value])
        for pdf in frames:
            found = [flow.max_flow(at[u], at[v]) if u in at and v in at else 0 for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True)]
            yield pd.DataFrame({"u": pdf["u"], "v": pdf["v"], "flow": found})

    if not pairs.where("u = v").isEmpty():
        raise GraphError("a vertex has no connectivity with itself")
    return pairs.select("u", "v").mapInPandas(run, "u long, v long, flow long")


def connectivity(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with the least weight on their path in a cut tree, by doubling ancestors.

    Every vertex gets its depth and, for each power of two, its ancestor that far up and the least weight on the way.
    """
    if not pairs.where("u = v").isEmpty():
        raise GraphError("a vertex has no connectivity with itself")
    from loomgraph.plans.iterate import levels

    arcs = materialise(tree.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").union(tree.select("v", "u", "w")), "tree_arcs")
    root = arcs.agg(F.min("src").alias("id")).where("id is not null")
    depth = materialise(levels(arcs.select("src", "dst"), root.select(F.col("id").alias("s"), F.col("id").alias("v"))).select(F.col("v").alias("id"), F.col("dist").alias("depth")), "depths")
    up = arcs.join(depth.toDF("src", "ds"), "src").join(depth.toDF("dst", "dd"), "dst").where("dd = ds - 1").select(F.col("src").alias("id"), F.col("dst").alias("up"), F.col("w").alias("low"))
    top = depth.where("depth = 0").select("id", F.col("id").alias("up"), F.lit(1 << 62).alias("low"))
    jump = materialise(up.union(top), "jumps")
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    jumps = [jump]
    while 1 << len(jumps) <= deepest:
        last = jumps[-1]
        jumps.append(materialise(last.join(last.toDF("up", "up2", "low2"), "up").select("id", F.col("up2").alias("up"), F.least("low", "low2").alias("low")), "jumps"))
    state = pairs.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1 << 62).alias("low"))
    state = state.join(depth.toDF("a", "da"), "a").join(depth.toDF("b", "db"), "b")
    for k in reversed(range(len(jumps))):  # bring both to one depth
        for side in ("a", "b"):
            other = "b" if side == "a" else "a"
            move = F.col(f"d{side}") - F.col(f"d{other}") >= (1 << k)
            j = jumps[k].toDF(side, "up", "jl")
            state = state.join(j, side).select("u", "v", F.when(move, F.col("up")).otherwise(F.col(side)).alias(side), other, F.when(move, F.least("low", "jl")).otherwise(F.col("low")).alias("low"), F.when(move, F.col(f"d{side}") - (1 << k)).otherwise(F.col(f"d{side}")).alias(f"d{side}"), f"d{other}")
    state = materialise(state, "pairs")
    for k in [*reversed(range(len(jumps))), -1]:  # climb while the ancestors differ, then the last step
        j = jumps[max(k, 0)]
        joined = state.join(j.toDF("a", "ua", "la"), "a").join(j.toDF("b", "ub", "lb"), "b")
        move = F.col("ua") != F.col("ub") if k >= 0 else F.col("a") != F.col("b")
        state = joined.select("u", "v", F.when(move, F.col("ua")).otherwise(F.col("a")).alias("a"), F.when(move, F.col("ub")).otherwise(F.col("b")).alias("b"), F.when(move, F.least("low", "la", "lb")).otherwise(F.col("low")).alias("low"))
    return state.select("u", "v", F.col("low").alias("connectivity"))


def _kruskal(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(w, pairs joined at w) of a tree, heaviest edges first."""
    ids = {v: k for k, v in enumerate(sorted({v for e in edges for v in e[:2]}))}
    sets, out = UnionFind(len(ids)), {}
    for u, v, w in sorted(edges, key=lambda e: -e[2]):
        a, b = sets.root(ids[u]), sets.root(ids[v])
        out[w] = out.get(w, 0) + sets.size[a] * sets.size[b]
        sets.unite(a, b)
    return sorted(out.items())


def distribution(tree: DataFrame, num_vertices: int) -> DataFrame:
    """(w, pairs): how many unordered pairs have connectivity w or more, for each weight of the tree and for 0."""
    import pandas as pd
    from pyspark.sql import Window

    parts = connected_components(tree.where("w > 0").select(F.col("u").alias("src"), F.col("v").alias("dst")))
    rows = tree.where("w > 0").join(parts.select(F.col("id").alias("u"), "component"), "u").select("component", "u", "v", "w")
    per = rows.groupBy("component").applyInPandas(lambda pdf: pd.DataFrame(_kruskal(list(zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["w"].tolist(), strict=True))), columns=["w", "n"]), "w long, n long")
    at = per.groupBy("w").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("w")))  # as many rows as there are weights
    zero = tree.sparkSession.createDataFrame([(0, num_vertices * (num_vertices - 1) // 2)], "w long, pairs long")
    return at.select("w", above.alias("pairs")).union(zero)


def equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """(w, same): whether two cut trees part the vertices alike at each of their weights."""
    weights = sorted({r[0] for t in (a, b) for r in t.select("w").distinct().collect()})

    def parts(t: DataFrame, w: int) -> DataFrame:
        found = connected_components(t.where(F.col("w") >= w).select(F.col("u").alias("src"), F.col("v").alias("dst")))
        return found.groupBy("component").agg(F.expr("bit_xor(xxhash64(id))").alias("tag"), F.count("*").alias("n")).select("tag", "n")

    rows = [(w, parts(a, w).exceptAll(parts(b, w)).isEmpty() and parts(b, w).exceptAll(parts(a, w)).isEmpty()) for w in weights]
    return a.sparkSession.createDataFrame(rows, "w long, same boolean")


def write_tree(tree: DataFrame, path: str) -> None:
    """Lines `u v w`."""
    tree.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("u", "v", "w")]).alias("value")).write.text(path)


def read_tree(spark, path: str) -> DataFrame:
    p = F.split("value", " ")
    return spark.read.text(path).select(*[p[k].cast("long").alias(c) for k, c in enumerate(("u", "v", "w"))])
