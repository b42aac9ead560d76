"""Synthetic graphs as edge tables.

Families whose arcs are independent are plans over spark.range; those in which each step depends on the ones before
are numpy loops on the driver, bounded by `MOST_SEQUENTIAL` edges. All take a seed, and the same seed gives the
same graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import GraphError

MOST_SEQUENTIAL = 20_000_000


def _frame(spark: SparkSession, pairs) -> DataFrame:
    import pandas as pd

    a = np.asarray(list(pairs), np.int64).reshape(-1, 2)
    if not len(a):
        return spark.createDataFrame([], "src long, dst long")
    return spark.createDataFrame(pd.DataFrame({"src": a[:, 0], "dst": a[:, 1]}))


def _sequential(edges: int) -> None:
    if edges > MOST_SEQUENTIAL:
        raise GraphError(f"{edges} edges are too many for a sequential family")


def path(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def cycle(spark: SparkSession, n: int) -> DataFrame:
    if n < 2:
        return spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))


def grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Arcs to the right and down; vertex (i, j) is i * columns + j."""
    ids = spark.range(rows * columns)
    right = ids.where((F.col("id") % columns) < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = ids.where(F.col("id") < (rows - 1) * columns).select(F.col("id").alias("src"), (F.col("id") + columns).alias("dst"))
    return right.union(down)


def complete(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    """Arcs u -> v for u < v."""
    ids = spark.range(first, first + max(0, n - 1)).withColumnRenamed("id", "src")
    return ids.select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(first + n - 1))).alias("dst"))


def barbell(spark: SparkSession, k: int) -> DataFrame:
    """Two cliques of k vertices and the arc 0 -> k."""
    return complete(spark, k).union(complete(spark, k, k)).union(spark.range(1).select(F.lit(0).cast("long"), F.lit(k).cast("long")))


def _unit(seed: int, *columns) -> F.col:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _first(pairs: DataFrame, count: int, seed: int) -> DataFrame:
    """`count` of the distinct pairs, the first by a hash."""
    return pairs.distinct().orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(count)


def erdos_renyi(spark: SparkSession, n: int, average_degree: float, seed: int = 0) -> DataFrame:
    """n * average_degree distinct arcs without loops (average_degree at most n - 1)."""
    want = int(np.ceil(n * min(average_degree, max(0, n - 1))))
    if want > n * (n - 1) // 2:  # dense: choose among all arcs
        all_pairs = spark.range(n * (n - 1)).select(F.expr(f"id div {n - 1}").alias("src"), (F.col("id") % (n - 1)).alias("k"))
        return _first(all_pairs.select("src", (F.col("k") + (F.col("k") >= F.col("src")).cast("int")).alias("dst")), want, seed)
    draws = spark.range(want * 2 + 64 if want else 0)
    pairs = draws.select(F.floor(_unit(seed, F.lit("s"), "id") * n).alias("src"), F.floor(_unit(seed, F.lit("t"), "id") * n).alias("dst"))
    return _first(pairs.where("src <> dst"), want, seed)


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """A clique of m, then each vertex takes m distinct ends of uniformly drawn edges; arcs old -> new."""
    if m < 2:
        raise GraphError("m must be at least 2")
    _sequential(n * m)
    rng, edges = np.random.default_rng(seed), [(u, v) for u in range(m) for v in range(u + 1, m)]
    for v in range(m, n):
        chosen: dict[int, None] = {}
        while len(chosen) < m:
            chosen[edges[rng.integers(len(edges))][rng.integers(2)]] = None
        edges += [(u, v) for u in chosen]
    return _frame(spark, edges)


def dms(spark: SparkSession, n: int, m: int, k0: int, seed: int = 0) -> DataFrame:
    """Growth with initial attractiveness: m - k0 tickets for each vertex and one more for each link it receives."""
    if m <= k0:
        raise GraphError("m must be larger than k0")
    _sequential(n * m)
    rng, edges = np.random.default_rng(seed), [(u, v) for u in range(m + 1) for v in range(u + 1, m + 1)]
    tickets = [u for u in range(m + 1) for _ in range(m - k0)] + [v for _, v in edges]
    for v in range(m + 1, n):
        chosen: dict[int, None] = {}
        while len(chosen) < m:
            chosen[tickets[rng.integers(len(tickets))]] = None
        edges += [(v, u) for u in chosen]
        tickets += list(chosen) + [v] * (m - k0)
    return _frame(spark, edges)


def holme_kim(spark: SparkSession, n: int, m: int, p: float, seed: int = 0) -> DataFrame:
    """Preferential attachment in which, with probability p, a step goes to a neighbour of the last choice."""
    if m <= 2 or n <= m:
        raise GraphError("m must be above 2 and n above m")
    _sequential(n * m)
    rng, edges, near = np.random.default_rng(seed), [], [[] for _ in range(n)]

    def add(u: int, v: int) -> None:
        edges.append((u, v))
        near[u].append(v)
        near[v].append(u)

    for u in range(m):
        for v in range(u + 1, m):
            add(u, v)
    for v in range(m, n):
        chosen: dict[int, None] = {}
        last = None
        while len(chosen) < m:
            triad = last is not None and rng.random() < p
            pool = [w for w in near[last] if w not in chosen and w != v] if triad else []
            u = pool[rng.integers(len(pool))] if pool else edges[rng.integers(len(edges))][rng.integers(2)]
            if u not in chosen:
                chosen[u] = None
                last = u
        for u in chosen:
            add(u, v)
    return _frame(spark, edges)


def watts_strogatz(spark: SparkSession, n: int, degree: int, p: float, seed: int = 0) -> DataFrame:
    """A ring lattice of even degree, each edge rewired at one end with probability p; no loops or parallels."""
    if degree % 2 or degree >= n:
        raise GraphError("the degree must be even and below n")
    _sequential(n * degree)
    rng = np.random.default_rng(seed)
    edges = [(u, (u + k) % n) for u in range(n) for k in range(1, degree // 2 + 1)]
    there = {frozenset(e) for e in edges}
    for k, (u, v) in enumerate(edges):
        if rng.random() >= p or len(there) == n * (n - 1) // 2:
            continue
        stay = u if rng.random() < 0.5 else v
        free = [w for w in rng.permutation(n).tolist() if w != stay and frozenset((stay, w)) not in there][:1]
        if free:
            there.remove(frozenset((u, v)))
            there.add(frozenset((stay, free[0])))
            edges[k] = (stay, free[0])
    return _frame(spark, edges)


def configuration(spark: SparkSession, degrees: list[int] | DataFrame, seed: int = 0) -> DataFrame:
    """Half-edges of the degrees (a list, or rows (id, degree)) shuffled by a hash and paired; loops and parallels drop."""
    rows = degrees if isinstance(degrees, DataFrame) else spark.createDataFrame(list(enumerate(degrees)), "id long, degree long")
    if (rows.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]) % 2:
        raise GraphError("the degrees must add up to an even number")
    from loomgraph.graph import Graph, relabel

    half = rows.where("degree > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("k"))
    drawn = half.select(F.xxhash64(F.lit(seed), "id", "k").alias("h"), F.col("id").alias("v"))
    ranks = relabel(Graph(drawn.select(F.col("h").alias("id")), drawn)).withColumnRenamed("id", "h")
    pairs = drawn.join(ranks, "h").groupBy(F.expr("new_id div 2").alias("pair")).agg(F.min("v").alias("src"), F.max("v").alias("dst"))
    return pairs.where("src <> dst").select("src", "dst").distinct()


RMAT = ((0.57, 0.19), (0.19, 0.05))


def kronecker(spark: SparkSession, scale: int, matrix=RMAT, average_degree: float | None = None, seed: int = 0) -> DataFrame:
    """Arcs drawn by `scale` choices of a cell; duplicates and loops drop.

    Without average_degree the number of arcs is the matrix's sum to the power of scale; with it, average_degree
    times the number of vertices, and the matrix must sum to 1. At most twice as many draws are made.
    """
    w = np.asarray(matrix, float)
    n, total = len(w), w.sum()
    if average_degree is not None and abs(total - 1) > 1e-3:
        raise GraphError("the matrix must sum to 1")
    m = int(total**scale if average_degree is None else average_degree * n**scale)
    edge = np.cumsum(w.ravel() / total)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(scale):
        u = _unit(seed, F.lit(k), "id")
        cell = F.lit(0)
        for at in edge[:-1]:
            cell = cell + (u >= float(at)).cast("int")
        src, dst = src * n + F.floor(cell / n), dst * n + cell % n
    pairs = spark.range(2 * m).select(src.cast("long").alias("src"), dst.cast("long").alias("dst")).where("src <> dst")
    return _first(pairs, m, seed)


def uv_flower(spark: SparkSession, least: int, u: int, v: int) -> DataFrame:
    """From a cycle of u + v, every edge becomes two parallel paths of u and v edges until there are `least` vertices."""
    from loomgraph.runtime import materialise

    edges, n, m = cycle(spark, u + v), u + v, u + v
    while n < least:
        _sequential(m * (u + v))
        ranked = edges.orderBy("src", "dst").rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1])).toDF("a long, b long, k long")
        inner = u + v - 2
        steps = []
        for length, skip in ((u, 0), (v, u - 1)):
            ids = [F.col("a"), *[F.lit(n) + F.col("k") * inner + skip + j for j in range(length - 1)], F.col("b")]
            steps += [F.struct(x.alias("src"), y.alias("dst")) for x, y in zip(ids[:-1], ids[1:], strict=True)]
        edges = materialise(ranked.select(F.explode(F.array(*steps)).alias("e")).select("e.src", "e.dst"), "flower")
        n, m = n + m * inner, m * (u + v)
    return edges


def shm(spark: SparkSession, least: int, start: int, t: int, p: float = 0.0, seed: int = 0) -> DataFrame:
    """Tree growth: each generation gives every vertex t leaves for each edge it has, and moves old edges to leaves.

    An old edge (a, b) is replaced by one between a leaf of a and a leaf of b; with probability p, drawn once for a
    generation, it is kept as well. Starts from a star of `start` vertices.
    """
    if t < 1 or start < 2:
        raise GraphError("t and start are too small")
    rng, edges, n = np.random.default_rng(seed), [(0, k) for k in range(1, start)], start
    while n < least:
        keep = rng.random() < p
        degree = np.bincount(np.array(edges).ravel(), minlength=n)
        leaves, grown = [], []
        for a in range(n):
            own = list(range(n + sum(map(len, leaves)), n + sum(map(len, leaves)) + t * int(degree[a])))
            leaves.append(own)
            grown += [(a, x) for x in own]
        used = [0] * n
        for a, b in edges:
            grown.append((leaves[a][used[a]], leaves[b][used[b]]))
            used[a], used[b] = used[a] + 1, used[b] + 1
        edges, n = grown + (edges if keep else []), n + sum(map(len, leaves))
        _sequential(len(edges))
    return _frame(spark, edges)


def random_planar(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """n uniform points; pairs by ascending length are taken unless they cross one already taken, up to m."""
    from loomgraph.functions import segments_intersect

    if n > 3000:
        raise GraphError("too many points for a sequential family")
    points = np.random.default_rng(seed).random((n, 2))
    a, b = np.triu_indices(n, 1)
    order = np.argsort(((points[a] - points[b]) ** 2).sum(axis=1), kind="stable")
    taken: list[tuple[int, int]] = []
    for u, v in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if len(taken) == m:
            break
        if not any(len({u, v, x, y}) == 4 and segments_intersect(points[u], points[v], points[x], points[y]) for x, y in taken):
            taken.append((u, v))
    return _frame(spark, taken)


def random_spanning_tree(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Random pairs, each taken where it joins two trees."""
    _sequential(n)
    return _frame(spark, _spanning(n, np.random.default_rng(seed)))


def _spanning(n: int, rng) -> list[tuple[int, int]]:
    from loomgraph.functions import UnionFind

    sets, out = UnionFind(n), []
    while len(out) < n - 1:
        u, v = (int(x) for x in rng.integers(n, size=2))
        if sets.unite(u, v):
            out.append((u, v))
    return out


def connected_random(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """A random spanning tree and further random edges as (smaller, larger) pairs, m in all where there is room."""
    _sequential(m)
    rng = np.random.default_rng(seed)
    pairs = {(min(e), max(e)) for e in _spanning(n, rng)}
    while len(pairs) < min(m, n * (n - 1) // 2):
        u, v = sorted(int(x) for x in rng.integers(n, size=2))
        if u != v:
            pairs.add((u, v))
    return _frame(spark, sorted(pairs))


#: Families by the names the command line knows, with defaults.
FAMILIES = {
    "path": (path, {"n": 10}),
    "barbell": (barbell, {"k": 10}),
    "grid": (grid, {"rows": 10, "columns": 10}),
    "erdos_renyi": (erdos_renyi, {"n": 10, "average_degree": 3.0, "seed": 0}),
    "random_planar": (random_planar, {"n": 10, "m": 25, "seed": 0}),
    "cycle": (cycle, {"n": 10}),
    "ba": (barabasi_albert, {"n": 10, "m": 3, "seed": 0}),
    "dms": (dms, {"n": 10, "m": 5, "k0": 2, "seed": 0}),
    "hk": (holme_kim, {"n": 10, "m": 3, "p": 0.5, "seed": 0}),
    "ws": (watts_strogatz, {"n": 10, "degree": 4, "p": 0.5, "seed": 0}),
    "kronecker": (kronecker, {"scale": 5, "average_degree": 16.0, "seed": 0}),
    "flower": (uv_flower, {"least": 44, "u": 2, "v": 2}),
    "shm": (shm, {"least": 101, "start": 5, "t": 2, "p": 0.0, "seed": 0}),
    "spanning_tree": (random_spanning_tree, {"n": 10, "seed": 0}),
    "connected_random": (connected_random, {"n": 10, "m": 20, "seed": 0}),
}
