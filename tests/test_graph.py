import math
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from conftest import pairs
from loomgraph import functions as fn
from loomgraph.graph import BWD, UNREACHABLE, Graph, GraphError, add_random_weight, make_undirected, relabel, unsorted_adjacency
from loomgraph.operators import centrality, connectivity, paths, statistics
from loomgraph.sources import files, generators

TAIL = [(0, 1), (1, 2), (2, 3), (3, 1)]


def both(rows):
    return sorted({*rows, *((b, a) for a, b in rows)})


def test_dense_vertices_and_changes(edges):
    g = Graph.of(edges([(0, 1), (2, 4)]))
    assert g.num_vertices() == 5 and g.num_edges() == 2
    assert pairs(g.degrees(), "id", "degree") == [(0, 1), (1, 0), (2, 1), (3, 0), (4, 0)]
    assert Graph.of(edges([])).num_vertices() == 0
    with pytest.raises(GraphError):
        Graph.of(edges([(0, 9)]), 5)
    with pytest.raises(GraphError):
        g.add_edges(edges([(0, 7)]))
    with pytest.raises(GraphError):
        g.resize(4)
    twice = Graph.of(edges([(0, 1), (0, 1), (1, 0)]))
    assert pairs(twice.remove_edges(edges([(0, 1)])).edges, "src", "dst") == [(1, 0)]
    assert g.resize(9).num_vertices() == 9


def test_access(edges, spark):
    g = Graph.of(edges([(0, 2), (0, 1), (2, 0), (1, 1)]))
    assert [r.dst for r in g.neighbors(0).collect()] == [1, 2]
    assert g.neighbor(0, 1).first().dst == 2
    assert [r.dst for r in g.neighbors(0, BWD).collect()] == [2]
    assert pairs(g.undirected_neighbors(), "id", "neighbor") == [(0, 1), (0, 2), (1, 0), (1, 1), (2, 0)]
    bad = spark.createDataFrame([(0, 0, 3), (0, 1, 3), (1, 0, 2), (1, 1, 5)], "src long, i long, dst long")
    assert pairs(unsorted_adjacency(bad), "src", "i") == [(0, 1)]
    w = [r.weight for r in add_random_weight(g.edges, 1, integer=True).collect()]
    assert all(0 <= x <= 10 for x in w)


@pytest.mark.parametrize("weighted", [False, True])
def test_all_pairs_is_single_source(edges, weighted):
    rows = [(*e, w) for e, w in zip(TAIL, (1.5, 20.0, 5.0, 0.01), strict=True)] if weighted else TAIL
    g = Graph.of(edges(rows, weighted))
    all_pairs = pairs(paths.all_pairs_distance(g), "s", "v", "dist")
    for s in (0, 3):
        one = paths.single_source_distance(g, s)
        assert [(s, *r) for r in pairs(one, "v", "dist") if r[1] not in (UNREACHABLE, math.inf)] == [r for r in all_pairs if r[0] == s]


def test_grid_counts_are_binomials(spark):
    g = Graph.of(generators.grid(spark, 5, 5))
    found = pairs(paths.single_source_path_counts(g, 0), "v", "dist", "npaths")
    assert found == [(5 * i + j, i + j, math.comb(i + j, i)) for i in range(5) for j in range(5)]


def test_diameter(spark):
    assert paths.diameter(Graph.of(generators.grid(spark, 3, 3))).first()[0] == 4
    g = Graph.of(make_undirected(generators.barabasi_albert(spark, 20, 2, seed=3)))
    assert paths.diameter(g, sweeps=1, batch=10).first()[0] == paths.all_pairs_distance(g).agg(F.max("dist")).first()[0]


def test_visit_prunes(edges):
    g = Graph.of(edges([(0, 1), (1, 2), (0, 3), (3, 4)]))
    assert pairs(paths.visit_by_distance(g, 0, lambda v, d: v != 1), "v", "dist") == [(0, 0), (1, 1), (3, 1), (4, 2)]


def naive_triangles(n, rows):
    e = {frozenset(p) for p in rows if p[0] != p[1]}
    t, wedges = 0, 0
    for a, b, c in combinations(range(n), 3):
        k = sum(frozenset(p) in e for p in ((a, b), (b, c), (a, c)))
        t, wedges = t + (k == 3), wedges + (k == 2)
    return t, wedges


def test_triangles(spark):
    g = Graph.of(generators.erdos_renyi(spark, 40, 5, seed=2))
    rows = pairs(g.edges, "src", "dst")
    assert tuple(statistics.triangles_and_wedges(g).first()) == naive_triangles(40, rows)


def test_karate_club(spark):
    g = files.built_in_graph(spark, "Karate_Club")
    assert g.num_vertices() == 35 and g.num_edges() == 156
    assert tuple(statistics.triangles_and_wedges(g).first()) == (45, 393)
    assert statistics.global_clustering(g).first()[0] == pytest.approx(0.1027397260)
    assert statistics.global_clustering(g, "transitivity").first()[0] == pytest.approx(0.2556818182)
    assert statistics.average_clustering(g).first()[0] == pytest.approx(0.5543345217)
    assert not connectivity.is_connected(g).first()[0]
    assert pairs(paths.all_pairs_distance(g).groupBy("dist").count(), "dist", "count") == [(0, 35), (1, 156), (2, 530), (3, 274), (4, 146), (5, 16)]


def test_dolphin(spark):
    g = files.built_in_graph(spark, "dolphin")
    assert g.num_vertices() == 63 and g.num_edges() == 318
    assert tuple(statistics.triangles_and_wedges(g).first()) == (95, 638)


def test_connected(edges):
    assert connectivity.is_connected(Graph.of(edges([(0, 1), (1, 2)]))).first()[0]
    assert not connectivity.is_connected(Graph.of(edges([(0, 1), (2, 4)]))).first()[0]


def test_components(edges):
    rows = [(0, 1), (2, 1), (5, 6), (7, 7), (6, 5), (9, 8), (8, 10), (10, 11), (11, 12)]
    for small in (50_000, 0):
        found = dict(pairs(connectivity.connected_components(edges(rows), small=small), "id", "component"))
        assert found == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 7: 7, **dict.fromkeys(range(8, 13), 8)}
        assert connectivity.connected_components(edges([]), small=small).count() == 0


def test_strong_components(spark):
    g = Graph.of(generators.erdos_renyi(spark, 30, 1.5, seed=5), 30)
    reach = {}
    for s, v in pairs(paths.all_pairs_distance(g), "s", "v"):
        reach.setdefault(s, set()).add(v)
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    assert dict(pairs(connectivity.strongly_connected_components(g), "id", "component")) == want


def test_bridges_and_largest(edges):
    rows = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (8, 9)]
    g = Graph.of(edges(both(rows)))
    assert pairs(connectivity.bridges(g), "src", "dst") == [(2, 3), (8, 9)]
    two = dict(pairs(connectivity.two_edge_components(g), "id", "component"))
    assert two == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8, 9: 9}
    assert connectivity.largest_component(g).num_vertices() == 6
    assert pairs(relabel(Graph.of_endpoints(edges([(7, 3), (3, 10)]))), "id", "new_id") == [(3, 0), (7, 1), (10, 2)]


def test_closeness_and_pagerank(spark, edges):
    path = Graph.of(make_undirected(generators.path(spark, 6)))
    assert dict(pairs(centrality.closeness(path), "id", "score")) == pytest.approx({v: 1 / sum(abs(v - u) for u in range(6)) for v in range(6)})
    ring = Graph.of(generators.cycle(spark, 10))
    assert {round(r.score, 9) for r in centrality.pagerank(ring, rounds=12).collect()} == {0.1}
    chain = Graph.of(edges([(0, 1), (1, 2)]))
    x, before = [1 / 3] * 3, [0] * 3
    for k in range(1, 6):
        new = [0.0 if k == 1 else 0.05] * 3
        new[1] += 0.85 * x[0]
        new[2] += 0.85 * x[1] + (before[2] if k > 1 else 0)
        x, before = new, x
    assert [r.score for r in centrality.pagerank(chain, rounds=5, dangling="retained", cut_every=2).orderBy("id").collect()] == pytest.approx(x)
    total = centrality.pagerank(chain, rounds=5, dangling="uniform").agg(F.sum("score")).first()[0]
    assert total == pytest.approx(1)


def naive_betweenness(n, rows):
    d = {(s, t): (0, 1) if s == t else (math.inf, 0) for s in range(n) for t in range(n)}
    for s in range(n):
        front = {s: 1}
        depth = 0
        while front:
            depth += 1
            nxt = {}
            for v, k in front.items():
                for a, b in rows:
                    if a == v and d[s, b][0] > depth - 1 and (d[s, b][0] == math.inf or b in nxt):
                        nxt[b] = nxt.get(b, 0) + k
            for v, k in nxt.items():
                d[s, v] = (depth, k)
            front = nxt
    out = {}
    for u, v in rows:
        out[u, v] = sum(d[s, u][1] * d[v, t][1] / d[s, t][1] for s, t in permutations(range(n), 2) if d[s, t][1] and d[s, u][0] + 1 + d[v, t][0] == d[s, t][0]) / (n * (n - 1))
    return out


def test_edge_betweenness(spark, edges):
    for n, want in ((2, 1.0), (3, 2 / 3)):
        g = Graph.of(make_undirected(generators.path(spark, n)))
        assert {round(r.score, 9) for r in centrality.merge_directions(centrality.edge_betweenness(g)).collect()} == {round(want, 9)}
    g = Graph.of(generators.erdos_renyi(spark, 8, 3, seed=4), 8)
    rows = pairs(g.edges, "src", "dst")
    exact = {(a, b): s for a, b, s in pairs(centrality.edge_betweenness(g), "src", "dst", "score")}
    assert exact == pytest.approx(naive_betweenness(8, rows))
    sampled = {(a, b): s for a, b, s in pairs(centrality.edge_betweenness_sampled(g, samples=50, seed=1), "src", "dst", "score")}
    assert set(sampled) == set(exact) and all(abs(sampled[e] - exact[e]) < 5 / math.sqrt(50) for e in exact)


def test_generators(spark):
    size = lambda df: df.count()
    for m in (3, 4):
        n = 30
        assert size(generators.barabasi_albert(spark, n, m)) == size(generators.holme_kim(spark, n, m, 0.5)) == m * (m - 1) // 2 + (n - m) * m
        assert size(generators.dms(spark, n, m, 1)) == (m + 1) * m // 2 + (n - m - 1) * m
    assert size(generators.cycle(spark, 0)) == size(generators.cycle(spark, 1)) == 0
    assert pairs(generators.cycle(spark, 2), "src", "dst") == [(0, 1), (1, 0)]
    ws = pairs(generators.watts_strogatz(spark, 20, 4, 0.7, seed=3), "src", "dst")
    assert len({frozenset(e) for e in ws}) == 40 and all(a != b for a, b in ws)
    er = pairs(generators.erdos_renyi(spark, 20, 15), "src", "dst")
    assert len(set(er)) == 300 and all(a != b for a, b in er)
    deg = [3, 3, 2, 2, 1, 1]
    cfg = pairs(generators.configuration(spark, deg), "src", "dst")
    assert all(sum(v in e for e in cfg) <= d for v, d in enumerate(deg))
    with pytest.raises(GraphError):
        generators.configuration(spark, [1])
    with pytest.raises(GraphError):
        generators.kronecker(spark, 3, ((1, 1), (1, 1)), average_degree=2)
    assert size(generators.kronecker(spark, 5, average_degree=4)) <= 128
    tree = pairs(generators.shm(spark, 20, 5, 2), "src", "dst")
    assert len(tree) == len({v for e in tree for v in e}) - 1
    planar = pairs(generators.random_planar(spark, 12, 20), "src", "dst")
    assert len(planar) == 20
    assert size(generators.random_spanning_tree(spark, 12)) == 11
    assert size(generators.connected_random(spark, 10, 15)) == 15


def test_functions(spark):
    a = fn.UnionFind(4)
    assert a.unite(0, 1) and not a.unite(1, 0) and a.same(0, 1) and not a.same(0, 2)
    v = spark.createDataFrame([(0, 2), (1, 0), (2, 5)], "i long, x long")
    assert pairs(fn.prefix_sums(v), "i", "total") == [(0, 2), (1, 2), (2, 7)]
    assert [fn.lower_bound(v, t).first().i for t in (1, 2, 3, 8)] == [0, 0, 2, 3]
    assert fn.lower_bound(v, 2, strict=True).first().i == 2
    assert fn.range_sum(v, 1, 2).first().total == 5
    assert fn.segments_intersect((0, 0), (2, 2), (0, 2), (2, 0)) and not fn.segments_intersect((0, 0), (1, 0), (2, 0), (3, 0))
    assert fn.segments_intersect((0, 0), (1, 0), (1, 0), (1, 5))
    assert fn.is_equal(1.0, 1.0 + 1e-12) and not fn.is_less(1.0, 1.0 + 1e-12) and fn.is_less_or_equal(2, 2, 0) and fn.signum(-3.0) == -1
    assert fn.split("a,,b c", ", ") == ["a", "b", "c"]
    row = spark.range(1).select(fn.is_less(F.lit(1.0), F.lit(1.0 + 1e-12)).alias("a"), fn.turn_column((F.lit(0), F.lit(0)), (F.lit(1), F.lit(0)), (F.lit(0), F.lit(1))).alias("t")).first()
    assert (row.a, row.t) == (False, 1)
