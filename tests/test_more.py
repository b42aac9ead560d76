import json
import random
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from conftest import pairs
from loomgraph import cli, streaming, viz
from loomgraph.graph import Graph, GraphError, make_undirected
from loomgraph.operators import boxcover, connectivity, cuttree, hubs, paths
from loomgraph.runtime import fresh_path, spread, trim
from loomgraph.sources import files, generators


def test_text(spark, tmp_path, edges):
    path = tmp_path / "g.txt"
    path.write_text("0 1 junk\n 2\t3\n1 2\n")
    assert pairs(files.read_edge_list(spark, str(path)), "src", "dst") == [(0, 1), (1, 2), (2, 3)]
    path.write_text("0 1\n3\n1 2\n")
    with pytest.raises(GraphError, match='at line 2: "3"'):
        files.read_graph(spark, str(path))
    with pytest.raises(GraphError, match='at line 2: ""'):
        files.parse_edge_list(spark, "0 1\n\n")
    out = str(tmp_path / "out")
    files.write_edge_list(edges([(1, 0, 2.5), (0, 1, 0.25)], True), out)
    assert pairs(files.read_edge_list(spark, out, "double"), "src", "dst", "weight") == [(0, 1, 0.25), (1, 0, 2.5)]


@pytest.mark.parametrize("kind, form", [(None, "unweighted"), ("int", "weight=int,weight_size=4"), ("float", "weight=float,weight_size=4"), ("double", "weight=float,weight_size=8")])
def test_binary(spark, tmp_path, kind, form):
    rows = [(0, 1, 2), (0, 3, 4), (2, 0, 7)]
    df = spark.createDataFrame(rows, "src long, dst long, weight int")
    df = df.drop("weight") if kind is None else df.withColumn("weight", F.col("weight").cast(kind))
    g = Graph.of(df, 6)
    path = str(tmp_path / "g.bin")
    files.write_binary(g, path)
    assert files.binary_format(g) == form and files.guess_type(path) == "binary"
    back = files.read_binary(spark, path)
    assert back.num_vertices() == 6 and sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad").write_bytes(b"else\n0.01\nunweighted\n")
    with pytest.raises(GraphError):
        files.read_binary(spark, str(tmp_path / "bad"))


def test_box_covers(spark):
    g = Graph.of(make_undirected(generators.barabasi_albert(spark, 40, 2, seed=1)))
    near = boxcover._sets(boxcover.balls(g, 1).toPandas())
    for centers in (boxcover.memb(g, 1), boxcover.sketch_cover(g, 1, k=8, alpha=0.1), boxcover.burning(g, 1)):
        chosen = [r.id for r in centers.collect()]
        assert set().union(*(near[c] for c in chosen)) == set(range(40))
    assert boxcover.burning(g, 1).count() <= boxcover.memb(g, 1).count()
    small = {0: {0, 1}, 1: {0, 1, 2}, 2: {1, 2, 3}, 3: {2, 3}, 4: {4}}
    best = next(k for k in range(1, 6) if any(set().union(*(small[c] for c in cs)) == set(range(5)) for cs in combinations(small, k)))
    assert len(boxcover.exact_cover(small)) == best
    assert boxcover.memb(g, 0).count() == 40
    boxes = boxcover.cbb(g, 2).count()
    assert 1 <= boxes <= 40
    colors = dict(pairs(boxcover.coloring(g, 3), "l", "boxes"))
    assert colors[1] == 40 and colors[3] <= colors[2]
    flower = Graph.of(make_undirected(generators.uv_flower(spark, 40, 2, 2)))
    assert boxcover.flower_boxes(2, 2, 3)[0][1] == 12 and flower.num_vertices() == 44
    assert boxcover.curve(Graph.of(make_undirected(generators.path(spark, 5))), "memb").collect()[-1].size == 1


def naive_sketch(near, ranks, k):
    return {c: sorted(ranks[v] for v in b)[:k] for c, b in near.items()}


def test_sketches(spark):
    g = Graph.of(make_undirected(generators.erdos_renyi(spark, 25, 2, seed=8)), 25)
    order = boxcover.ranks(g, 3)
    ranks = dict(pairs(order, "id", "rank"))
    near = boxcover._sets(boxcover.balls(g, 2).toPandas())
    found = {r.id: list(r.sketch) for r in boxcover.build_sketches(g, 2, 4, order).collect()}
    assert found == naive_sketch(near, ranks, 4)


def test_cut_trees(spark):
    g = Graph.of(make_undirected(generators.erdos_renyi(spark, 24, 2.5, seed=6)), 24)
    ids = g.vertices.select(F.col("id").alias("u"))
    want = cuttree.pair_flows(g, ids.join(ids.select(F.col("u").alias("v")), F.col("u") < F.col("v"))).cache()
    for make in (cuttree.cut_tree, cuttree.plain_cut_tree):
        tree = make(g)
        assert tree.count() == 23
        got = cuttree.connectivity(tree, want.select("u", "v"))
        assert pairs(got, "u", "v", "connectivity") == pairs(want, "u", "v", "flow")
    assert all(r.same for r in cuttree.equivalent(cuttree.cut_tree(g), cuttree.plain_cut_tree(g)).collect())
    counts = {}
    for r in want.collect():
        counts[r.flow] = counts.get(r.flow, 0) + 1
    dist = dict(pairs(cuttree.distribution(cuttree.cut_tree(g), 24), "w", "pairs"))
    assert dist == {w: sum(n for f, n in counts.items() if f >= w) for w in {0, *counts}}
    with pytest.raises(GraphError):
        cuttree.pair_flows(g, spark.createDataFrame([(1, 1)], "u long, v long"))


def test_cut_distribution_of_karate_club(spark):
    g = files.built_in_graph(spark, "karate_club")
    dist = dict(pairs(cuttree.distribution(cuttree.cut_tree(g), 35), "w", "pairs"))
    assert dist == {0: 595, 1: 561, 2: 528, 3: 231, 4: 120, 5: 45, 6: 21, 9: 10, 10: 6, 12: 1}
    path = fresh_path(spark, "tree")
    cuttree.write_tree(cuttree.cut_tree(g), path)
    assert cuttree.read_tree(spark, path).count() == 34


def test_tree_packing_bounds_flow():
    rows = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    flow = cuttree.UnitFlow(4, rows)
    assert all(k <= flow.max_flow(0, v) for v, k in cuttree.greedy_tree_packing(rows, 0).items() if v)
    assert cuttree.gusfield([]) == []


def test_cut_trees_of_many_vertices_and_components(spark, edges):
    """Trees settle in time that grows little faster than the graph, and components get tasks of their own."""
    rng = random.Random(4)
    few = sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(90)) if a < b})
    flow = cuttree.UnitFlow(30, few)
    assert all(n == flow.max_flow(u, v) for u, v, n in cuttree.gusfield(few))
    bound = cuttree.greedy_tree_packing(few, few[0][0])
    assert all(n <= flow.max_flow(few[0][0], v) for v, n in bound.items() if v != few[0][0]) and max(bound.values()) > 1
    began = time.process_time()
    many = sorted({(min(v, w), max(v, w)) for v in range(3000) for w in rng.sample(range(3000), 3) if v != w})
    assert len(cuttree.gusfield(many)) == 2999 and time.process_time() - began < 20
    clique = [(8 * k + a, 8 * k + b) for k in range(12) for a in range(6) for b in range(a)]
    tasks = connectivity.by_component(Graph.of_endpoints(edges(clique)), lambda component, pairs: pd.DataFrame({"task": [TaskContext.get().partitionId()]}), "task long")
    assert tasks.distinct().count() > 1


def test_hub_labels(spark, edges):
    arcs = sorted(map(tuple, generators.erdos_renyi(spark, 30, 1.5, seed=2).collect()))
    index = hubs.PrunedLabels(list(range(30)), arcs[:30]).build()
    for e in arcs[30:]:
        index.add_edge(*e)
    g = Graph.of(edges(arcs), 30)
    want = {(s, v): d for s, v, d in pairs(paths.all_pairs_distance(g), "s", "v", "dist")}
    assert all((0 if u == v else index.query(u, v)) == want.get((u, v)) for u in range(30) for v in range(30))
    labels = hubs.build(g)
    ids = g.vertices.select(F.col("id").alias("u"))
    got = hubs.query(labels, ids.join(ids.select(F.col("u").alias("v"))))
    assert {(u, v): d for u, v, d in pairs(got, "u", "v", "dist")} == {(u, v): want.get((u, v), hubs.NO_PATH) for u in range(30) for v in range(30)}
    assert hubs.average_label_size(labels, g).first()[0] == labels.count() / 30
    with pytest.raises(GraphError):
        hubs.remove_edge()


def test_labels_of_components_apart(spark, edges):
    """Components are indexed in tasks of their own, with the same labels and one order of hubs over all."""
    rng = random.Random(3)
    arcs = [(20 * k + rng.randrange(20), 20 * k + rng.randrange(20)) for k in range(6) for _ in range(50)]
    index = hubs.PrunedLabels(list(range(125)), arcs).build()
    g = Graph.of(edges(arcs), 125)
    assert pairs(hubs.build(g), "v", "direction", "hub", "dist") == sorted(index.rows())
    with pytest.raises(GraphError):
        hubs.build(g, most_edges=60)
    assert hubs.build(g, most_edges=200).count() == len(index.rows())  # 425 rows in all, 70 a component
    extra = [(0, 25), (45, 3)]
    for e in extra:
        index.add_edge(*e)
    added = spark.createDataFrame([(k, *e) for k, e in enumerate(extra)], "seq long, src long, dst long")
    assert pairs(hubs.build(g, added), "v", "direction", "hub", "dist") == sorted(index.rows())


def test_searches_of_many_hubs():
    """Hubs that do not see each other's labels, a bit each: the labels of searches one by one."""
    for seed, n in ((1, 50), (2, 200), (3, 300)):
        rng = random.Random(seed)
        arcs = [(rng.randrange(n), min(rng.randrange(n), rng.randrange(n))) for _ in range(2 * n)]
        index = hubs.PrunedLabels(list(range(n)), arcs, dict(enumerate(range(n)))).build()
        src, dst = (np.array([e[k] for e in arcs]) for k in (0, 1))
        for d, way in (("fwd", hubs.HubSearches(n, src, dst)), ("bwd", hubs.HubSearches(n, dst, src))):
            got = [row for some in np.split(np.arange(n), [1, 66, 130]) if len(some) for row in zip(*[c.tolist() for c in way.labels(some)], strict=True)]
            assert sorted(got) == sorted((v, hub, dist) for v, side, hub, dist in index.rows() if side == d)
            assert not way.thin()


def test_one_component_over_tasks(spark, edges, monkeypatch):
    """The hubs of one weak component are dealt to many tasks, also where insertions reach it; a long path is one task's work."""
    monkeypatch.setattr(hubs, "HUBS", 40)
    rng = random.Random(5)
    for arcs in ([(k, rng.randrange(k)) for k in range(1, 200)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(200)], [(k * 77 % 200, (k + 1) * 77 % 200) for k in range(199)]):
        index = hubs.PrunedLabels(list(range(200)), arcs).build()
        g = Graph.of(edges(arcs), 200)
        dealt = []
        with monkeypatch.context() as m:
            m.setattr(hubs, "spread", lambda df, *keys, **more: dealt.append(df.select(*keys).distinct().count()) or spread(df, *keys, **more))
            labels = hubs.build(g)
        assert dealt == [5]
        assert pairs(labels, "v", "direction", "hub", "dist") == sorted(index.rows())
    monkeypatch.setattr(hubs, "RESUMED", 0)
    extra = [(rng.randrange(200), rng.randrange(9)) for _ in range(9)]
    labels = hubs.insert(labels, g.edges, spark.createDataFrame([(k, *e) for k, e in enumerate(extra)], "seq long, src long, dst long"))
    index, fresh = hubs.PrunedLabels(list(range(200)), [], index.order), hubs.PrunedLabels(list(range(200)), arcs + extra, index.order).build()
    rows = pairs(labels, "v", "direction", "hub", "dist")
    assert set(fresh.rows()) <= set(rows) and len({r[:3] for r in rows}) == len(rows)
    for v, d, hub, dist in rows:
        index.label[d][v][hub] = dist
    assert all(index.query(u, v) == fresh.query(u, v) for u in range(200) for v in range(200))


def test_distances_by_key(spark, edges):
    """The pairs of each key in blocks: what the join of labels gives, with vertices that the index lacks, and no pair twice."""
    rng = random.Random(6)
    g = Graph.of(edges([(rng.randrange(40), rng.randrange(40)) for _ in range(70)]), 42)
    labels = hubs.build(g)
    us = spark.range(45).select(F.col("id").alias("u"), (F.col("id") % 7).alias("key"))
    vs = spark.range(45).select(F.col("id").alias("v"), (F.col("id") % 5).alias("key"))
    want = pairs(hubs.query(labels, us.join(vs, "key").select("u", "v")), "u", "v", "dist")
    for block in (10, 4_000_000):
        assert pairs(hubs.query_by_key(labels, us, vs, block=block), "u", "v", "dist") == want
    assert hubs.query_by_key(labels, us.limit(0), vs).isEmpty()


def test_insertions_in_parts(spark, edges):
    """Arcs that join all components into one: parts of the index share only what the arcs reach, and need not fit one task."""
    rng = random.Random(4)
    arcs = [(20 * k + rng.randrange(20), 20 * k + rng.randrange(20)) for k in range(8) for _ in range(50)]
    extra = [(20 * k + rng.randrange(20), rng.randrange(20)) for k in range(1, 8) for _ in range(3)]
    g, change = Graph.of(edges(arcs), 165), "seq long, src long, dst long"
    labels = hubs.build(g)
    added = spark.createDataFrame([(k, *e) for k, e in enumerate(extra)], change)
    most = (labels.count() + len(arcs) + len(extra)) // 2
    labels = hubs.insert(labels, g.edges, added, most_edges=most)
    order = hubs.PrunedLabels(list(range(165)), arcs).order
    assert pairs(labels, "v", "direction", "hub", "dist") == sorted(hubs.PrunedLabels(list(range(165)), arcs + extra, order).build().rows())
    cycle = [(3, 45), (50, 101), (101, 3), (7, 7), (164, 45)]
    labels = hubs.insert(labels, edges(arcs + extra), spark.createDataFrame([(k, *e) for k, e in enumerate(cycle)], change))
    index = hubs.PrunedLabels(list(range(165)), arcs + extra + cycle).build()
    ids = g.vertices.select(F.col("id").alias("u"))
    got = hubs.query(labels, ids.crossJoin(ids.select(F.col("u").alias("v"))))
    assert all(d == (hubs.NO_PATH if (want := index.query(u, v)) is None else want) for u, v, d in pairs(got, "u", "v", "dist"))
    with pytest.raises(GraphError):
        hubs.insert(labels, g.edges, spark.createDataFrame([(0, 3, 999)], change))


def test_label_arrays():
    """Batches of arcs at once: exact distances, also where old labels grow stale, and every label that a new index has."""
    for seed in range(30):
        rng = random.Random(seed)
        n, draw = 40, lambda k: [(rng.randrange(40), min(rng.randrange(40), rng.randrange(40))) for _ in range(k)]
        arcs = draw(seed)
        index = hubs.PrunedLabels(list(range(n)), arcs).build()
        rank, order = index.rank, index.order
        label = {d: [np.array(c) for c in zip(*[(rank[v], hub, dist) for v, side, hub, dist in index.rows() if side == d])] for d in ("fwd", "bwd")}
        table = hubs.LabelArrays(n, tuple(np.array([rank[e[k]] for e in arcs], np.int64) for k in (0, 1)), label)
        for _ in range(2):
            new = draw(25)
            arcs += new
            table.insert(*[np.array([rank[e[k]] for e in new]) for k in (0, 1)], most_starts=rng.choice([40, 1 << 24]))
            fresh = hubs.PrunedLabels(list(range(n)), arcs, order).build()
            rows = [(order[v], d, hub, dist) for d in ("fwd", "bwd") for v, hub, dist in zip(*[c.tolist() for c in table.rows(d)])]
            assert set(fresh.rows()) <= set(rows) and len({r[:3] for r in rows}) == len(rows)
            whole = hubs.PrunedLabels(list(range(n)), [], order)
            for v, d, hub, dist in rows:
                whole.label[d][v][hub] = dist
            assert all(whole.query(u, v) == fresh.query(u, v) for u in range(n) for v in range(n))


def test_labels_resume(spark):
    """Batches of insertions go on from stored labels; vertices come and go while they have no edges."""
    rng = random.Random(8)
    arcs = list({(rng.randrange(20), rng.randrange(20)) for _ in range(60)})
    schema, change = "src long, dst long", "seq long, src long, dst long"
    ids = spark.range(20)
    edges = spark.createDataFrame(arcs[:20], schema)
    labels = hubs.build(Graph(ids, edges))
    labels = hubs.add_vertices(labels, spark.createDataFrame([(30,), (31,), (3,)], "id long"))
    labels = hubs.remove_vertices(labels, spark.createDataFrame([(30,)], "id long"))
    arcs += [(31, 4), (5, 31)]
    for k, batch in enumerate((arcs[20:40], arcs[40:])):
        labels = hubs.insert(labels, edges, spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(batch)], change))
        edges = edges.union(spark.createDataFrame(batch, schema))
        known = [tuple(r) for r in edges.collect()]
        want = {(v, v): 0 for v in [*range(20), 31]}
        for dist in range(1, 22):
            for (u, v), d in list(want.items()):
                if d == dist - 1:
                    for x, y in known:
                        if x == v:
                            want.setdefault((u, y), dist)
        names = spark.createDataFrame([(v,) for v in [*range(20), 31]], "u long")
        got = hubs.query(labels, names.join(names.toDF("v")))
        assert {(u, v): d for u, v, d in pairs(got, "u", "v", "dist")} == {(u, v): want.get((u, v), hubs.NO_PATH) for u in [*range(20), 31] for v in [*range(20), 31]}
    with pytest.raises(GraphError):
        hubs.remove_vertices(labels, spark.createDataFrame([(31,)], "id long"))


def test_changes(spark, edges):
    g = Graph.of(edges([(0, 1), (1, 2)]), 4)
    log = spark.createDataFrame([(0, "add", 2, 3), (1, "remove", 2, 3), (2, "add", 2, 3), (3, "remove", 0, 1)], streaming.CHANGE)
    assert pairs(streaming.apply_changes(g, log).edges, "src", "dst") == [(1, 2), (2, 3)]
    with pytest.raises(GraphError):
        streaming.apply_changes(g, spark.createDataFrame([(0, "add", 2, 9)], streaming.CHANGE))
    index = streaming.DistanceIndex()
    observed = streaming.ObservedGraph(g)
    observed.attach(index)
    observed.change(log.where("seq = 0"))
    assert index.distances(spark.createDataFrame([(0, 3)], "u long, v long")).first().dist == 3
    with pytest.raises(GraphError):
        observed.change(log.where("seq = 3"))
    scenario = streaming.random_additions_and_removals(g, 2)
    assert [r.op for r in scenario.orderBy("seq").collect()] == ["add", "add", "remove", "remove"]
    assert pairs(streaming.apply_changes(g, scenario).edges, "src", "dst") == [(0, 1), (1, 2)]
    assert len(streaming.index_cost(g, [log.where("seq = 0")], streaming.DistanceIndex())) == 1


def test_scenario_of_sparse_ids_and_full_graphs(spark, edges):
    ids = [3, 10**12, 7 * 10**9, 50]
    every = [(a, b) for a in ids for b in ids if a != b]
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id long"), edges(every[2:]))
    added = pairs(streaming.random_additions_and_removals(g, 2).where("op = 'add'"), "src", "dst")
    assert added == sorted(every[:2])  # the only two that are missing
    with pytest.raises(GraphError):
        streaming.random_additions_and_removals(g, 3)


def test_sketch_cover_stops_when_enough_is_covered(spark):
    g = Graph.of(make_undirected(generators.cycle(spark, 60)))
    for k, alpha in ((128, 1.0), (4, 0.0)):
        centers = boxcover.sketch_cover(g, 1, k=k, alpha=alpha, enough=0.5, passes=1)
        assert centers.count() == 10 and boxcover.coverage(g, centers, 1).first().coverage == 0.5
    two = Graph.of(make_undirected(generators.barbell(spark, 6).where("not (src < 6 and dst >= 6)")))
    assert boxcover.sketch_cover(two, 1, enough=0.5).count() == 1 and boxcover.sketch_cover(two, 1).count() == 2


def test_sketches_of_whole_balls_choose_greedily(spark):
    """More vertices than k ranks: sketches that hold whole balls are counted, not estimated; full ones are estimated."""
    rng = random.Random(5)
    near = {v: {v, *(rng.randrange(3000) for _ in range(rng.randrange(8)))} for v in range(3000)}
    place = [rng.random() for _ in near]
    sketches = {v: sorted(place[w] for w in own) for v, own in near.items()}
    assert boxcover.greedy_by_sketches(sketches, 20) == boxcover.greedy_cover(near)
    few = {v: own[:4] for v, own in list(sketches.items())[:80]}
    merged, want = [], []
    size = lambda s: float(len(s)) if len(s) < 4 else 3 / s[3]
    while (best := max(few, key=lambda c: (size(sorted({*merged, *few[c]})[:4]), -c))) is not None and size(sorted({*merged, *few[best]})[:4]) > size(merged):
        merged = sorted({*merged, *few[best]})[:4]
        want.append(best)
    assert boxcover.greedy_by_sketches(few, 4) == want
    g = Graph.of(make_undirected(generators.erdos_renyi(spark, 120, 2.5, seed=3)), 120)
    assert pairs(boxcover.sketch_cover(g, 1, k=40, alpha=0.0), "id") == pairs(boxcover.memb(g, 1), "id")


def test_bridges_of_large_components(spark, edges):
    """The search by labels over all tasks finds what the search in one task finds."""
    import random

    rng = random.Random(3)
    for n, m in ((30, 34), (40, 60), (25, 24)):
        arcs = edges([(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 110)])
        g = Graph.of_endpoints(arcs)
        assert pairs(connectivity.bridges(g, most_edges=0), "src", "dst") == pairs(connectivity.bridges(g), "src", "dst") == sorted(connectivity.low_links(sorted({(min(a, b), max(a, b)) for a, b in pairs(arcs, "src", "dst") if a != b})))


def test_stream(spark, edges):
    g = Graph.of(edges([(0, 1)]), 3)
    where = fresh_path(spark, "stream")
    spark.createDataFrame([(0, "add", 1, 2)], streaming.CHANGE).write.parquet(f"{where}/in")
    seen = []
    query, observed = streaming.follow(spark.readStream.schema(streaming.CHANGE).parquet(f"{where}/in"), g, f"{where}/checkpoint", lambda h, k: seen.append(k))
    query.awaitTermination()
    assert pairs(observed.graph.edges, "src", "dst") == [(0, 1), (1, 2)] and seen == [0]
    # Started again from the checkpoint, the graph goes on from the batches before.
    spark.createDataFrame([(1, "add", 2, 0), (2, "remove", 0, 1)], streaming.CHANGE).write.mode("append").parquet(f"{where}/in")
    query, observed = streaming.follow(spark.readStream.schema(streaming.CHANGE).parquet(f"{where}/in"), g, f"{where}/checkpoint", lambda h, k: seen.append(k))
    query.awaitTermination()
    assert pairs(observed.graph.edges, "src", "dst") == [(1, 2), (2, 0)] and seen == [0, 1]


def test_dot(edges):
    d = viz.Dot.of(Graph.of(edges([(0, 1), (1, 0), (1, 2)]), 4))
    d.set_graph({"rankdir": "LR"})
    d.set_vertex(1, {"label": 'a "b"'})
    d.set_edges_by(lambda u, v: {"w": str(u + v)})
    assert viz.Dot.parse(d.text()).text() == d.text()
    d.merge_reverse_edges()
    assert d.edges[0, 1]["dir"] == "both" and (1, 0) not in d.edges
    d.ignore_isolated_vertices()
    assert 3 not in d.vertices
    d.ignore_direction()
    assert d.text().startswith("graph") and "0 -- 1" in d.text()
    d.clear()
    assert not d.vertices


def test_cli(spark, tmp_path, capsys):
    log = tmp_path / "log.json"
    assert cli.main(["diameter", "--graph", "grid rows=3 columns=3", "--type", "gen", "--log", str(log)], spark) == 0
    assert capsys.readouterr().out.strip() == "4" and json.loads(log.read_text())["graph"] == {"vertices": 9, "edges": 12}
    assert cli.main(["clustering", "--graph", "karate_club"], spark) == 0
    assert capsys.readouterr().out.strip() == "0.103\t0.554"
    assert cli.main(["box_cover", "--graph", "karate_club"], spark) == 1
    assert cli.main(["print", "--graph", "no_such_set"], spark) == 1
    assert cli.main(["write", "--graph", "karate_club", "--method", "binary", "--out", str(tmp_path / "k.bin")], spark) == 0
    assert cli.main(["distribution", "--graph", str(tmp_path / "k.bin")], spark) == 0
    assert "12\t1" in capsys.readouterr().out


def test_driver_gives_freed_memory_back(spark):
    assert trim(spark).startswith("Trim native heap")
