"""Command line: python -m loomgraph.cli COMMAND --graph WHERE [--type T] [--undirected] [options]."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from loomgraph import runtime, viz
from loomgraph.graph import GraphError
from loomgraph.operators import boxcover, centrality, cuttree, paths, statistics
from loomgraph.sources import files


class RunLog:
    """A tree of values of a run: put sets, add appends, and timed scopes; written as JSON."""

    def __init__(self):
        self.tree: dict = {"run": {"args": sys.argv[1:], "began": time.time()}}

    def _at(self, path: str) -> tuple[dict, str]:
        *parents, last = path.split(".")
        node = self.tree
        for p in parents:
            node = node.setdefault(p, {})
        return node, last

    def put(self, path: str, value) -> None:
        node, last = self._at(path)
        node[last] = value

    def add(self, path: str, value) -> None:
        node, last = self._at(path)
        node.setdefault(last, []).append(value)

    def timed(self, path: str):
        log = self

        class Scope:
            def __enter__(self):
                self.began = time.perf_counter()

            def __exit__(self, *_):
                log.put(path, time.perf_counter() - self.began)

        return Scope()

    def write(self, path: str) -> None:
        self.put("run.time", time.time() - self.tree["run"]["began"])
        with open(path, "w") as out:
            json.dump(self.tree, out, indent=1, default=str)


def _show(df) -> None:
    for row in df.toLocalIterator():
        print("\t".join(str(x) for x in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    p.add_argument("command", choices=["print", "diameter", "clustering", "pagerank", "closeness", "edge_centrality", "box_cover", "cut_tree", "distribution", "draw", "write"])
    p.add_argument("--graph", required=True, help="a path, '-', a data set's name, or 'family key=value ...' with --type gen")
    p.add_argument("--type", default="auto", choices=["auto", "text", "tsv", "binary", "parquet", "built_in", "gen"])
    p.add_argument("--undirected", action="store_true")
    p.add_argument("--method", default=None)
    p.add_argument("--samples", type=int, default=1000)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--rounds", type=int, default=300)
    p.add_argument("--radius", type=int, default=1)
    p.add_argument("--out", default=None)
    p.add_argument("--log", default=None)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    runtime.prepare(spark)
    log = RunLog()
    try:
        g = files.load(spark, a.graph, a.type, a.undirected)
        log.put("graph.vertices", g.num_vertices())
        log.put("graph.edges", g.num_edges())
        with log.timed("time"):
            if a.command == "print":
                _show(g.summary())
            elif a.command == "diameter":
                log.put("diameter", paths.diameter(g).first()[0])
                print(log.tree["diameter"])
            elif a.command == "clustering":
                print(f"{statistics.global_clustering(g).first()[0]:.3f}\t{statistics.average_clustering(g).first()[0]:.3f}")
            elif a.command == "pagerank":
                _show(centrality.pagerank(g, a.rounds).orderBy("id"))
            elif a.command == "closeness":
                _show(centrality.closeness(g).orderBy("id"))
            elif a.command == "edge_centrality":
                scores = centrality.edge_betweenness(g) if a.method == "naive" else centrality.edge_betweenness_sampled(g, a.samples, a.seed)
                _show(centrality.merge_directions(scores).orderBy("src", "dst"))
            elif a.command == "box_cover":
                if not a.undirected:
                    raise GraphError("box covers are of undirected graphs: add --undirected")
                from loomgraph.operators.connectivity import largest_component

                core = largest_component(g)
                _show(boxcover.coloring(core, a.radius) if a.method == "coloring" else boxcover.curve(core, a.method or "memb", a.radius))
            elif a.command in ("cut_tree", "distribution"):
                tree = cuttree.plain_cut_tree(g) if a.method == "gusfield" else cuttree.cut_tree(g)
                _show(tree if a.command == "cut_tree" else cuttree.distribution(tree, g.num_vertices()).orderBy("w"))
            elif a.command == "draw":
                dot = viz.Dot.of(g)
                dot.write(a.out) if a.out else print(dot.text(), end="")
            elif a.command == "write":
                if not a.out:
                    raise GraphError("--out is needed")
                {"binary": lambda: files.write_binary(g, a.out), "parquet": lambda: files.write_parquet(g, a.out)}.get(a.method or "text", lambda: files.write_edge_list(g.edges, a.out))()
    except GraphError as e:
        print(e, file=sys.stderr)
        return 1
    if a.log:
        log.write(a.log)
    return 0


if __name__ == "__main__":
    sys.exit(main())
