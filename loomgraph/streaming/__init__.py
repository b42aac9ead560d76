"""Changing graphs: ordered change logs in batches and as streams, indices that follow, and what they cost.

A change is a row (seq, op, src, dst) with op 'add' or 'remove'. Adding puts one more parallel arc; removing takes
all arcs src -> dst.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.graph import Graph, GraphError, relabel
from loomgraph.operators import hubs
from loomgraph.runtime import discard, materialise

CHANGE = "seq long, op string, src long, dst long"


def apply_changes(g: Graph, changes: DataFrame) -> Graph:
    """The graph after all changes in order of seq; ends must be vertices."""
    ends = changes.select(F.col("src").alias("id")).union(changes.select(F.col("dst").alias("id")))
    if not ends.join(g.vertices, "id", "left_anti").isEmpty():
        raise GraphError("a change names no vertex of the graph")
    if not changes.where("op not in ('add', 'remove') or op is null").isEmpty():
        raise GraphError("a change is neither 'add' nor 'remove'")
    last = changes.groupBy("src", "dst").agg(F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("gone"))
    kept = g.edges.join(last.where("gone is not null").select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst")
    new = changes.where("op = 'add'").join(last, ["src", "dst"]).where("gone is null or seq > gone").select("src", "dst")
    return Graph(g.vertices, kept.union(new))


class GraphIndex(ABC):
    """What is built from a graph and asked later."""

    @abstractmethod
    def construct(self, g: Graph) -> None: ...


class DynamicGraphIndex(GraphIndex):
    """An index that follows changes; it is told after the graph has changed."""

    @abstractmethod
    def changed(self, g: Graph, changes: DataFrame) -> None: ...


class DistanceIndex(DynamicGraphIndex):
    """Two-hop labels under insertions, each batch from the labels of the one before; removals of edges fail."""

    def __init__(self):
        self.labels: DataFrame | None = None

    def construct(self, g: Graph) -> None:
        self.edges, self.labels = g.edges, hubs.build(g)

    def _replace(self, labels: DataFrame) -> None:
        old, self.labels = self.labels, labels
        discard(old)

    def changed(self, g: Graph, changes: DataFrame) -> None:
        if not changes.where("op = 'remove'").isEmpty():
            hubs.remove_edge()
        self._replace(hubs.insert(self.labels, self.edges, changes.select("seq", "src", "dst")))
        self.edges = g.edges

    def add_vertices(self, ids: DataFrame) -> None:
        self._replace(hubs.add_vertices(self.labels, ids))

    def remove_vertices(self, ids: DataFrame) -> None:
        self._replace(hubs.remove_vertices(self.labels, ids))

    def distances(self, pairs: DataFrame) -> DataFrame:
        return hubs.query(self.labels, pairs)


class ObservedGraph:
    """A graph with indices that it owns or that only observe it."""

    def __init__(self, g: Graph):
        self.graph, self.indices = g, []

    def attach(self, index: GraphIndex) -> GraphIndex:
        index.construct(self.graph)
        if isinstance(index, DynamicGraphIndex):
            self.indices.append(index)
        return index

    def change(self, changes: DataFrame) -> Graph:
        return self.replace(materialise(apply_changes(self.graph, changes).edges, "edges"), changes)

    def replace(self, edges: DataFrame, changes: DataFrame) -> Graph:
        """Take the edges that `changes` have led to, and tell the indices."""
        self.graph = Graph(self.graph.vertices, edges)
        for index in self.indices:
            index.changed(self.graph, changes)
        return self.graph


def evaluate(g: Graph, workloads: list[DataFrame], index: DynamicGraphIndex | None = None) -> list[float]:
    """Seconds for each workload of changes, with the index attached or without one."""
    observed, out = ObservedGraph(g), []
    if index is not None:
        observed.attach(index)
    for changes in workloads:
        began = time.perf_counter()
        observed.change(changes)
        out.append(time.perf_counter() - began)
    return out


def index_cost(g: Graph, workloads: list[DataFrame], index: DynamicGraphIndex) -> list[float]:
    """Seconds that the index adds to each workload."""
    return [a - b for a, b in zip(evaluate(g, workloads, index), evaluate(g, workloads), strict=True)]


def random_additions_and_removals(g: Graph, k: int, seed: int = 0) -> DataFrame:
    """A change log: k random arcs that are not there are added, then removed in reverse order.

    Ends are drawn from the vertices by dense ranks, so ids may have gaps; more are drawn until k new arcs are found.
    """
    n = g.num_vertices()
    if n * (n - 1) - g.edges.where("src <> dst").select("src", "dst").distinct().count() < k:
        raise GraphError("there is no room for so many new arcs")
    spark, ids = g.vertices.sparkSession, materialise(relabel(g), "ranks")
    draws, numbered = 2 * k + 100, None
    while numbered is None:
        pairs = spark.range(draws).select("id", *[F.pmod(F.xxhash64(F.lit(seed), F.lit(side), "id"), F.lit(n)).alias(side) for side in ("a", "b")]).where("a <> b")
        rows = pairs.join(ids.select(F.col("id").alias("src"), F.col("new_id").alias("a")), "a").join(ids.select(F.col("id").alias("dst"), F.col("new_id").alias("b")), "b")
        fresh = rows.groupBy("src", "dst").agg(F.min("id").alias("at")).join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")
        first = materialise(fresh.orderBy("at").limit(k), "draws")
        if first.count() == k:
            numbered = materialise(first.withColumn("seq", F.row_number().over(Window.orderBy("at")).cast("long") - 1), "scenario")  # k rows
        draws *= 4
    back = numbered.select((F.lit(2 * k - 1) - F.col("seq")).alias("seq"), F.lit("remove").alias("op"), "src", "dst")
    return numbered.select("seq", F.lit("add").alias("op"), "src", "dst").union(back)


# --- streams


def degree_counts(changes: DataFrame) -> DataFrame:
    """A streaming or batch count of added arcs: (id, out_added, in_added) for every vertex that a change names."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    rows = changes.where("op = 'add'").select(F.explode(ends).alias("e")).select("e.*")
    return rows.groupBy("id").agg(F.sum("o").alias("out_added"), F.sum("i").alias("in_added"))


def _last_state(spark, folder: str) -> tuple[int, DataFrame | None]:
    """The highest batch whose edges are wholly written below a folder, and those edges."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [-1]
    if fs.exists(where):
        for status in fs.listStatus(where):
            path = status.getPath()
            if path.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                found.append(int(path.getName()))
    last = max(found)
    return last, spark.read.schema("src long, dst long").parquet(f"{folder}/{last}") if last >= 0 else None


def follow(changes: DataFrame, g: Graph, checkpoint: str, on_graph=None, **trigger) -> tuple[StreamingQuery, ObservedGraph]:
    """Apply a stream of changes batch by batch; on_graph(graph, batch number) is called after each.

    The edges after each batch are written beside the checkpoint under its number. A batch that arrives again after a
    failure is applied once, and a query that is started again from the checkpoint goes on from the last edges written;
    `g` is the graph before the first batch.
    """
    spark, folder = g.vertices.sparkSession, f"{checkpoint}/graph"
    last, edges = _last_state(spark, folder)
    observed = ObservedGraph(g if edges is None else Graph(g.vertices, edges))
    done = {"last": last}

    def apply(batch: DataFrame, number: int) -> None:
        if number > done["last"]:
            after = apply_changes(observed.graph, materialise(batch, "changes"))
            after.edges.select("src", "dst").write.mode("overwrite").parquet(f"{folder}/{number}")
            observed.replace(spark.read.schema("src long, dst long").parquet(f"{folder}/{number}"), batch)
            done["last"] = number
        if on_graph is not None:
            on_graph(observed.graph, number)

    query = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    return query, observed
