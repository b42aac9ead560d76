"""The graph model: vertices(id) and edges(src, dst[, weight]), and how graphs are built, read and changed.

A vertex is a long. Ids are dense in the default construction: n is the largest id plus one, and ids without an edge
are isolated vertices. Edges are directed and may be parallel or loops; an undirected graph holds both arcs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FWD, BWD = "fwd", "bwd"
UNREACHABLE = 2147483647


class GraphError(ValueError):
    """A graph, file or change that breaks the rules of the model."""


def oriented(edges: DataFrame, direction: str = FWD) -> DataFrame:
    """The edges as they are, or each turned round for the backward direction; weights stay."""
    if direction == FWD:
        return edges
    if direction != BWD:
        raise GraphError(f"no such direction: {direction}")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def num_vertices_of(edges: DataFrame) -> int:
    """Largest id plus one; 0 for no edges."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0]


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    # --- construction

    @classmethod
    def of(cls, edges: DataFrame, num_vertices: int | None = None) -> Graph:
        """Vertices 0 .. n-1, where n is the largest id plus one unless given."""
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
        n = num_vertices_of(edges)
        if num_vertices is not None and num_vertices < n:
            raise GraphError(f"an edge has the id {n - 1}, beyond {num_vertices} vertices")
        return cls(edges.sparkSession.range(n if num_vertices is None else num_vertices), edges)

    @classmethod
    def of_endpoints(cls, edges: DataFrame) -> Graph:
        """Only the ids that some edge has, as for graphs derived from tables."""
        ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        return cls(ids, edges)

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    # --- access

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        """Arcs; an undirected edge counts twice."""
        return self.edges.count()

    def edge_list(self, direction: str = FWD) -> DataFrame:
        """All arcs ordered by (src, dst), turned round for the backward direction."""
        return oriented(self.edges, direction).orderBy("src", "dst")

    def adjacent(self, direction: str = FWD) -> DataFrame:
        """(src, i, dst): the i-th neighbour of src by id, from 0."""
        order = Window.partitionBy("src").orderBy("dst")
        return oriented(self.edges, direction).withColumn("i", F.row_number().over(order) - 1)

    def neighbors(self, v: int, direction: str = FWD) -> DataFrame:
        return oriented(self.edges, direction).where(F.col("src") == v).select("dst").orderBy("dst")

    def neighbor(self, v: int, i: int, direction: str = FWD) -> DataFrame:
        return self.adjacent(direction).where((F.col("src") == v) & (F.col("i") == i)).select("dst")

    def degrees(self, direction: str = FWD) -> DataFrame:
        """(id, degree), parallel edges counted, 0 for isolated vertices."""
        counts = oriented(self.edges, direction).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def are_adjacent(self, pairs: DataFrame, direction: str = FWD) -> DataFrame:
        """The rows of pairs(u, v) with an arc u -> v."""
        arcs = oriented(self.edges, direction).select(F.col("src").alias("u"), F.col("dst").alias("v"))
        return pairs.join(arcs, ["u", "v"], "left_semi")

    def undirected_neighbors(self) -> DataFrame:
        """(id, neighbor): out- and in-neighbours, each once."""
        both = self.edges.select("src", "dst").union(oriented(self.edges, BWD).select("src", "dst"))
        return both.distinct().toDF("id", "neighbor")

    def summary(self, vertices: int = 5, edges: int = 10) -> DataFrame:
        """The first arcs of the first vertices in both directions, as the text form prints them."""
        few = self.vertices.orderBy("id").limit(vertices)
        parts = [self.adjacent(d).where(F.col("i") < edges).select(F.lit(d).alias("direction"), "src", "i", "dst") for d in (FWD, BWD)]
        rows = parts[0].union(parts[1])
        return rows.join(few, rows.src == few.id, "left_semi").orderBy("src", F.col("direction").desc(), "i")

    # --- change

    def add_edges(self, new: DataFrame) -> Graph:
        """Endpoints must be there already."""
        known = self.vertices
        ends = new.select(F.col("src").alias("id")).union(new.select(F.col("dst").alias("id")))
        if not ends.join(known, "id", "left_anti").isEmpty():
            raise GraphError("an endpoint is not a vertex")
        return Graph(self.vertices, self.edges.unionByName(new.select(*self.edges.columns)))

    def remove_edges(self, gone: DataFrame) -> Graph:
        """All parallel arcs src -> dst go, the other direction stays."""
        return Graph(self.vertices, self.edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))

    def resize(self, num_vertices: int) -> Graph:
        """Vertices 0 .. n-1; vertices that go must be isolated."""
        lost = self.edges.where(F.greatest("src", "dst") >= num_vertices)
        if not lost.isEmpty():
            raise GraphError("a vertex to remove has an edge")
        return Graph(self.vertices.sparkSession.range(num_vertices), self.edges)


def make_undirected(edges: DataFrame) -> DataFrame:
    """Both arcs of every edge, each once."""
    return edges.select("src", "dst").union(oriented(edges, BWD).select("src", "dst")).distinct()


def to_directed(edges: DataFrame) -> DataFrame:
    """One arc (smaller id, larger id) for each undirected edge; no loops."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def add_unit_weight(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1.0).alias("weight"))


def add_random_weight(edges: DataFrame, seed: int = 0, integer: bool = False) -> DataFrame:
    """Weights by a hash of the arc and the seed: whole numbers 0 .. 10, or reals in [0, 1)."""
    unit = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return edges.select("src", "dst", (F.floor(unit * 11).cast("int") if integer else unit).alias("weight"))


def unsorted_adjacency(edges: DataFrame) -> DataFrame:
    """Arcs that do not follow the one before in a presorted adjacency (src, i, dst): targets must strictly rise."""
    before = F.lag("dst").over(Window.partitionBy("src").orderBy("i"))
    return edges.withColumn("before", before).where(F.col("before") >= F.col("dst")).select("src", "i", "dst")


def relabel(g: Graph) -> DataFrame:
    """(id, new_id): ids made dense in ascending order.

    Ranks are counted by ranges of ids: one row for each range is ordered alone, never all vertices at once.
    """
    n = max(1, g.vertices.rdd.getNumPartitions())
    from loomgraph.runtime import materialise

    # Written: ranges are cut by sampling, and both uses below must see the same ones.
    ranged = materialise(g.vertices.repartitionByRange(n, "id").withColumn("part", F.spark_partition_id()), "ranged")
    within = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    sizes = ranged.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("k", within).join(sizes.withColumn("before", before), "part").select("id", (F.col("k") - 1 + F.col("before")).alias("new_id"))


def improved(new: Column, old: Column, eps: float) -> Column:
    """Whether new < old beyond an absolute or relative eps (0: exactly)."""
    if not eps:
        return new < old
    gap = F.abs(new - old)
    close = (gap <= eps) | (gap <= eps * F.greatest(F.abs(new), F.abs(old)))
    return ~close & (new < old)
