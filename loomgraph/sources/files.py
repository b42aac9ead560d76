"""Graphs in files: edge lists as text, the binary format, Parquet, and built-in data sets."""

from __future__ import annotations

import re
import struct
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph, GraphError

WEIGHTS = {"int": "int", "float": "float", "double": "double"}


def read_edge_list(spark: SparkSession, path: str, weight: str | None = None) -> DataFrame:
    """Lines `u v` or `u v w` separated by white space; what follows is ignored. '-' reads standard input.

    A line without enough numbers fails with its number, counted from 1 within its file, and its text.
    """
    if path == "-":
        return parse_edge_list(spark, sys.stdin.read(), weight)
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), parts.alias("p"))
    src, dst = (F.try_element_at("p", F.lit(k)).try_cast("long") for k in (1, 2))
    fields = [src.alias("src"), dst.alias("dst")]
    bad = src.isNull() | dst.isNull() | (src < 0) | (dst < 0)
    if weight:
        w = F.try_element_at("p", F.lit(3)).try_cast(WEIGHTS[weight])
        fields.append(w.alias("weight"))
        bad = bad | w.isNull()
    wrong = rows.where(bad).select("file", "value").first()
    if wrong is not None:
        raise GraphError(_where(spark, wrong["file"], wrong["value"]))
    return rows.select(*fields)


def _where(spark: SparkSession, file: str, text: str) -> str:
    """The message for a bad line; only its own file is numbered."""
    k = spark.read.text(file).rdd.zipWithIndex().filter(lambda r: r[0][0] == text).first()[1]
    return f'at line {k + 1}: "{text}"'


def parse_edge_list(spark: SparkSession, text: str, weight: str | None = None) -> DataFrame:
    """The same for a text in memory."""
    kinds = {"int": int, "float": float, "double": float}
    rows = []
    for k, line in enumerate(text.splitlines(), 1):
        parts = line.split()
        try:
            rows.append((int(parts[0]), int(parts[1]), *([kinds[weight](parts[2])] if weight else [])))
        except (IndexError, ValueError):
            raise GraphError(f'at line {k}: "{line}"') from None
    return spark.createDataFrame(rows, "src long, dst long" + (f", weight {WEIGHTS[weight]}" if weight else ""))


def read_graph(spark: SparkSession, path: str, weight: str | None = None) -> Graph:
    return Graph.of(read_edge_list(spark, path, weight))


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Lines `u v` or `u v w` in order of (u, v)."""
    names = ["src", "dst", *(["weight"] if "weight" in edges.columns else [])]
    edges.orderBy("src", "dst").select(F.concat_ws(" ", *[F.col(n).cast("string") for n in names]).alias("value")).write.text(path)


def read_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph.of(spark.read.parquet(path))


def write_parquet(g: Graph, path: str) -> None:
    g.edges.write.parquet(path)


# --- the binary format: three header lines, then counts and adjacency in the machine's little-endian layout

# Fixed values of the format. Files of another program have a first line of their own: see `magic`.
MAGIC, VERSION = "LOOMGRAPH_BINARY", "0.01"
_EDGE = {"unweighted": "<i", "weight=int,weight_size=4": "<ii", "weight=float,weight_size=4": "<if", "weight=float,weight_size=8": "<i4xd"}
_FORMAT = {None: "unweighted", "int": "weight=int,weight_size=4", "float": "weight=float,weight_size=4", "double": "weight=float,weight_size=8"}


def binary_format(g: Graph) -> str:
    return _FORMAT[dict(g.edges.dtypes).get("weight")]


def write_binary(g: Graph, path: str, magic: str = MAGIC, most_edges: int = 50_000_000) -> None:
    """One file for other programs; bounded, since it is written by the driver (Parquet is the form for large graphs)."""
    form = binary_format(g)
    n, m = g.num_vertices(), g.num_edges()
    if m > most_edges:
        raise GraphError(f"{m} edges are too many for one file")
    names = ["src", "dst", *(["weight"] if g.weighted else [])]
    with open(path, "wb") as out:
        out.write(f"{magic}\n{VERSION}\n{form}\n".encode() + struct.pack("<iQ", n, m))
        rows = iter(g.edges.select(*names).orderBy("src", "dst").toLocalIterator(prefetchPartitions=True))
        row = next(rows, None)
        for v in range(n):
            own = []
            while row is not None and row[0] == v:
                own.append(struct.pack(_EDGE[form], *row[1:]))
                row = next(rows, None)
            out.write(struct.pack("<Q", len(own)) + b"".join(own))


def decode_binary(data: bytes, magic: str = MAGIC) -> tuple[int, str, list[tuple]]:
    """Number of vertices, format and edges; fails on another header, or where targets do not strictly rise."""
    head = data.split(b"\n", 3)
    if len(head) < 4 or head[0].decode() != magic or head[1].decode() != VERSION or head[2].decode() not in _EDGE:
        raise GraphError("not a binary graph of this version")
    form, at = head[2].decode(), len(data) - len(head[3])
    n, _ = struct.unpack_from("<iQ", data, at)
    at += 12
    edge, edges = struct.Struct(_EDGE[form]), []
    for v in range(n):
        (degree,) = struct.unpack_from("<Q", data, at)
        own = list(edge.iter_unpack(data[at + 8 : at + 8 + degree * edge.size]))
        if any(a[0] >= b[0] for a, b in zip(own[:-1], own[1:], strict=True)):
            raise GraphError(f"the targets of vertex {v} do not rise")
        edges += [(v, *e) for e in own]
        at += 8 + degree * edge.size
    return n, form, edges


def read_binary(spark: SparkSession, path: str, magic: str = MAGIC) -> Graph:
    """A file of the binary format; the bytes are decoded on an executor."""
    files = spark.read.format("binaryFile").load(path).select("content")
    head = bytes(files.select(F.substring(F.col("content"), 1, 64)).first()[0] or b"").split(b"\n")
    form = head[2].decode(errors="replace") if len(head) > 3 and head[:2] == [magic.encode(), VERSION.encode()] else ""
    kind = next((k for k, v in _FORMAT.items() if v == form), "none")
    if kind == "none":
        raise GraphError("not a binary graph of this version")

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                n, _, edges = decode_binary(content.as_py(), magic)
                rows = [(-1, n, *([0] if kind else []))] + edges
                kinds = [pa.int64(), pa.int64(), *([{"int": pa.int32(), "float": pa.float32(), "double": pa.float64()}[kind]] if kind else [])]
                names = ["src", "dst", *(["weight"] if kind else [])]
                for k in range(0, len(rows), 100_000):
                    part = list(zip(*rows[k : k + 100_000], strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names=names)

    rows = files.mapInArrow(decode, "src long, dst long" + (f", weight {WEIGHTS[kind]}" if kind else ""))
    n = rows.where("src = -1").first()["dst"]
    return Graph.of(rows.where("src >= 0"), n)


# --- built-in data sets

# Undirected edges of the karate club network (34 members, ids from 1), each vertex with its larger neighbours.
KARATE_CLUB = """
1: 2 3 4 5 6 7 8 9 11 12 13 14 18 20 22 32
2: 3 4 8 14 18 20 22 31
3: 4 8 9 10 14 28 29 33
4: 8 13 14
5: 7 11
6: 7 11 17
7: 17
9: 31 33 34
10: 34
14: 34
15: 33 34
16: 33 34
19: 33 34
20: 34
21: 33 34
23: 33 34
24: 26 28 30 33 34
25: 26 28 32
26: 32
27: 30 34
28: 34
29: 32 34
30: 33 34
31: 33 34
32: 33 34
33: 34
"""
# Undirected edges of the dolphin network (62 animals, ids from 1), each vertex with its larger neighbours.
DOLPHIN = """
1: 11 15 16 41 43 48
2: 18 20 27 28 29 37 42 55
3: 11 43 45 62
4: 9 15 60
5: 52
6: 10 14 57 58
7: 10 14 18 55 57 58
8: 20 28 31 41 55
9: 21 29 38 46 60
10: 14 18 33 42 58
11: 30 43 48
12: 52
13: 34
14: 18 33 42 55 58
15: 17 25 34 35 38 39 41 44 51 53
16: 19 25 41 46 56 60
17: 21 34 38 39 51
18: 23 26 28 32 58
19: 21 22 25 30 46 52
20: 31 55
21: 29 37 39 45 48 51
22: 30 34 38 46 52
24: 37 46 52
25: 30 46 52
26: 27 28
27: 28
29: 31 48
30: 36 44 46 52 53
31: 43 48
33: 61
34: 35 38 39 41 44 51
35: 38 45 50
37: 38 40 41 60
38: 41 44 46 62
39: 44 45 53 59
40: 58
41: 53
42: 55 58
43: 48 51
44: 47 54
46: 51 52 60
47: 50
49: 58
51: 52
52: 56
54: 62
55: 58
"""
BUILT_IN = {"karate_club": KARATE_CLUB, "dolphin": DOLPHIN}
#: Data sets that are read from an edge list given by the caller: name -> path.
REGISTERED: dict[str, str] = {}


def register_built_in(name: str, path: str) -> None:
    """Let a name stand for an edge list file, for data sets too large to ship."""
    REGISTERED[name.lower()] = path


def built_in_edges(spark: SparkSession, name: str) -> DataFrame:
    """Both arcs of each edge of a built-in data set; names in any case. Fails on unknown ones."""
    name = name.lower()
    if name in REGISTERED:
        return read_edge_list(spark, REGISTERED[name])
    if name not in BUILT_IN:
        raise GraphError(f"no such data set: {name}")
    pairs = [(int(v), int(w)) for v, rest in re.findall(r"(\d+): (.*)", BUILT_IN[name]) for w in rest.split()]
    return spark.createDataFrame(sorted(pairs + [(b, a) for a, b in pairs]), "src long, dst long")


def built_in_graph(spark: SparkSession, name: str) -> Graph:
    return Graph.of(built_in_edges(spark, name))


def guess_type(path: str, magic: str = MAGIC) -> str:
    """'built_in' where there is no such file, 'binary' by its first line, else 'text'; '-' is text."""
    if path == "-":
        return "text"
    try:
        with open(path, "rb") as f:
            return "binary" if f.readline().strip() == magic.encode() else "text"
    except OSError:
        return "built_in"


def load(spark: SparkSession, where: str, kind: str = "auto", undirected: bool = False) -> Graph:
    """A graph by type: text, binary, parquet, built_in, gen ('family key=value ...'), or auto."""
    kind = guess_type(where) if kind == "auto" else kind
    if kind == "gen":
        from loomgraph.sources.generators import FAMILIES

        family, *given = where.split()
        if family not in FAMILIES:
            raise GraphError(f"no such family: {family}")
        make, defaults = FAMILIES[family]
        values = defaults | {k: type(defaults.get(k, 0))(v) for k, v in (x.split("=", 1) for x in given)}
        g = Graph.of(make(spark, **values))
    elif kind in ("text", "tsv"):
        g = read_graph(spark, where)
    elif kind == "binary":
        g = read_binary(spark, where)
    elif kind == "parquet":
        g = read_parquet(spark, where)
    elif kind == "built_in":
        g = built_in_graph(spark, where)
    else:
        raise GraphError(f"no such type: {kind}")
    if undirected:
        from loomgraph.graph import make_undirected

        return Graph(g.vertices, make_undirected(g.edges))
    return g
