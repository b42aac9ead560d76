"""Small functions beneath the operators: disjoint sets, prefix sums, plane geometry, tolerant comparison, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))
        self.size = [1] * n

    def root(self, v: int) -> int:
        while self.parent[v] != v:
            self.parent[v] = self.parent[self.parent[v]]
            v = self.parent[v]
        return v

    def same(self, u: int, v: int) -> bool:
        return self.root(u) == self.root(v)

    def unite(self, u: int, v: int) -> bool:
        """Join two sets; whether they were apart."""
        u, v = self.root(u), self.root(v)
        if u == v:
            return False
        if self.size[u] < self.size[v]:
            u, v = v, u
        self.parent[v] = u
        self.size[u] += self.size[v]
        return True


def prefix_sums(values: DataFrame) -> DataFrame:
    """values(i, x) -> (i, x, total): the sum up to and with i. Ranges of i are summed apart, then shifted."""
    n = max(1, values.rdd.getNumPartitions())
    ranged = values.repartitionByRange(n, "i").withColumn("part", F.spark_partition_id())
    within = F.sum("x").over(Window.partitionBy("part").orderBy("i"))
    sums = ranged.groupBy("part").agg(F.sum("x").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("w", within).join(sums.withColumn("before", before), "part").select("i", "x", (F.col("w") + F.col("before")).alias("total"))


def range_sum(values: DataFrame, low: int, high: int) -> DataFrame:
    """One row (total): the sum of x over low <= i <= high."""
    return values.where(F.col("i").between(low, high)).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("total"))


def lower_bound(values: DataFrame, target, strict: bool = False) -> DataFrame:
    """One row (i): the first i whose prefix sum is at least (strict: above) target; the number of rows if none."""
    sums = prefix_sums(values)
    met = F.col("total") > target if strict else F.col("total") >= target
    return sums.agg(F.coalesce(F.min(F.when(met, F.col("i"))), F.count("*")).alias("i"))


# --- plane geometry; points are (x, y) numbers or columns

EPS = 1e-10


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1]


def det(a, b):
    return a[0] * b[1] - a[1] * b[0]


def _minus(a, b):
    return a[0] - b[0], a[1] - b[1]


def turn(a, b, c) -> int:
    """1 for a left turn a-b-c, -1 for a right one; on one line 2 if c is behind a, -2 if beyond b, 0 if between."""
    ab, ac = _minus(b, a), _minus(c, a)
    cross = det(ab, ac)
    if abs(cross) > EPS:
        return 1 if cross > 0 else -1
    if dot(ab, ac) < -EPS:
        return 2
    return -2 if dot(ab, ab) + EPS < dot(ac, ac) else 0


def segments_intersect(a, b, c, d) -> bool:
    """Whether the closed segments a-b and c-d share a point."""
    return turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0


def turn_column(a, b, c) -> Column:
    """The sign of the turn a-b-c for points of columns, 0 on one line."""
    cross = det(_minus(b, a), _minus(c, a))
    return F.when(F.abs(cross) <= EPS, 0).when(cross > 0, 1).otherwise(-1)


# --- tolerant comparison of weights, for numbers and columns

#: Tolerance by type.
TOLERANCE = {"int": 0.0, "float": 1e-4, "double": 1e-9}


def is_equal(a, b, eps: float = 1e-9):
    """Absolute or relative difference within eps."""
    if isinstance(a, Column) or isinstance(b, Column):
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        gap = F.abs(a - b)
        return (a == b) | (gap <= eps) | (gap <= eps * F.greatest(F.abs(a), F.abs(b)))
    return a == b or abs(a - b) <= eps or abs(a - b) <= eps * max(abs(a), abs(b))


def is_less(a, b, eps: float = 1e-9):
    same = is_equal(a, b, eps)
    return (a < b) & ~same if isinstance(same, Column) else a < b and not same


def is_less_or_equal(a, b, eps: float = 1e-9):
    same = is_equal(a, b, eps)
    return (a < b) | same if isinstance(same, Column) else a < b or same


def signum(a, eps: float = 1e-9):
    zero = is_equal(a, 0, eps)
    if isinstance(zero, Column):
        return F.when(zero, 0).when(a > 0, 1).otherwise(-1)
    return 0 if zero else 1 if a > 0 else -1


# --- text

def split(text: str, separators: str = " ") -> list[str]:
    """The parts between any of the separators, empty ones left out."""
    out, now = [], ""
    for c in text:
        if c in separators:
            out, now = (out + [now] if now else out), ""
        else:
            now += c
    return out + [now] if now else out
