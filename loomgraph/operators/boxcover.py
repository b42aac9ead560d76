"""Box covering: how few balls of a radius cover a graph.

Balls follow forward edges, so undirected graphs hold both arcs. The r-ball table comes from a level-synchronous
search; the greedy choices, each of which depends on the ones before, run in one task for each weak component.
Ties go to the smaller id (or the smaller rank in the seeded order), so results are the same on every run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, GraphError
from loomgraph.operators.connectivity import connected_components
from loomgraph.plans.iterate import levels
from loomgraph.runtime import materialise, spread


def balls(g: Graph, radius: int, centers: DataFrame | None = None) -> DataFrame:
    """(center, v, dist): what each center reaches within the radius."""
    ids = g.vertices if centers is None else centers
    return levels(g.edges, ids.select(F.col("id").alias("s"), F.col("id").alias("v")), max_depth=radius).withColumnRenamed("s", "center")


def covered(g: Graph, centers: DataFrame, radius: int) -> DataFrame:
    """(id) of the vertices within the radius of some of centers(id)."""
    return balls(g, radius, centers).select(F.col("v").alias("id")).distinct()


def coverage(g: Graph, centers: DataFrame, radius: int) -> DataFrame:
    """One row (coverage): the share of vertices within the radius of a center."""
    n = g.vertices.agg(F.count("*").alias("n"))
    return covered(g, centers, radius).agg(F.count("*").alias("k")).crossJoin(n).select((F.col("k") / F.col("n")).alias("coverage"))  # one row each


def _by_component(g: Graph, rows: DataFrame, kernel, schema: str, most: int) -> DataFrame:
    """kernel on the rows (center, v, dist) of each weak component; refuses components of more than `most` rows."""
    named = _components(g).select(F.col("id").alias("center"), "component")
    joined = materialise(rows.join(named, "center"), "balls")
    if not joined.groupBy("component").count().where(F.col("count") > most).isEmpty():
        raise GraphError(f"a component has more than {most} pairs within the radius")
    return joined.groupBy("component").applyInPandas(lambda pdf: kernel(pdf), schema)


def _sets(pdf) -> dict[int, set[int]]:
    return {int(c): set(own["v"].tolist()) for c, own in pdf.groupby("center")}


def greedy_cover(ball: dict[int, set[int]], need: int | None = None, rank=lambda v: v) -> list[int]:
    """Centers in the order of choice: always one with most uncovered vertices; gains only fall, so they are lazily redone."""
    import heapq

    left = set().union(*ball.values()) if ball else set()
    stop = len(left) - (len(left) if need is None else need)
    heap = [(-len(b), rank(c), c) for c, b in ball.items()]
    heapq.heapify(heap)
    chosen = []
    while len(left) > stop:
        gain, r, c = heapq.heappop(heap)
        now = len(ball[c] & left)
        if now != -gain:
            heapq.heappush(heap, (-now, r, c))
            continue
        chosen.append(c)
        left -= ball[c]
    return chosen


def memb(g: Graph, radius: int, most: int = 20_000_000) -> DataFrame:
    """(id) of centers by maximum excluded mass: repeatedly the ball with most uncovered vertices."""
    import pandas as pd

    return _by_component(g, balls(g, radius), lambda pdf: pd.DataFrame({"id": sorted(greedy_cover(_sets(pdf)))}), "id long", most)


def exact_cover(ball: dict[int, set[int]]) -> list[int]:
    """A smallest set of centers: reductions (only choice, dominated centers and vertices), then branching."""
    best = greedy_cover(ball)

    def search(left: set[int], usable: dict[int, set[int]], chosen: list[int]) -> None:
        nonlocal best
        while left:
            usable = {c: b & left for c, b in usable.items() if b & left}
            usable = {c: b for c, b in usable.items() if not any(b < o or (b == o and d < c) for d, o in usable.items() if d != c)}
            by = {v: [c for c, b in usable.items() if v in b] for v in left}
            v = min(left, key=lambda x: (len(by[x]), x))
            biggest = max(map(len, usable.values()), default=0)
            if not by[v] or len(chosen) + -(-len(left) // biggest) >= len(best):
                return
            if len(by[v]) == 1:
                chosen, left = [*chosen, by[v][0]], left - usable[by[v][0]]
                continue
            for c in sorted(by[v], key=lambda x: (-len(usable[x]), x)):
                search(left - usable[c], usable, [*chosen, c])
            return
        if len(chosen) < len(best):
            best = chosen

    search(set().union(*ball.values()) if ball else set(), dict(ball), [])
    return sorted(best)


def burning(g: Graph, radius: int, most: int = 200_000) -> DataFrame:
    """(id) of a smallest cover; exponential at worst, so only for small components."""
    import pandas as pd

    return _by_component(g, balls(g, radius), lambda pdf: pd.DataFrame({"id": exact_cover(_sets(pdf))}), "id long", most)


# --- sketches


def ranks(g: Graph, seed: int = 0) -> DataFrame:
    """(id, rank): a random order of the vertices, as reals in [0, 1)."""
    return g.vertices.select("id", (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("rank"))


def build_sketches(g: Graph, radius: int, k: int, order: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(id, sketch): the k smallest ranks within the radius of each vertex, ascending; only seeds(id) have a rank."""
    own = order if seeds is None else order.join(seeds, "id", "left_semi")
    state = materialise(own.select("id", "rank"), "sketch")
    for _ in range(radius):
        step = g.edges.select(F.col("src").alias("to"), F.col("dst").alias("id")).join(state, "id").select(F.col("to").alias("id"), "rank")
        both = state.union(step).distinct()
        from pyspark.sql import Window

        state = materialise(both.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where(F.col("r") <= k).drop("r"), "sketch")
    return state.groupBy("id").agg(F.sort_array(F.collect_list("rank")).alias("sketch"))  # at most k each


def estimate(sketch, k: int):
    """The size a sketch of ranks in [0, 1) stands for: its length below k, else (k - 1) / the k-th rank."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / F.element_at(sketch, k))


def greedy_by_sketches(sketches: dict[int, list[float]], k: int) -> list[int]:
    """Centers that most raise the estimate of the merged sketch; ties go to smaller ids; stops when nothing is added.

    Where no sketch is full they hold the whole balls, so the merged one is not cut to k and its length is the size.
    A center's count of ranks that can still enter the merged sketch only falls and bounds its estimate, so a heap of
    counts gives the few whose estimates are worked out.
    """
    import heapq
    from bisect import insort

    whole = all(len(s) < k for s in sketches.values())
    holders: dict[float, list[int]] = {}
    for c, own in sketches.items():
        for r in own:
            holders.setdefault(r, []).append(c)
    rising = sorted(holders)
    merged: list[float] = []
    used: set[float] = set()  # ranks that were merged or can no longer be
    left = {c: sorted(own) for c, own in sketches.items()}
    count = {c: len(own) for c, own in left.items()}
    heap = [(-n, c) for c, n in count.items() if n]
    heapq.heapify(heap)
    chosen: list[int] = []

    def at_most(n: int) -> float:
        """What n new ranks can make of the estimate."""
        if whole or len(merged) + n < k:
            return float(len(merged) + n)
        return (k - 1) / merged[k - 1 - n] if n < k else float("inf")

    def size_with(c: int) -> float:
        if whole or len(merged) + count[c] < k:
            return float(len(merged) + count[c])
        own = left[c] = [r for r in left[c] if r not in used]
        n = max(0, k - len(merged))  # of own ranks, the least that are among the k smallest of both
        while n < min(k, len(own)) and own[n] < merged[k - 1 - n]:
            n += 1
        last = max(own[n - 1] if n else 0.0, merged[k - 1 - n] if n < k else 0.0)
        return (k - 1) / last

    now = 0.0
    while heap:
        best, pick, seen = now, None, []
        while heap:
            bound = at_most(-heap[0][0])
            if bound < best or bound == best and (pick is None or heap[0][1] > pick):
                break
            n, c = heapq.heappop(heap)
            if -n != count[c]:
                if count[c]:
                    heapq.heappush(heap, (-count[c], c))
                continue
            seen.append(c)
            size = size_with(c)
            if size > best or size == best and pick is not None and c < pick:
                best, pick = size, c
        if pick is None:
            break
        chosen.append(pick)
        for c in seen:
            if c != pick:
                heapq.heappush(heap, (-count[c], c))
        new = [r for r in left.pop(pick) if r not in used]
        for r in new:
            insort(merged, r)
        used.update(new)
        gone = new
        if not whole:
            del merged[k:]
            while rising and len(merged) == k and rising[-1] > merged[-1]:
                if rising[-1] not in used:
                    gone.append(rising[-1])
                rising.pop()
            used.update(gone)
        for r in gone:
            for c in holders.pop(r):
                count[c] -= 1
        now = best
    return chosen


def _components(g: Graph) -> DataFrame:
    """(id, component) of every vertex."""
    return g.vertices.join(connected_components(g.edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def sketch_cover(g: Graph, radius: int, k: int = 128, passes: int = 4, enough: float = 1.0, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(id) of centers by bottom-k sketches, in passes with fresh ranks over what is still uncovered.

    Weak components are sketched and chosen from apart, at every size. Where the balls hold no more than alpha * k * n
    pairs they are used themselves. The last pass covers what is left with exact balls, until the share `enough` is
    covered and no further.
    """
    import pandas as pd

    n = g.num_vertices()
    allowed = int((1 - enough) * n)  # vertices that may stay uncovered
    spark = g.vertices.sparkSession
    chosen = spark.createDataFrame([], "id long")
    left = g.vertices
    named = materialise(_components(g), "components")
    for number in range(passes):
        sketches = materialise(build_sketches(g, radius, k, ranks(g, seed + number), left), "sketches")
        pairs = sketches.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()[0]
        if number + 1 == passes or pairs <= alpha * k * n and sketches.where(F.size("sketch") >= k).isEmpty():
            break
        rows = sketches.join(named, "id").select("component", "id", "sketch")
        picked = spread(rows, "component").groupBy("component").applyInPandas(lambda pdf: pd.DataFrame({"id": greedy_by_sketches(dict(zip(pdf["id"].tolist(), map(list, pdf["sketch"]), strict=True)), k)}), "id long")
        chosen = materialise(chosen.union(picked).distinct(), "centers")
        left = materialise(g.vertices.join(covered(g, chosen, radius), "id", "left_anti"), "uncovered")
        if left.count() <= allowed:
            return chosen
    need = left.count() - allowed
    if need <= 0:
        return chosen
    rest = balls(g, radius).join(left.select(F.col("id").alias("v")), "v").select("center", "v", "dist")

    def kernel(pdf):
        ball = _sets(pdf)
        order = greedy_cover(ball)
        seen: set[int] = set()
        gains = []
        for c in order:
            gains.append(len(ball[c] - seen))
            seen |= ball[c]
        return pd.DataFrame({"id": order, "gain": gains})

    # Gains never rise within a component, so the highest gains over all are the greedy choice for the whole graph.
    picked = materialise(_by_component(g, rest, kernel, "id long, gain long", 20_000_000), "gains")
    per = sorted(((r["gain"], r["count"]) for r in picked.groupBy("gain").count().collect()), reverse=True)  # distinct gains: few
    least, some = 1, None
    for gain, many in per:
        if need <= gain * many:
            least, some = gain, -(-need // gain)
            break
        need -= gain * many
    taken = picked.where(F.col("gain") > least).select("id").union(picked.where(F.col("gain") == least).orderBy("id").limit(some or 0).select("id"))
    return materialise(chosen.union(taken).distinct(), "centers")


# --- boxes by mutual distance


def cbb(g: Graph, diameter: int, seed: int = 0, most: int = 20_000_000) -> DataFrame:
    """(id) of one vertex for each box of compact-box-burning: all pairs in a box are at most `diameter` apart."""
    import pandas as pd

    def kernel(pdf):
        near = _sets(pdf)
        order = np.random.default_rng(seed)
        left, out = set(near), []
        while left:
            box = set(left)
            first = None
            while box:
                v = sorted(box)[order.integers(len(box))]
                first = v if first is None else first
                left.discard(v)
                box = (box & near[v]) - {v}
            out.append(first)
        return pd.DataFrame({"id": sorted(out)})

    return _by_component(g, balls(g, diameter), kernel, "id long", most)


def coloring(g: Graph, largest: int, most: int = 20_000_000) -> DataFrame:
    """(l, boxes): greedy coloring in order of id for each l = 1 .. largest; vertices at distance l or more conflict.

    Unreachable pairs conflict as well, so components are colored apart and their counts add up.
    """
    import pandas as pd

    def kernel(pdf):
        near = {int(c): dict(zip(own["v"].tolist(), own["dist"].tolist(), strict=True)) for c, own in pdf.groupby("center")}
        rows = []
        for length in range(1, largest + 1):
            color: dict[int, int] = {}
            holders: list[list[int]] = []
            for v in sorted(near):
                for c, held in enumerate(holders):
                    if all(near[v].get(w, length) < length for w in held):
                        break
                else:
                    c = len(holders)
                    holders.append([])
                color[v] = c
                holders[c].append(v)
            rows.append((length, len(holders)))
        return pd.DataFrame(rows, columns=["l", "boxes"])

    found = _by_component(g, balls(g, largest), kernel, "l int, boxes long", most)
    return found.groupBy("l").agg(F.sum("boxes").alias("boxes"))


def flower_boxes(u: int, v: int, generations: int) -> list[tuple[int, int]]:
    """(diameter, boxes) of a flower with (u + v) ** generations edges, from the finest boxes to a single cycle's.

    A box of step k is a flower of k generations; what the boxes leave is the flower of the others, whose number of
    vertices has the closed form below.
    """
    short, long = sorted((u, v))
    w, diameter, out = u + v, (u + v) // 2, []
    for k in range(1, generations + 1):
        out.append((diameter, ((w - 2) * w ** (generations - k) + w) // (w - 1)))
        diameter = short * diameter + long - short
    return out


def tree_boxes(start: int, t: int, generations: int) -> list[tuple[int, int]]:
    """(diameter, boxes) of the tree of repeated leaf growth: the boxes of step k are the vertices of k steps before."""
    sizes = [1, start]
    while len(sizes) <= generations:
        sizes.append(sizes[-1] + 2 * t * (sizes[-1] - 1))
    return [(3**k - 1, sizes[generations - k]) for k in range(1, generations + 1)]


METHODS = {"memb": memb, "sketch": sketch_cover, "burning": burning, "cbb": lambda g, r: cbb(g, 2 * r)}


def curve(g: Graph, method: str = "memb", first: int = 1, last: int = 1_000_000) -> DataFrame:
    """(radius, size, coverage) for rising radii until one box is enough."""
    rows = []
    for radius in range(first, last + 1):
        centers = materialise(METHODS[method](g, radius), "centers")
        share = coverage(g, centers, radius).first()["coverage"] if method != "cbb" else 1.0
        rows.append((radius, centers.count(), share))
        if rows[-1][1] <= 1:
            break
    return g.vertices.sparkSession.createDataFrame(rows, "radius int, size long, coverage double")
