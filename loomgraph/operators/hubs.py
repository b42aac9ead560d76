"""A two-hop distance index: labels (v, direction, hub, dist) such that the best common hub gives the distance.

Hubs rank in descending degree, and a hub labels a vertex if no shortest path between them meets a higher one: what searches
that prune by the labels of hubs before them leave. That needs no order, so the hubs of a weak component are dealt to tasks, each with all
arcs of the component; the sizes are checked. Queries are a join of labels. Edge insertions start from stored labels: the searches of
the hubs of both ends resume, a batch of arcs at once, or in large components run again; vertices
come and go while they have no edges; edge removals are not supported.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import BWD, FWD, Graph, GraphError, relabel
from loomgraph.operators.connectivity import connected_components
from loomgraph.runtime import discard, materialise, spread

#: What the index answers for pairs without a path.
NO_PATH = 100
#: Weak components share index tasks by hashes of this many values.
GROUPS = 4096
#: Beyond any distance, and how many places of a table or labels a worker takes at once.
FAR, CELLS = 1 << 29, 1 << 23
#: A task searches from at least so many hubs, and a weak component has at most so many tasks.
HUBS, PARTS = 2048, 128
#: Insertions resume searches in one task where labels and arcs are at most so many, else those searches run again.
RESUMED = 1_000_000
#: Forests of at most so many edges are joined to components in one task.
FOREST = 1_000_000
LABELS = "v long, direction string, hub long, dist int"


class PrunedLabels:
    """The index in memory, for one worker: near[d][v] are neighbours, label[d][v] is {hub rank: distance}."""

    def __init__(self, vertices: list[int], arcs: list[tuple[int, int]], order: dict[int, int] | None = None):
        self.near = {FWD: {v: [] for v in vertices}, BWD: {v: [] for v in vertices}}
        for a, b in arcs:
            self.near[FWD][a].append(b)
            self.near[BWD][b].append(a)
        weight = {v: len(self.near[FWD][v]) + len(self.near[BWD][v]) for v in vertices}
        self.order = dict(enumerate(sorted(vertices, key=lambda v: (-weight[v], v)))) if order is None else dict(sorted(order.items()))
        self.rank = {v: k for k, v in self.order.items()}
        self.label = {FWD: {v: {} for v in vertices}, BWD: {v: {} for v in vertices}}

    def build(self) -> PrunedLabels:
        for rank, hub in self.order.items():
            for d in (FWD, BWD):
                self._search(rank, [(hub, 0)], d)
        return self

    def query(self, u: int, v: int) -> int | None:
        """Distance u -> v by common hubs."""
        out, into = self.label[BWD][u], self.label[FWD][v]
        if len(out) > len(into):
            return min((d + out[h] for h, d in into.items() if h in out), default=None)
        return min((d + into[h] for h, d in out.items() if h in into), default=None)

    def _search(self, rank: int, starts: list[tuple[int, int]], d: str) -> None:
        """Search from the hub along d; label[FWD][v] holds hub -> v, label[BWD][v] holds v -> hub."""
        label, near, ranks, queue = self.label[d], self.near[d], self.rank, deque(starts)
        mine = self.label[BWD if d == FWD else FWD][self.order[rank]]
        while queue:
            v, dist = queue.popleft()
            own = label[v]
            if ranks[v] < rank or own.get(rank, dist + 1) <= dist:
                continue
            small, large = (own, mine) if len(own) < len(mine) else (mine, own)
            for h, there in small.items():
                if there <= dist and h in large and there + large[h] <= dist:
                    break  # a common hub is as near
            else:
                own[rank] = dist
                for w in near[v]:
                    queue.append((w, dist + 1))

    def add_edge(self, u: int, v: int) -> None:
        """Insert the arc u -> v and resume the searches that reach it, in order of rank."""
        self.near[FWD][u].append(v)
        self.near[BWD][v].append(u)
        ways = {FWD: (dict(self.label[FWD][u]), v), BWD: (dict(self.label[BWD][v]), u)}
        for rank in sorted(ways[FWD][0].keys() | ways[BWD][0].keys()):
            for d, (known, start) in ways.items():
                if rank in known:
                    self._search(rank, [(start, known[rank] + 1)], d)

    def rows(self) -> list[tuple[int, str, int, int]]:
        return [(v, d, h, dist) for d in (FWD, BWD) for v, own in self.label[d].items() for h, dist in own.items()]


def _by_vertex(n: int, v: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns sorted by v, after the places where each of n vertices begins."""
    order = np.argsort(v, kind="stable")
    return np.append(0, np.cumsum(np.bincount(v, minlength=n))), *[c[order] for c in columns]


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of first[1] and so on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _least(far: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the least far of every key, in order of key."""
    order = np.lexsort((far, key))
    return order[np.append(True, np.diff(key[order]) != 0)] if len(key) else order


class LabelArrays:
    """The index in arrays, for one worker that inserts arcs; vertices are numbers 0 .. n-1 in order of rank.

    Hubs resume their searches in batches. Those of a batch do not see each other's labels, so what a lower hub of the
    batch covers goes afterwards, and the labels are those of hubs one by one.
    """

    def __init__(self, n: int, arcs: tuple[np.ndarray, np.ndarray], labels: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """arcs (src, dst) and, for each direction, the labels (v, hub, dist) that stand for them."""
        self.n, self.arcs = n, arcs
        self.parts = {d: [_by_vertex(n, *labels[d])] for d in (FWD, BWD)}  # the labels of each are there in any of its parts

    def insert(self, src: np.ndarray, dst: np.ndarray, most_starts: int = 1 << 24) -> None:
        """Insert arcs, at once where their ends have at most most_starts labels, else some after others."""
        size = sum(at[ends + 1] - at[ends] for d, ends in ((FWD, src), (BWD, dst)) for at, _, _ in self.parts[d])
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // most_starts)) + 1
        for a, b in zip(np.split(src, cuts), np.split(dst, cuts), strict=True):
            self._insert(a, b)

    def _insert(self, src: np.ndarray, dst: np.ndarray) -> None:
        n = self.n
        self.arcs = tuple(np.concatenate(c) for c in zip(self.arcs, (src, dst), strict=True))
        self.near = {FWD: _by_vertex(n, *self.arcs), BWD: _by_vertex(n, *self.arcs[::-1])}
        starts = {}
        for d, tail, head in ((FWD, src, dst), (BWD, dst, src)):
            row, hub, far = self._labels(d, tail)
            key = hub * n + head[row]
            use = _least(far, key)
            starts[d] = key[use], far[use] + 1
        hubs = np.union1d(starts[FWD][0] // n, starts[BWD][0] // n)
        at, size, most = 0, 1, max(1, min(128, CELLS // n))
        while at < len(hubs):
            self._resume(hubs[at : at + size], starts)
            at, size = at + size, min(2 * size, most)

    def rows(self, d: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(v, hub, dist) of a direction."""
        v = np.concatenate([np.repeat(np.arange(self.n), np.diff(at)) for at, _, _ in self.parts[d]])
        hub, far = (np.concatenate([part[k] for part in self.parts[d]]) for k in (1, 2))
        use = _least(far, v * self.n + hub)
        return v[use], hub[use], far[use]

    def _labels(self, d: str, vs: np.ndarray) -> list[np.ndarray]:
        """(place in vs, hub, dist) of the labels of vs; old and new distances of a hub may both be there."""
        found = []
        for at, hubs, far in self.parts[d]:
            count = at[vs + 1] - at[vs]
            flat = _spans(at[vs], count)
            found.append((np.repeat(np.arange(len(vs)), count), hubs[flat], far[flat]))
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    def _resume(self, hubs: np.ndarray, starts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """Resume the searches of a batch of hubs in both directions."""
        n, found, tables, fresh = self.n, {}, {}, {}
        for d, other in ((FWD, BWD), (BWD, FWD)):
            row, hub, far = self._labels(other, hubs)
            tables[d] = np.full((len(hubs), n), FAR, np.int32)  # from each hub of the batch, against d, to its own hubs
            np.minimum.at(tables[d], (row, hub), far)
            key, far = starts[d]
            first, last = np.searchsorted(key, [hubs[0] * n, (hubs[-1] + 1) * n])
            key, far = key[first:last], far[first:last]
            found[d] = self._search(d, hubs, np.searchsorted(hubs, key // n) * n + key % n, far, tables[d])
        for d, other in ((FWD, BWD), (BWD, FWD)):
            row, v, far = found[d]
            within = np.full((len(hubs), n), FAR, np.int32)  # the same to lower hubs of the batch, now with what it found
            within[:, hubs] = tables[d][:, hubs]
            by, end, way = found[other]
            place = np.minimum(np.searchsorted(hubs, end), len(hubs) - 1)
            there = hubs[place] == end
            np.minimum.at(within, (place[there], hubs[by[there]]), way[there])
            within[np.arange(len(hubs)), hubs] = FAR
            test = np.flatnonzero((within[:, hubs] < FAR).any(axis=1)[row])
            gone = np.zeros(len(row), bool)
            gone[test] = self._covered(within, row[test], v[test], far[test], [*self.parts[d], _by_vertex(n, v, hubs[row], far)])
            fresh[d] = v[~gone], hubs[row[~gone]], far[~gone]
        for d, new in fresh.items():
            parts = self.parts[d]
            while len(parts) > 1 and len(parts[-1][1]) <= 2 * len(new[0]):  # few parts, and a label moves seldom
                at, *rest = parts.pop()
                new = [np.concatenate(c) for c in zip((np.repeat(np.arange(n), np.diff(at)), *rest), new, strict=True)]
            if len(new[0]):
                parts.append(_by_vertex(n, *new))

    def _search(self, d: str, hubs: np.ndarray, starts: np.ndarray, far: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in hubs, v, dist) that searches along d label, level by level; starts are place * n + v."""
        n, (at, near) = self.n, self.near[d]
        order = np.argsort(far, kind="stable")
        starts, far = starts[order], far[order]
        seen, front = np.zeros(len(hubs) * n, bool), starts[:0]
        found, level, done = [(starts[:0], starts[:0], far[:0])], 0, 0
        while done < len(starts) or len(front):
            level = level if len(front) else far[done]
            upto = np.searchsorted(far, level, "right")
            key, done = np.concatenate([front, starts[done:upto]]), upto
            key = np.unique(key[~seen[key]])
            seen[key] = True
            row, v = key // n, key % n
            row, v = row[v > hubs[row]], v[v > hubs[row]]
            new = ~self._covered(table, row, v, np.full(len(row), level, np.int32), self.parts[d])
            row, v = row[new], v[new]
            found.append((row, v, np.full(len(row), level, np.int32)))
            count = at[v + 1] - at[v]
            front = np.repeat(row * n, count) + near[_spans(at[v], count)]
            level += 1
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _covered(self, table: np.ndarray, row: np.ndarray, v: np.ndarray, dist: np.ndarray, parts: list) -> np.ndarray:
        """Whether a hub of v in one of the parts, which the row of the table reaches, gives at most dist."""
        out, flat_table = np.zeros(len(row), bool), table.ravel()
        for at, hubs, far in parts:
            for skip, most in ((0, 16), (16, len(hubs))):  # mostly one of the first few
                count = np.minimum(at[v + 1] - at[v] - skip, most)
                left = np.flatnonzero((count > 0) & ~out)
                for who in np.split(left, np.flatnonzero(np.diff(np.cumsum(count[left]) // CELLS)) + 1):
                    if len(who):
                        flat = _spans(at[v[who]] + skip, count[who])
                        ways = flat_table.take(np.repeat(row[who] * self.n, count[who]) + hubs[flat]) + far[flat]
                        out[who] = np.minimum.reduceat(ways, np.cumsum(count[who]) - count[who]) <= dist[who]
        return out


class HubSearches:
    """Searches along arcs from many hubs at once, a bit for each, for one worker; vertices are numbers 0 .. n-1 in order of rank.

    Beside what a hub reaches at a level is kept what it reaches past a higher vertex, on any shortest path. The rest are
    its labels, and a hub stops at a level without any.
    """

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.n, (self.at, self.near) = n, _by_vertex(n, src, dst)
        self.hubs_at_once = 64 * max(1, min(8, CELLS // max(1, n, len(src))))

    def thin(self) -> bool:
        """Whether levels from the highest vertex hold so few that their number is what a search costs."""
        seen, front, left = np.zeros(self.n, bool), np.arange(min(self.n, 1)), 64 + self.n // 64
        while len(front) and left:
            seen[front] = True
            front = np.unique(self.near[_spans(self.at[front], self.at[front + 1] - self.at[front])])
            front, left = front[~seen[front]], left - 1
        return not left

    def labels(self, hubs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(v, hub, dist) of some hubs, in ascending order; at most hubs_at_once."""
        k, words = len(hubs), -(-len(hubs) // 64)
        row, front = hubs, np.zeros((k, words), np.uint64)
        front[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        past, seen = np.zeros_like(front), np.zeros((self.n, words), np.uint64)
        seen[row] = front
        found, level = [(hubs, hubs, np.zeros(k, np.int32))], 0
        while len(row):
            level += 1
            count = self.at[row + 1] - self.at[row]
            head, tail = self.near[_spans(self.at[row], count)], np.repeat(np.arange(len(row)), count)
            order = np.argsort(head, kind="stable")
            row, both = self._any(head[order], np.concatenate([front, past], axis=1)[tail[order]])
            front = both[:, :words] & ~seen[row]
            seen[row] |= front
            # Hubs beyond a vertex reach it past itself.
            own = np.clip(np.searchsorted(hubs, row, "right")[:, None] - 64 * np.arange(words), 0, 64)
            beyond = np.where(own < 64, ~np.uint64(0) << np.minimum(own, 63).astype(np.uint64), np.uint64(0))
            past = front & (both[:, words:] | beyond)
            label = front & ~past
            going = np.bitwise_or.reduce(label, axis=0)
            front, past = front & going, past & going
            use = np.flatnonzero(front.any(axis=1))
            row, front, past, label = row[use], front[use], past[use], label[use].ravel()
            where = np.flatnonzero(label)
            bit = np.flatnonzero(np.unpackbits(label[where].astype("<u8").view(np.uint8), bitorder="little"))
            place = where[bit // 64]
            found.append((row[place // words], hubs[place % words * 64 + bit % 64], np.full(len(bit), level, np.int32)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    @staticmethod
    def _any(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys, which are sorted, once each, and the bits that any of their rows has: neighbours are joined until none are left."""
        while (same := key[1:] == key[:-1]).any():
            first = np.flatnonzero(np.append(True, ~same))
            even = np.flatnonzero((np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))) % 2 == 0)
            joined, pair = rows[even], np.append(same, False)[even]
            joined[pair] |= rows[even[pair] + 1]
            key, rows = key[even], joined
        return key, rows


def _check(rows: DataFrame, most_edges: int) -> None:
    if not rows.groupBy("g").count().where(F.col("count") > most_edges).isEmpty():
        raise GraphError("the graph is too large for one index task")


def _components(arcs: DataFrame) -> tuple[DataFrame, Column]:
    """(id, component) of ends of arcs, and where the vertex `id` goes by it: small components go together."""
    named = connected_components(arcs.select("src", "dst"), small=FOREST)
    return named, F.pmod(F.xxhash64(F.coalesce("component", "id")), F.lit(GROUPS)).alias("g")


def _table(ids: np.ndarray, ranks: np.ndarray, d: str, v: np.ndarray, hub: np.ndarray, dist: np.ndarray):
    import pyarrow as pa

    return pa.table({"v": ids[v], "direction": pa.repeat(d, len(v)), "hub": ranks[hub], "dist": dist})


def _searched(part: int, parts: int, rows):
    """Labels of the hubs of one part: rows (kind, a, b) are vertices (id, rank), with the bits of kind for directions to search, and arcs (kind 4)."""
    import pyarrow as pa

    kind, a, b = (rows[c].to_numpy() for c in ("kind", "a", "b"))
    vertex = np.flatnonzero(kind != 4)
    vertex = vertex[np.argsort(b[vertex])]
    ids, ranks, todo, n = a[vertex], b[vertex], kind[vertex], len(vertex)
    by_id = np.argsort(ids)
    ends = [by_id[np.searchsorted(ids, c[kind == 4], sorter=by_id)] for c in (a, b)]
    ways = {FWD: HubSearches(n, *ends), BWD: HubSearches(n, *ends[::-1])}
    out = [_table(ids, ranks, FWD, *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.int32))]
    if (todo == 3).all() and any(way.thin() for way in ways.values()):  # hubs one by one
        if part == 0:
            index = PrunedLabels(list(range(n)), list(zip(*[c.tolist() for c in ends], strict=True)), dict(enumerate(range(n)))).build()
            for d, label in index.label.items():
                size = np.array([len(own) for own in label.values()])
                hub, dist = (np.fromiter((x for own in label.values() for x in pick(own)), np.int64, size.sum()) for pick in (dict.keys, dict.values))
                out.append(_table(ids, ranks, d, np.repeat(np.fromiter(label, np.int64, n), size), hub, dist.astype(np.int32)))
        return pa.concat_tables(out)
    for bit, (d, way) in enumerate(ways.items()):
        hubs = np.flatnonzero(todo >> bit & 1)
        hubs = hubs[np.arange(len(hubs)) // 64 % parts == part]  # words in turn: high hubs have most labels
        for k in range(0, len(hubs), way.hubs_at_once):
            out.append(_table(ids, ranks, d, *way.labels(hubs[k : k + way.hubs_at_once])))
    return pa.concat_tables(out)


def _search(places: DataFrame, arcs: DataFrame, most_edges: int) -> DataFrame:
    """Labels of the hubs places(id, rank, kind, g) along arcs(src, dst) between them; kind is 1 for FWD, 2 for BWD, 3 for both, 0 for neither."""
    rows = places.select("g", "kind", F.col("id").alias("a"), F.col("rank").alias("b"))
    rows = rows.union(arcs.join(places.select(F.col("id").alias("src"), "g"), "src").select("g", F.lit(4), "src", "dst"))
    rows = materialise(rows, "hub_rows")
    _check(rows, most_edges)
    parts = rows.where("kind <> 4").groupBy("g").agg(F.least(F.lit(PARTS), F.ceil(F.count("*") / HUBS)).cast("int").alias("parts"))
    dealt = rows.join(parts, "g").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    keys = ["g", "p", "parts"]
    return spread(dealt, *keys, times=8).groupBy(*keys).applyInArrow(lambda key, rows: _searched(key[1].as_py(), key[2].as_py(), rows), LABELS)


def build(g: Graph, added: DataFrame | None = None, most_edges: int = 5_000_000) -> DataFrame:
    """Labels of a graph, with the arcs of added(seq, src, dst) inserted afterwards.

    `hub` is a rank: hubs are numbered in descending degree, ties by id. No path leaves a weak component, so components
    share nothing but the order of hubs.
    """
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    order = g.vertices.join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "id")
    ranked = order.select("id").rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    ranked = g.vertices.sparkSession.createDataFrame(ranked, "id long, rank long")
    named, group = _components(g.edges)
    places = materialise(ranked.join(named, "id", "left").select("id", "rank", F.lit(3).alias("kind"), group), "hub_places")
    labels = materialise(_search(places, g.edges.select("src", "dst"), most_edges), "hub_labels")
    if added is None:
        return labels
    out = insert(labels, g.edges, added, most_edges)
    discard(labels)
    return out


def _inserted(rows):
    """Labels of one group: rows (kind, a, b, far) are vertices 0 (rank, id), labels 1 and 2, arcs 3, new arcs 4, all by rank."""
    import pyarrow as pa

    kind, a, b, far = (rows[c].to_numpy() for c in ("kind", "a", "b", "far"))
    ranks, at = np.unique(a[kind == 0], return_index=True)
    ids = b[kind == 0][at]
    a, b = np.searchsorted(ranks, a), np.where(kind == 0, 0, np.searchsorted(ranks, b))
    index = LabelArrays(len(ranks), (a[kind == 3], b[kind == 3]), {d: (a[kind == k], b[kind == k], far[kind == k]) for k, d in ((1, FWD), (2, BWD))})
    new = np.unique(a[kind == 4] * len(ranks) + b[kind == 4])
    index.insert(new // len(ranks), new % len(ranks))
    return pa.concat_tables([_table(ids, ranks, d, *index.rows(d)) for d in (FWD, BWD)])


def insert(labels: DataFrame, edges: DataFrame, added: DataFrame, most_edges: int = 5_000_000) -> DataFrame:
    """Labels of edges(src, dst) after the arcs of added(seq, src, dst); only the searches that these reach run again.

    The ends of the arcs must be vertices of the index. Ranks stay. A search that reaches the tail of a new arc (backward:
    the head) only past a higher hub is left to that hub, so the hubs in the labels of the ends are all that run again.
    """
    new = materialise(added.select("src", "dst").distinct(), "added")
    old = edges.select("src", "dst")
    arcs = old.union(new)
    named, group = _components(arcs)
    vertices = labels.where((F.col("dist") == 0) & (F.col("direction") == FWD)).select(F.col("v").alias("id"), F.col("hub").alias("rank"))
    places = materialise(vertices.join(named, "id", "left").select("id", "rank", group), "hub_places")
    if not arcs.select(F.explode(F.array("src", "dst")).alias("id")).join(places, "id", "left_anti").isEmpty():
        raise GraphError("an end of an arc is not in the index")
    of_v, of_src = (places.select(F.col("id").alias(c), "rank", "g") for c in ("v", "src"))
    ends = places.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
    # Groups that have new arcs, and whether these are too large to resume.
    rows = labels.select("v").union(arcs.select("src")).groupBy("v").count().join(of_v, "v").groupBy("g").agg((F.sum("count") > min(RESUMED, most_edges)).alias("large"))
    rows = materialise(rows.join(new.join(of_src, "src").select("g").distinct(), "g"), "hub_groups")
    small, large = rows.where("not large").select("g"), rows.where("large").select("g")

    none, here = F.lit(0), places.join(small, "g")
    rows = here.select(F.lit(0).alias("kind"), F.col("rank").alias("a"), F.col("id").alias("b"), none.alias("far"), "g")
    near = labels.join(of_v.join(small, "g"), "v").select(F.when(F.col("direction") == FWD, 1).otherwise(2), "rank", "hub", "dist", "g")
    rows = rows.union(near)
    for kind, some in ((3, old), (4, new)):
        rows = rows.union(some.join(of_src.join(small, "g"), "src").join(ends, "dst").select(F.lit(kind), "rank", "b", none, "g"))
    resumed = spread(rows, "g", times=8).groupBy("g").applyInArrow(lambda rows: _inserted(rows), LABELS)

    met = [labels.where(F.col("direction") == d).join(new.select(F.col(c).alias("v")).distinct(), "v", "left_semi").select("direction", "hub") for d, c in ((FWD, "src"), (BWD, "dst"))]
    again = materialise(met[0].union(met[1]).distinct(), "hubs_again")
    kind = again.groupBy(F.col("hub").alias("rank")).agg(F.sum(F.when(F.col("direction") == FWD, 1).otherwise(2)).cast("int").alias("kind"))
    inside = places.join(large, "g").join(kind, "rank", "left").select("id", "rank", F.coalesce("kind", none).alias("kind"), "g")
    searched = _search(materialise(inside, "hub_places"), arcs, most_edges)
    kept = labels.join(of_v.join(small, "g", "left_anti").select("v"), "v").join(again, ["direction", "hub"], "left_anti").select("v", "direction", "hub", "dist")
    return materialise(kept.union(resumed).union(searched), "hub_labels")


def add_vertices(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Labels with the vertices ids(id) too, which have no edges yet; they rank after all others."""
    new = ids.select("id").distinct().join(labels.select(F.col("v").alias("id")), "id", "left_anti")
    top = labels.agg(F.coalesce(F.max("hub"), F.lit(-1)).alias("top"))
    ranked = relabel(Graph(new, ids.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0))).crossJoin(top)  # one row
    sides = F.explode(F.array(F.lit(FWD), F.lit(BWD))).alias("direction")
    rows = ranked.select(F.col("id").alias("v"), sides, (F.col("top") + 1 + F.col("new_id")).alias("hub"), F.lit(0).alias("dist"))
    return materialise(labels.union(rows), "hub_labels")


def remove_vertices(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Labels without the vertices ids(id), which must have no edges; others keep their ranks."""
    gone = ids.select(F.col("id").alias("v")).distinct()
    ranks = labels.where("dist = 0").join(gone, "v", "left_semi").select("hub").distinct()
    if not labels.where("dist > 0").join(gone, "v", "left_semi").isEmpty() or not labels.where("dist > 0").join(ranks, "hub", "left_semi").isEmpty():
        raise GraphError("the index cannot remove vertices that have edges")
    return materialise(labels.join(gone, "v", "left_anti").select(*labels.columns), "hub_labels")


def query(labels: DataFrame, pairs: DataFrame, no_path: int = NO_PATH) -> DataFrame:
    """pairs(u, v) with dist: 0 for equal ends, `no_path` where no hub is common."""
    out = labels.where(F.col("direction") == BWD).select(F.col("v").alias("u"), "hub", F.col("dist").alias("du"))
    into = labels.where(F.col("direction") == FWD).select("v", "hub", F.col("dist").alias("dv"))
    met = pairs.join(out, "u").join(into, ["v", "hub"]).groupBy("u", "v").agg(F.min(F.col("du") + F.col("dv")).alias("dist"))
    return pairs.join(met, ["u", "v"], "left").select("u", "v", F.when(F.col("u") == F.col("v"), 0).otherwise(F.coalesce("dist", F.lit(no_path))).alias("dist"))


def _by_end(batches):
    """Labels (v, back, hub, dist) of some vertices, all of theirs, as one row for each vertex and direction: (v, direction, hubs, dists)."""
    import pyarrow as pa

    rows = list(batches)
    if rows:
        v, back, hubs, dists = (c.to_numpy() for c in pa.Table.from_batches(rows).columns)
        order = np.lexsort((hubs, back, v))
        v, back, hubs, dists = v[order], back[order], hubs[order], dists[order]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (back[1:] != back[:-1])))
        for k in range(0, len(first), 1000):
            some = first[k : k + 1000]
            at = np.append(some, first[k + 1000] if k + 1000 < len(first) else len(v)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at - at[0], c[at[0] : at[-1]]) for c in (hubs, dists)]
            yield pa.record_batch([pa.array(v[some]), pa.array(np.where(back[some] == 1, BWD, FWD)), *lists], names=["v", "direction", "hubs", "dists"])


def _meet(no_path: int):
    """For a block of ends u and all v of their key: (u, v, dist), by the labels of v that share a hub with u.

    Hubs that many v have are rows over all v, the most frequent first, so far as these are few; labels of other hubs are scattered.
    """
    import pyarrow as pa

    def flat(column):
        column = column.combine_chunks()
        return column.offsets.to_numpy(), column.flatten().to_numpy()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        us, vs = left["u"].to_numpy(), right["v"].to_numpy()
        (start, own), away = flat(left["hubs"]), flat(left["dists"])[1]
        (at, hubs), far = flat(right["hubs"]), flat(right["dists"])[1]
        short = max(away.max(initial=0), far.max(initial=0)) < 1 << 13
        kind, none = (np.int16, 1 << 14) if short else (np.int32, FAR)
        dist = np.full((len(us), len(vs)), none, kind)
        if len(own) and len(hubs):
            order = np.argsort(hubs, kind="stable")
            place = np.repeat(np.arange(len(vs)), np.diff(at))[order]
            far = far[order].astype(kind)
            known, first, count = np.unique(hubs[order], return_index=True, return_counts=True)
            often = np.argsort(-count, kind="stable")[: 4 * CELLS // len(vs)]
            often = often[count[often] * 16 > len(vs)]
            rows = np.full((len(often), len(vs)), none, kind)
            for row, h in zip(rows, often.tolist(), strict=True):
                row[place[first[h] : first[h] + count[h]]] = far[first[h] : first[h] + count[h]]
            row_of = np.full(len(known), -1)
            row_of[often] = np.arange(len(often))
            there = np.minimum(np.searchsorted(known, own), len(known) - 1)
            met = np.flatnonzero(known[there] == own)  # labels of some u whose hub some v has
            there, via = there[met], np.empty(len(vs), kind)
            ways = (np.searchsorted(start, met, "right") - 1, away[met], row_of[there], first[there], first[there] + count[there])
            for u, d, row, f, t in zip(*[c.tolist() for c in ways], strict=True):
                best = dist[u]
                if row >= 0:
                    np.add(rows[row], kind(d), out=via)
                    np.minimum(best, via, out=best)
                else:
                    where = place[f:t]  # a vertex has a hub once
                    best[where] = np.minimum(best[where], far[f:t] + kind(d))
        dist = dist.astype(np.int32)
        dist[dist >= none] = no_path
        dist[us[:, None] == vs] = 0
        return pa.table({"u": np.repeat(us, len(vs)), "v": np.tile(vs, len(us)), "dist": dist.ravel()})

    return lambda left, right: run(left, right)


def query_by_key(labels: DataFrame, us: DataFrame, vs: DataFrame, no_path: int = NO_PATH, block: int = 8_000_000) -> DataFrame:
    """What query() gives for all pairs of us(u, key) and vs(v, key) with equal keys, each of which must be distinct.

    Pairs without a common hub cost only their row. A task takes some u of a key, for about `block` pairs, and all v of it.
    """
    own = spread(labels.select("v", (F.col("direction") == BWD).cast("long").alias("back"), "hub", "dist"), "v", times=32)
    own = own.mapInArrow(lambda rows: _by_end(rows), "v long, direction string, hubs array<long>, dists array<int>")
    own = materialise(own, "labels_by_vertex")
    none = [F.coalesce("hubs", F.array().cast("array<long>")).alias("hubs"), F.coalesce("dists", F.array().cast("array<int>")).alias("dists")]
    both = us.groupBy("key").agg(F.count("*").alias("nu")).join(vs.groupBy("key").agg(F.count("*").alias("nv")), "key")
    parts = materialise(both.select("key", F.greatest(F.lit(1), F.ceil(F.col("nu") * F.col("nv") / block)).cast("int").alias("parts")), "key_parts")
    out = us.join(own.where(F.col("direction") == BWD).withColumnRenamed("v", "u"), "u", "left").join(parts, "key")
    out = out.select("key", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), "u", *none)
    into = vs.join(own.where(F.col("direction") == FWD), "v", "left").join(parts, "key")
    into = into.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v", *none)
    met = spread(out, "key", "part").groupBy("key", "part").cogroup(spread(into, "key", "part").groupBy("key", "part"))
    return met.applyInArrow(_meet(no_path), "u long, v long, dist int")


def label_of(labels: DataFrame, v: int, direction: str = FWD) -> DataFrame:
    return labels.where((F.col("v") == v) & (F.col("direction") == direction)).select("hub", "dist").orderBy("hub")


def average_label_size(labels: DataFrame, g: Graph) -> DataFrame:
    """One row (size): labels of both directions over vertices."""
    n = g.vertices.agg(F.count("*").alias("n"))
    return labels.agg(F.count("*").alias("k")).crossJoin(n).select((F.col("k") / F.col("n")).alias("size"))  # one row each


def remove_edge(*_):
    raise GraphError("the index cannot remove edges; build it anew")
