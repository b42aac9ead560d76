"""Exact Jaccard join of word shingles in metric space, and its components (operator 3).

A document is the set of its 4-word shingles; documents with equal sets are one class. Distance is 1 - Jaccard, a
metric; two classes link at distance 0.15 or less. Width and threshold are parameters; the text here has operator 3's.

First regions: single shingles are the pivots. A set is nearest to the pivots it contains, all at one distance; a
global order (frequent shingles last) breaks the tie, and since a partner within 0.15 may lack some shingles, the
window of a set are its first n - ceil(0.85 n) + 1 shingles: two sets that link share one of them. Within such a
region, 256 equal parts of all shingles are pivots at once: how many shingles of a set lie in each part is its
distance from the part's complement, and by the triangle inequality two sets differ by at least the sum of the
differences of those counts. Sets that are near enough by that bound join, and regions that share sets join into
one. In each of these, documents are the pivots of Voronoi cells: a set goes to the cell of its
nearest pivot and, by the triangle inequality, into every cell whose pivot is at most 2 * 0.15 farther than that.
Sets within 0.15 of one pivot are linked through it, so only pairs that are not yet in one component are compared
further. Cells divide again until they are small. Regions too large for a task divide the same way over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm.hashing import BASE, chain, lower_word_hashes, mix, unused
from loomgraph.operators.connectivity import connected_components

#: Operator 3's words of a shingle and least Jaccard similarity, in percent.
WIDTH = 4
PERCENT = 85
SLACK = 1e-9
#: The order table: its size in bits, fixed, so that it can be broadcast whatever the input.
ORDER_BITS = 20
#: Shingles of a usual class, for what a task can hold.
PER_CLASS = 512
#: Least number of parts of all shingles that a set's shingles are counted in, and most shingles a part on average.
PARTS = 256
PER_PART = 16
#: Shingles that are hashed at once, and bytes of text, unless one text has more.
RUN = 1 << 15
RUN_BYTES = 1 << 18
#: Rows of windows that are compared at once: batches are small, for texts.
MEET_ROWS = 1 << 16
#: Sets of a region whose pairs are all compared, together with those of other small regions; the bytes of parts that are
#: held so at once, and those of one side of the pairs that are compared at once.
FEW = 64
FEW_BYTES = 1 << 22
PAIR_BYTES = 1 << 19


def _shingles(run: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for the whole sequence where it has fewer words."""
    names, count = lower_word_hashes(run)
    every = chain(names, width)  # those that begin in one text and end in another are not taken
    out, begin = [], 0
    for n in count.tolist():
        if n >= width:
            s = np.sort(every[begin : begin + n - width + 1])
            new = s[1:] != s[:-1]
            if not new.all():
                s = s[np.append(True, new)]
        elif n:
            s = mix(chain(names[begin : begin + n], n) + np.uint64(n))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        begin += n
    return out


def shingle_sets(texts, width: int = WIDTH):
    """The shingle hashes of each text of a list or column, made for runs of texts at once: most texts are short."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
    cut = np.flatnonzero(np.diff(size // RUN_BYTES)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)], strict=True):
        yield from _shingles(texts.slice(a, b - a), width)


def shingles_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; one for the whole sequence where it has fewer words."""
    return next(shingle_sets([text], width))


def _signatures(sets: list[np.ndarray]) -> list[int]:
    """A 64-bit name of each set; none is empty."""
    if not sets:
        return []
    size = np.array([s.size for s in sets])
    sums = np.add.reduceat(mix(np.concatenate(sets) + np.repeat(size, size).astype(np.uint64)), np.cumsum(size) - size)
    return mix(sums).view(np.int64).tolist()


def _named(texts, width: int):
    """Each text's shingle hashes and the name of that set, None where it is empty."""

    def named(run):
        names = iter(_signatures([s for s in run if s.size]))
        return ((s, next(names) if s.size else None) for s in run)

    run, held = [], 0
    for s in shingle_sets(texts, width):
        run.append(s)
        held += s.size
        if held >= RUN:
            yield from named(run)
            run, held = [], 0
    yield from named(run)


def _parts(s: np.ndarray) -> bytes:
    """How many shingles of a set lie in each part of all shingles, 255 at most.

    Large sets have more parts, by doubling, so that chance alone brings no two sets near, however large they are.
    """
    bits = max(PARTS.bit_length() - 1, (-(-s.size // PER_PART) - 1).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _far(percent: int) -> float:
    """The largest distance of sets that link."""
    return 1 - percent / 100


def links(overlap, a, b, percent: int = PERCENT):
    """Whether sets of sizes a and b that share `overlap` link."""
    return 100 * overlap >= percent * (a + b - overlap)


# --- signatures and the order of shingles ---------------------------------------------------------------------


def _describe(batches, at_once: int, width: int):
    """Rows of documents (row, doc_id, node, n, parts) and rows of the order table (row null: bucket, count)."""
    names = ["row", "doc_id", "node", "n", "parts"]

    def frequent(sets):
        if not sets:
            return
        value = np.sort(np.concatenate(sets))
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        count = np.diff(first)
        many = count > 1
        bucket = (value[first[:-1][many]] >> np.uint64(64 - ORDER_BITS)).astype(np.int64)
        if bucket.size:
            table = np.zeros(1 << ORDER_BITS, np.int64)
            np.maximum.at(table, bucket, count[many])
            there = np.flatnonzero(table)
            null = pa.nulls(there.size, pa.int64())
            yield pa.record_batch([null, null, pa.array(there), pa.array(table[there]), pa.nulls(there.size, pa.binary())], names=names)

    sets, known, size = [], set(), 0
    for batch in batches:
        nodes, ns, parts = [], [], []
        for s, node in _named(batch.column(2), width):
            nodes.append(node)
            ns.append(s.size)
            parts.append(_parts(s) if s.size else None)
            if s.size and node not in known:
                known.add(node)
                sets.append(s)
                size += s.size
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(ns, pa.int64()), pa.array(parts, pa.binary())], names=names)
        if size >= at_once:
            yield from frequent(sets)
            sets, known, size = [], set(), 0
    yield from frequent(sets)


def _order_table(described: DataFrame) -> np.ndarray:
    """The logarithm of the count of each bucket of shingles, 0 for buckets without a frequent one."""
    counts = described.where("row is null").groupBy("node").agg(F.sum("n").alias("n")).where("n >= 8").toArrow()
    table = np.zeros(1 << ORDER_BITS, np.uint8)
    table[counts["node"].to_numpy()] = np.log2(counts["n"].to_numpy().astype(float)).astype(np.uint8)
    return table


# --- first regions --------------------------------------------------------------------------------------------


def _windows(batches, order, width: int, percent: int, at_once: int = 1 << 16):
    """(pivot shingle, node, n) for the first shingles of each set, a set of the task once (while it is remembered)."""
    known: set[int] = set()
    for batch in batches:
        pivots, nodes, ns = [], [], []
        for s, node in _named(batch.column(0), width):
            if node is None or node in known:
                continue
            if len(known) >= at_once:
                known.clear()
            known.add(node)
            rank = order[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
            first = s[np.argsort(rank, kind="stable")[: s.size - -(-percent * s.size // 100) + 1]]
            pivots.append(first.view(np.int64))
            nodes.append(np.full(first.size, node, np.int64))
            ns.append(np.full(first.size, s.size, np.int64))
        if pivots:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (pivots, nodes, ns)], names=["pivot", "node", "n"])


def _many(batches):
    """The rows of three columns of numbers, some batches together."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1))
        n += batch.num_rows
        if n >= MEET_ROWS:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _met(batches, percent: int):
    """From rows sorted by (pivot, n, node): each set of a region once, where the next smaller or larger set there is near in size."""
    last, kept = None, False  # the row before, and whether it has met the one before that
    for rows in _many(batches):
        if last is not None:
            rows = np.concatenate([last[None], rows])
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        near = (rows[1:, 0] == rows[:-1, 0]) & (100 * rows[:-1, 1] >= percent * rows[1:, 1])
        met = np.append(near, False) | np.insert(near, 0, kept)
        if met[:-1].any():
            yield pa.record_batch([pa.array(np.ascontiguousarray(rows[:-1][met[:-1], k])) for k in (0, 2, 1)], names=["pivot", "node", "n"])
        last, kept = rows[-1], bool(met[-1])
    if kept:
        yield pa.record_batch([pa.array(last[k : k + 1]) for k in (0, 2, 1)], names=["pivot", "node", "n"])


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums over each row of how far two tables of bytes are apart."""
    return (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)


class _Parts:
    """The part counts of sets, compared over as many parts as the smaller of two sets has."""

    def __init__(self, n: np.ndarray, parts: pa.Array, percent: int):
        self.n, self.percent = n, percent
        self.own = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.doubled = (-(-100 // percent) - 1).bit_length()  # how often the parts of a set that may link can have doubled
        self.at = {}  # number of parts: the sets with so many or some more, and their counts over so many
        parts = parts.cast(pa.large_binary())
        edge = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        flat = np.frombuffer(parts.buffers()[2], np.uint8)[edge[0] : edge[-1]]
        widths = np.unique(self.own).tolist()
        counts = {w: flat[np.repeat(self.own == w, self.own)].reshape(-1, w) for w in widths}
        for width in widths:
            who = np.flatnonzero((self.own >= width) & (self.own <= width << self.doubled))
            rows = np.empty((who.size, width), np.uint8)
            for w in np.unique(self.own[who]).tolist():
                rows[self.own[who] == w] = counts[w] if w == width else np.minimum(counts[w].reshape(-1, width, w // width).sum(axis=2, dtype=np.int64), 255)
            self.at[width] = who, rows

    def near(self, i: int) -> np.ndarray:
        """Which sets may link with the i-th: their differences over the parts add up to no more than a link allows."""
        out = []
        for width in (int(self.own[i]) >> d for d in range(self.doubled + 1)):
            if width in self.at:
                who, rows = self.at[width]
                apart = _differences(rows, rows[np.searchsorted(who, i)])
                found = who[links((self.n[who] + self.n[i] - apart) // 2, self.n[i], self.n[who], self.percent)]
                out.append(found if width == self.own[i] else found[self.own[found] == width])
        return np.concatenate(out)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same of pairs of sets: whether each may link."""
        out = np.zeros(i.size, bool)
        less, more = np.minimum(self.own[i], self.own[j]), np.maximum(self.own[i], self.own[j])
        for width, (who, rows) in self.at.items():
            alike = np.flatnonzero((less == width) & (more <= width << self.doubled))
            step = max(1, PAIR_BYTES // width)
            for at in range(0, alike.size, step):
                pair = alike[at : at + step]
                a, b = i[pair], j[pair]
                apart = _differences(rows[np.searchsorted(who, a)], rows[np.searchsorted(who, b)])
                out[pair] = links((self.n[a] + self.n[b] - apart) // 2, self.n[a], self.n[b], self.percent)
        return out


def _join_few(n: np.ndarray, parts: pa.Array, size: np.ndarray, percent: int) -> np.ndarray:
    """Of the sets of small regions, one region of `size` sets after another: the first that each one joins, through others too."""
    begin = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(n.size) - begin
    j = np.repeat(np.arange(n.size), place)  # each set with all before it in its region
    i = begin[j] + np.arange(j.size) - np.repeat(np.cumsum(place) - place, place)
    alike = links(np.minimum(n[i], n[j]), n[i], n[j], percent)
    i, j = i[alike], j[alike]
    near = _Parts(n, parts, percent).may_link(i, j)
    i, j = i[near], j[near]
    root = np.arange(n.size)
    while i.size:
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _joins(batches, most: int, percent: int):
    """From rows (pivot, node, n, parts) sorted by pivot: edges that join the sets of a region that may link.

    All pairs of a region of up to FEW sets are compared; in a larger one every set outside the largest join is held
    against all others, so no pair is missed. A region of more than `most` sets, or of as many bytes of parts as 16
    times so many usual ones, is joined as a whole along its sizes.
    """

    def edges(node, root):
        differ = root != np.arange(node.size)
        if differ.any():
            yield pa.record_batch([pa.array(node[differ]), pa.array(node[root[differ]])], names=["src", "dst"])

    for rows, cut in _runs(batches):
        size = np.diff(cut)
        held = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column(3)).to_numpy(), dtype=np.int64)])
        held = held[cut[1:]] - held[cut[:-1]]
        whole = (size > most) | (held > 16 * most * PARTS)
        few = np.flatnonzero((size > 1) & (size <= FEW) & ~whole)
        for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(held[few]) // FEW_BYTES)) + 1):
            if some.size:
                a, b = some[0], some[-1] + 1
                taken = rows.slice(cut[a], cut[b] - cut[a]).filter(np.repeat(np.isin(np.arange(a, b), some), size[a:b]))
                yield from edges(taken.column(1).to_numpy(), _join_few(taken.column(2).to_numpy(), _one(taken.column(3)), size[some], percent))
        for k in np.flatnonzero((size > 1) & ((size > FEW) | whole)).tolist():
            group = rows.slice(cut[k], size[k])
            node, n = group.column(1).to_numpy(), group.column(2).to_numpy()
            root = np.arange(node.size)
            if whole[k]:
                order = np.argsort(n, kind="stable")
                step = 100 * n[order[:-1]] >= percent * n[order[1:]]
                src, dst = node[order[1:]][step], node[order[:-1]][step]
                if src.size:
                    yield pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])
                continue
            parts, turned = _Parts(n, _one(group.column(3)), percent), np.zeros(node.size, bool)
            i = node.size // 2
            while i is not None:
                turned[i] = True
                found = np.unique(root[parts.near(i)])
                root[np.isin(root, found)] = found[0]
                value, count = np.unique(root, return_counts=True)
                rest = np.flatnonzero(~turned & (root != value[count.argmax()]))
                i = int(rest[0]) if rest.size else None
            yield from edges(node, root)


# --- recursion within a region --------------------------------------------------------------------------------


class _Region:
    """The sets of a region in memory, and the components found so far."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.size = np.array([s.size for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        held = np.bincount(self.flat)
        self.lone = np.add.reduceat((held[self.flat] == 1).astype(np.int32), self.edge[:-1])  # of each set, those that no other set has
        self.mark = np.zeros(held.size, np.int32)
        self.root = np.arange(len(sets))
        # The windows again, with the region's own order, rare shingles first; one that no other set has meets nothing.
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        order = np.lexsort((self.flat, held[self.flat], owner))
        place = np.arange(owner.size) - np.repeat(self.edge[:-1], self.size)
        window = order[(place < (self.size + (-percent * self.size // 100) + 1)[owner]) & (held[self.flat[order]] > 1)]
        self.own_edge = np.searchsorted(owner[window], np.arange(len(sets) + 1))
        self.own = self.flat[window]
        back = np.argsort(self.own, kind="stable")
        self.holder = owner[window][back]
        self.holder_edge = np.searchsorted(self.own[back], np.arange(held.size + 1))

    def part(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members' shingles one after another, and where each begins."""
        sizes = self.size[members]
        begin = np.cumsum(sizes) - sizes
        return self.flat[np.arange(sizes.sum()) + np.repeat(self.edge[members] - begin, sizes)], begin

    def overlaps(self, p: int, part: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        own = self.flat[self.edge[p] : self.edge[p + 1]]
        self.mark[own] = 1
        out = np.add.reduceat(self.mark[part[0]], part[1])
        self.mark[own] = 0
        return out

    def link(self, p: int, members: np.ndarray, overlap: np.ndarray) -> None:
        near = members[links(overlap, self.size[p], self.size[members], self.percent)]
        roots = np.unique(self.root[np.append(near, p)])
        if roots.size > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def _apart(self, members: np.ndarray) -> np.ndarray:
        """Which members are outside the largest component among them."""
        value, count = np.unique(self.root[members], return_counts=True)
        return self.root[members] != value[count.argmax()]

    def near(self, p: int) -> np.ndarray:
        """The sets that share a shingle of their windows with p's."""
        lists = [self.holder[self.holder_edge[x] : self.holder_edge[x + 1]] for x in self.own[self.own_edge[p] : self.own_edge[p + 1]]]
        return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)

    def compare(self, members: np.ndarray) -> None:
        """All pairs of members but those within the largest component, met by their windows."""
        inside = np.zeros(self.root.size, bool)
        inside[members] = True
        for p in members[self._apart(members)].tolist():
            met = self.near(p)
            most = np.minimum(self.size[met] - self.lone[met], self.size[p] - self.lone[p])
            met = met[inside[met] & (self.root[met] != self.root[p]) & links(most, self.size[p], self.size[met], self.percent)]
            if met.size:
                self.link(p, met, self.overlaps(p, self.part(met)))

    def solve(self, members: np.ndarray, pivots: int = 12, small: int = 16) -> None:
        """Link the members: pivots, their Voronoi cells, and so on; up to `small` members are all pivots."""
        apart = self._apart(members)
        if not apart.any():
            return
        if members.size <= small:
            part = self.part(members)
            for p in members.tolist():
                self.link(p, members, self.overlaps(p, part))
            return
        link_far = _far(self.percent)
        # The set with least of its own is nearest to what the others share; the other pivots are spread.
        chosen = np.unique(np.append(members[np.arange(pivots) * members.size // pivots], members[(self.lone[members] / self.size[members]).argmin()]))
        pivots = chosen.size
        part = self.part(members)
        far = np.empty((pivots, members.size))
        for k, p in enumerate(chosen.tolist()):
            shared = self.overlaps(p, part)
            self.link(p, members, shared)
            far[k] = 1 - shared / (self.size[p] + self.size[members] - shared)
        nearest = far.min(axis=0)
        cells, work = [], 0
        for k in range(pivots):
            there = np.flatnonzero(far[k] <= nearest + 2 * link_far + SLACK)
            cell = members[there]
            if cell.size < 2 or not (apart := self._apart(cell)).any():
                continue
            # Members of the largest component matter only within reach of one that is not in it.
            d = far[k][there]
            reach = (d >= d[apart].min() - link_far - SLACK) & (d <= d[apart].max() + link_far + SLACK)
            cells.append(cell[apart | reach])
            work += int(apart.sum()) * cells[-1].size
        if work > 0.7 * self._apart(members).sum() * members.size:
            return self.compare(members)  # sets that are far from all pivots are in all cells
        for cell in cells:
            self.solve(cell)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _runs(batches, key: int = 0):
    """From batches sorted by a key: rows of whole keys, and where each key begins and the last one ends."""
    carried = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if carried is not None:
            rows = pa.concat_tables([carried, rows])
        if not rows.num_rows:
            continue
        keys = rows.column(key).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        if cut.size > 2:
            yield rows.slice(0, cut[-2]), cut[:-1]
        carried = rows.slice(cut[-2])
    if carried is not None and carried.num_rows:
        yield carried, np.array([0, carried.num_rows])


def _groups(batches, key: int = 0):
    """The rows of each key, from batches sorted by it."""
    for rows, cut in _runs(batches, key):
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield rows.slice(a, b - a)


def _solve(batches, percent: int):
    """(src, dst) from rows (region, node, set) sorted by region: each node with the first of its component."""
    for rows in _groups(batches):
        if rows.num_rows < 2:
            continue
        nodes = rows.column(1).to_numpy()
        region = _Region([np.frombuffer(s, "<u8") for s in rows.column(2).to_pylist()], percent)
        region.solve(np.argsort(region.size, kind="stable"))
        linked = np.flatnonzero(region.root != np.arange(nodes.size))
        if linked.size:
            yield pa.record_batch([pa.array(nodes[linked]), pa.array(nodes[region.root[linked]])], names=["src", "dst"])


# --- regions too large for a task ----------------------------------------------------------------------------


CELLS = "cell long, node long, root long, far double, pivot long"


def _to_cells(left: pa.Table, right: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Members of a region (region, salt, node, set) against its pivots (the same, named c_...): their cells.

    A row for each cell whose window a member is in: its distance from the cell's pivot, and its root: the pivot it
    is linked to (of linked pivots the first), or itself. `pivot` is that pivot in one row of each linked member, so the
    links of members and pivots under one root are all in the result, and those need not meet again.
    """
    out: dict[str, list] = {n.split()[0]: [] for n in CELLS.split(", ")}
    kinds = {"cell": pa.int64(), "node": pa.int64(), "root": pa.int64(), "far": pa.float64(), "pivot": pa.int64()}
    if left.num_rows and right.num_rows:
        right = right.sort_by("c_node")
        pivots, n = right["c_node"].to_numpy(), right.num_rows
        region = _Region([np.frombuffer(s, "<u8") for s in [*right["c_set"].to_pylist(), *left["set"].to_pylist()]], percent)
        everyone = np.arange(n + left.num_rows)
        part, far, linked = region.part(everyone), np.empty((n, everyone.size)), np.full(everyone.size, -1)
        for k in range(n):
            shared = region.overlaps(k, part)
            far[k] = 1 - shared / (region.size[k] + region.size - shared)
            linked[(linked < 0) & links(shared, region.size[k], region.size, percent)] = k
            region.link(k, everyone[:n], shared[:n])
        nearest = far.min(axis=0)
        salted = mix(pivots.view(np.uint64) + left["region"].to_numpy()[:1].view(np.uint64) * BASE)
        for x, node in enumerate(left["node"].to_pylist(), n):
            root = int(pivots[region.root[linked[x]]]) if linked[x] >= 0 else node
            pivot = root if linked[x] >= 0 else None
            for k in np.flatnonzero(far[:, x] <= nearest[x] + 2 * _far(percent) + SLACK):
                for name, value in zip(out, (int(salted[k].astype(np.int64)), node, root, far[k, x], pivot), strict=True):
                    out[name].append(value)
                pivot = None
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _divide(members: DataFrame, most: int, pivots: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """One Voronoi round over large regions(region, node, n, set): (links, cells left to solve).

    A region whose cells would hold half of it or more each, on average, stays one cell (see _blocks()).
    """
    picked = members.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64(F.lit(3), "node"), "node"))).where(F.col("k") <= pivots)
    salts = members.groupBy("region").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("n") / (most * PER_CLASS))).cast("int").alias("salts"))
    dealt = members.join(salts, "region").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).select("region", "salt", "node", "set")
    centres = picked.join(salts, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "node", "set")
    centres = centres.toDF("c_region", "c_salt", "c_node", "c_set")
    cells = dealt.groupBy("region", "salt").cogroup(centres.groupBy("c_region", "c_salt")).applyInArrow(lambda a, b: _to_cells(a, b, percent), CELLS)
    cells = runtime.materialise(cells, "voronoi_cells")
    found = cells.where("pivot is not null").select(F.col("node").alias("src"), F.col("pivot").alias("dst"))
    roots = cells.groupBy("cell", "root").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    main = roots.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("cell", "main")
    others = roots.join(main, "cell").where("root <> main").groupBy("cell", "main").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    left = cells.join(others, "cell").where((F.col("root") != F.col("main")) | F.col("far").between(F.col("low") - _far(percent) - SLACK, F.col("high") + _far(percent) + SLACK))
    left = left.select("cell", "node").join(members, "node")
    counts = members.groupBy("region").agg(F.count("*").alias("size"))
    spread = left.groupBy("region").agg(F.count("*").alias("held")).join(counts, "region").select("region", (F.col("held") * 2 > F.col("size") * pivots).alias("stuck"))
    left = left.join(spread, "region").select(F.when(F.col("stuck"), F.col("region")).otherwise(F.col("cell")).alias("region"), "node", "n", "set")
    return found, left.dropDuplicates(["region", "node"])


def _blocks(members: DataFrame, most: int) -> DataFrame:
    """Regions(region, node, n, set) as pairs of blocks, each of which fits a task: exact where pivots don't divide."""
    half = max(1, most // 2)
    blocks = members.groupBy("region").agg(F.ceil(F.greatest(F.count("*") / half, F.sum("n") / (half * PER_CLASS))).cast("int").alias("blocks"))
    own = members.join(blocks, "region").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    both = own.select("region", "node", "set", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
    return both.select(F.xxhash64("region", F.least("b", "c"), F.greatest("b", "c")).alias("region"), "node", "set")


def _large(members: DataFrame, most: int) -> DataFrame:
    """(region) of more than `most` classes, or of more shingles than so many usual ones have."""
    sizes = members.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    return runtime.materialise(sizes.where((F.col("size") > most) | (F.col("shingles") > most * PER_CLASS)).select("region"), "large_regions")


# --- the join -------------------------------------------------------------------------------------------------


def classes(docs: DataFrame, at_once: int = 1_000_000, most: int = 4096, pivots: int = 16, depth: int = 3, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The set class of each row of docs(doc_id, text), and the component of each class that links with another.

    The first table has row (a hash of doc_id and text), doc_id, node and n: `node` names the row's shingle set and is
    null where that is empty, `n` is its size. The second has node and component, which names the linked classes. Every row comes
    back, repeated rows and null doc_ids too; null and empty texts have n 0 and link with nothing; whole texts are
    read; other columns are not. Regions of more than `most` classes (or PER_CLASS times as many shingles) are divided
    over tasks, at most `depth` times, and then compared in pairs of blocks. A shingle has `width` words, and classes
    of at least `percent` % Jaccard similarity link.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    described = rows.select("row", "doc_id", "text").mapInArrow(lambda b: _describe(b, at_once, width), "row long, doc_id long, node long, n long, parts binary")
    described = runtime.materialise(described, "shingle_sets")
    order = spark.sparkContext.broadcast(_order_table(described))  # 2^ORDER_BITS bytes
    own = described.where("row is not null")
    # One row speaks for each class.
    speakers = own.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.max("parts").alias("parts"))

    windows = rows.select("text").where("text is not null").mapInArrow(lambda b: _windows(b, order.value, width, percent), "pivot long, node long, n long")
    met = windows.select("pivot", "n", "node").repartition("pivot").sortWithinPartitions("pivot", "n", "node").mapInArrow(lambda b: _met(b, percent), "pivot long, node long, n long")
    met = runtime.materialise(met, "shared_windows")
    held = met.select("pivot", "node").join(speakers.select("node", "n", "parts"), "node").select("pivot", "node", "n", "parts")
    joins = held.repartition("pivot").sortWithinPartitions("pivot", "node").mapInArrow(lambda b: _joins(b, 4096, percent), "src long, dst long").distinct()
    regions = connected_components(joins, small=0).select(F.col("id").alias("node"), F.col("component").alias("region"))
    speakers = runtime.materialise(speakers.drop("parts").join(regions, "node"), "speakers")

    def sets(batches):
        for batch in batches:
            made = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(3), width)]
            yield pa.record_batch([*batch.columns[:3], pa.array(made, pa.binary())], names=["region", "node", "n", "set"])

    # A plan that is the same at every size: never the speakers to all texts.
    members = rows.select("row", "text").join(speakers.hint("shuffle_hash"), "row").dropDuplicates(["row"]).select("region", "node", "n", "text").mapInArrow(sets, "region long, node long, n long, set binary")
    large = _large(speakers, most)
    found, linked = [members], None
    if not large.isEmpty():
        members = runtime.materialise(members, "region_sets").dropDuplicates(["region", "node"])
        found = [members.join(large, "region", "left_anti")]
        for _ in range(depth):
            got, members = _divide(members.join(large, "region", "left_semi"), most, pivots, percent)
            linked = got if linked is None else linked.union(got)
            members = runtime.materialise(members, "region_sets")
            large = _large(members, most)
            found.append(members.join(large, "region", "left_anti"))
            if large.isEmpty():
                break
        else:
            found.append(_blocks(members.join(large, "region", "left_semi"), most))
    found = [part.select("region", "node", "set") for part in found]
    todo = found[0]
    for more in found[1:]:
        todo = todo.unionByName(more)
    stars = todo.repartition("region").sortWithinPartitions("region", "node").mapInArrow(lambda b: _solve(b, percent), "src long, dst long")
    if linked is None:
        joined = stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    else:
        joined = connected_components(stars.union(linked), small=0).select(F.col("id").alias("node"), "component")
    joined = joined.unionByName(joined.select(F.col("component").alias("node"), "component"))  # a star's centre too
    joined = runtime.materialise(joined.distinct(), "linked_classes")
    return own.select("row", "doc_id", "node", "n"), joined


def _spread_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left joined (left outer) with right, which has each key once, without taking a hot key's rows to one task.

    Keys that hold more than 1/share of left are at most `share` rows: those are broadcast, the rest is shuffled.
    """
    total = left.count()
    hot = left.groupBy(key).count().where(F.col("count") > max(100, total // share)).select(key)
    hot = runtime.materialise(hot.join(right, key, "left"), "hot_keys")
    many = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, "left")
    return rest.unionByName(many.select(*rest.columns))


def components(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach; see classes().

    Documents with empty sets are components of their own. Null doc_ids are met but never name a component.
    """
    own, joined = classes(docs, **parameters)
    worded = own.where("node is not null").select("doc_id", "node", "n")
    # Sums of copies are made per class, and of classes per component, before anything meets.
    least = worded.groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = joined.join(least, "node")
    named = _spread_join(joined, linked.groupBy("component").agg(F.min("least").alias("first")), "component").select("node", "first")
    labels = least.join(named, "node", "left").select("node", F.coalesce("first", "least").alias("component_id"))
    found = _spread_join(worded, runtime.materialise(labels, "component_ids"), "node")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.unionByName(own.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stay when one document of each component does: the least doc_id's.

    Of repeated rows one stays; documents without a word link with nothing and all stay. All columns are kept.
    """
    own, joined = classes(docs, **parameters)
    first = own.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("w"))
    named = first.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("w").alias("w"))
    row, id_ = unused(docs.columns, "row"), unused(docs.columns, "id")
    winners = named.select(F.col("w.row").alias(row), F.col("w.doc_id").alias(id_)).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumns({row: F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), id_: F.col("doc_id").cast("long")})
    same = (keyed[row] == winners[row]) & keyed[id_].eqNullSafe(winners[id_])
    kept = keyed.join(winners, same, "left_semi").dropDuplicates([row, id_]).select(*docs.columns)
    return kept.unionByName(docs.where(~worded))
