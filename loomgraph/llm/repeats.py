"""Long repeated word sequences by recompression (operator 9).

Words are named by hashes. In each of `rounds` rounds every symbol falls to the left or the right half by a bit of
its name, and each left symbol followed by a right one becomes a pair named by its two names. Names depend on
content alone, so they agree over all documents without a table of names, and equal word sequences get equal
symbols but near their ends: a symbol of round r is settled by the 2^r words at most on either side of it. Runs of
one symbol never pair (their halves agree), so they stay spelled out; a name for a whole run would depend on words
outside a window.

Every window of `length` words is led by one high-level symbol: of those that it settles, the one with the least
name. Equal windows are led by equal symbols at equal places. A Spark shuffle brings occurrences of a symbol with
its surrounding words together, each with hashes of the windows it leads; where two agree, the repeat is verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.hashing import chain, hashes, mix

HALF = np.uint64(1)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text: exactly what bytes.split() gives."""
    return text.encode().split() if text else []


def symbols(names: np.ndarray, firsts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and names of the symbols after so many rounds over words of several documents.

    `firsts` marks the words that start a document; no pair crosses them.
    """
    at, name, begins = np.arange(names.size), mix(names.copy()), firsts
    for r in range(rounds):
        right = (mix(name + np.uint64(r + 1)) & HALF).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & ~begins[1:])
        gone = np.zeros(name.size, bool)
        gone[pair + 1] = True
        name = name.copy()
        name[pair] = mix(name[pair] * np.uint64(0xC2B2AE3D27D4EB4F) + name[pair + 1] + np.uint64(r))
        at, name, begins = at[~gone], name[~gone], begins[~gone]
    return at, name


def leaders(score: np.ndarray, span: int) -> np.ndarray:
    """For each start of a run of `span` scores the place of its least one, the first of equals."""
    seen = np.lib.stride_tricks.sliding_window_view(score, span)
    return seen.argmin(axis=1) + np.arange(len(seen))


class Windows:
    """The windows of a block of documents, led by symbols."""

    def __init__(self, texts: list[list[bytes]], length: int, rounds: int):
        reach = 2**rounds
        self.before, self.after = reach - 1, 2 * reach  # words a symbol's start needs on its left, and from it on
        count = np.array([len(w) for w in texts], np.int64)
        self.ends = np.cumsum(count)
        self.base = self.ends - count
        names = hashes([w for t in texts for w in t])
        firsts = np.zeros(names.size, bool)
        firsts[self.base[count > 0]] = True
        self.starts = np.zeros(0, np.int64)
        if names.size < length:
            return
        whole = np.flatnonzero(count >= length)
        sizes = count[whole] - length + 1
        if not whole.size:
            return
        self.starts = np.arange(sizes.sum()) + np.repeat(self.base[whole] - (np.cumsum(sizes) - sizes), sizes)
        self.doc = np.repeat(whole, sizes)
        at, name = symbols(names, firsts, rounds)
        score = np.full(names.size, NONE)
        score[at] = name
        lead = leaders(score, length - self.before - self.after + 1)
        self.lead = lead[self.starts + self.before] + 0
        self.hash = chain(names, length)[self.starts]
        context = chain(names, self.before + self.after)
        self.key = context[self.lead - self.before]


ROWS = "key long, k1 long, k2 long, lead long, first long, windows binary"


def _window_rows(batches, length: int, rounds: int, at_once: int):
    """Rows (key, document, leader, first window, hashes) and, with null windows, repeats seen within a block."""

    def block(keys1, keys2, texts):
        w = Windows(texts, length, rounds)
        if not w.starts.size:
            return None
        local = w.starts - w.base[w.doc]
        # Windows that this block holds more than once are known to repeat; one of each goes on as a witness.
        order = np.argsort(w.hash, kind="stable")
        sorted_ = w.hash[order]
        same = sorted_[1:] == sorted_[:-1]
        again = np.zeros(order.size, bool)
        again[order[1:]] = same
        known = again.copy()
        known[order[:-1]] |= same
        out: dict[str, list] = {n: [] for n in ("key", "k1", "k2", "lead", "first", "windows")}
        k1, k2 = np.array(keys1, np.int64), np.array(keys2, np.int64)

        def emit(chosen, groups, payload):
            if not chosen.size:
                return
            cut = np.flatnonzero(np.concatenate([[True], groups]))
            g = chosen[cut]
            out["k1"].append(k1[w.doc[g]])
            out["k2"].append(k2[w.doc[g]])
            out["first"].append(local[g])
            edges = np.append(cut, chosen.size)
            raw = payload[chosen].tobytes() if payload is not None else None
            if payload is None:
                out["key"].append(mix(w.hash[g].copy()).view(np.int64))
                out["lead"].append(np.diff(edges))
                out["windows"] += [None] * g.size
            else:
                out["key"].append(w.key[g].view(np.int64))
                out["lead"].append(w.lead[g] - w.base[w.doc[g]])
                size = payload.itemsize
                out["windows"] += [raw[a * size : b * size] for a, b in zip(edges[:-1], edges[1:], strict=True)]

        going = np.flatnonzero(~again)
        apart = (np.diff(going) != 1) | (w.lead[going[1:]] != w.lead[going[:-1]]) | (w.doc[going[1:]] != w.doc[going[:-1]])
        emit(going, apart, w.hash.astype("<u8"))
        seen = np.flatnonzero(known)
        apart = (np.diff(seen) != 1) | (w.doc[seen[1:]] != w.doc[seen[:-1]])
        emit(seen, apart, None)
        columns = [np.concatenate(out[n]) for n in ("key", "k1", "k2", "lead", "first")]
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(out["windows"], pa.binary())], names=list(out))

    keys1, keys2, texts, size = [], [], [], 0
    for batch in batches:
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = words_of(text.as_py())
            if len(words) < length:
                continue
            keys1.append(a)
            keys2.append(b)
            texts.append(words)
            size += len(words)
            if size >= at_once:
                if (rows := block(keys1, keys2, texts)) is not None:
                    yield rows
                keys1, keys2, texts, size = [], [], [], 0
    if texts and (rows := block(keys1, keys2, texts)) is not None:
        yield rows


FOUND = "k1 long, k2 long, first long, n long, key long, window long"


def _repeated(batches, most: int):
    """From rows sorted by key: the windows that two rows of a key share, as (document, first, count).

    A key with more than `most` rows is not gathered: its windows go on one by one, with a key of their own.
    """

    def found(k1, k2, first, n, key=None, window=None):
        size = len(k1)
        null = pa.nulls(size, pa.int64())
        arrays = [pa.array(x, pa.int64()) for x in (k1, k2, first, n)]
        return pa.record_batch([*arrays, null if key is None else pa.array(key, pa.int64()), null if window is None else pa.array(window, pa.int64())], names=["k1", "k2", "first", "n", "key", "window"])

    def spread(rows: pa.Table):
        """Each window of the rows: row, start, and a 64-bit name from key, place of the leader and hash."""
        sizes = pa.compute.binary_length(rows["windows"]).to_numpy() // 8
        row = np.repeat(np.arange(rows.num_rows), sizes)
        start = np.arange(row.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + rows["first"].to_numpy()[row]
        hashed = np.frombuffer(b"".join(rows["windows"].to_pylist()), "<u8")
        name = mix(rows["key"].to_numpy().view(np.uint64)[row] * np.uint64(0xD6E8FEB86659FD93) + (rows["lead"].to_numpy()[row] - start).astype(np.uint64))
        return row, start, mix(name + hashed)

    def solve(rows: pa.Table):
        row, start, name = spread(rows)
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        hit = np.zeros(order.size, bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        at = np.flatnonzero(hit)
        if at.size:
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(start[at]) != 1) | (np.diff(row[at]) != 0)]))
            n = np.diff(np.append(cut, at.size))
            yield found(rows["k1"].to_numpy()[row[at[cut]]], rows["k2"].to_numpy()[row[at[cut]]], start[at[cut]], n)

    def one_by_one(rows: pa.Table):
        row, start, name = spread(rows)
        yield found(rows["k1"].to_numpy()[row], rows["k2"].to_numpy()[row], start, np.ones(row.size, np.int64), rows["key"].to_numpy()[row], name.view(np.int64))

    carried: list[pa.Table] = []  # rows of the last key, not yet complete
    hot = None  # a key found to have too many rows
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        plain = rows["windows"].is_null().to_numpy()
        if plain.any():
            done = rows.filter(pa.array(plain))
            yield found(done["k1"].to_numpy(), done["k2"].to_numpy(), done["first"].to_numpy(), done["lead"].to_numpy())
            rows = rows.filter(pa.array(~plain))
        if not rows.num_rows:
            continue
        if carried:
            rows = pa.concat_tables([*carried, rows])
        key = rows["key"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        last = cut[-2]
        group = np.repeat(size, size)
        large = group > most
        if hot is not None:
            large |= key == hot
        ready = np.arange(key.size) < last
        for keep, then in (((group > 1) & ~large & ready, solve), (large, one_by_one)):
            if keep.any():
                yield from then(rows.filter(pa.array(keep)).combine_chunks())
        hot = key[-1] if large[-1] else None
        carried = [] if hot is not None else [rows.slice(last)]
    if carried and carried[0].num_rows > 1:
        yield from solve(carried[0].combine_chunks())


def repeated_windows(docs: DataFrame, length: int = 35, rounds: int = 2, at_once: int = 400_000, most: int = 4096) -> DataFrame:
    """Windows of docs(k1, k2, text) that occur more than once: (k1, k2, first, n) runs of window starts.

    (k1, k2) names a row; rows with equal names must have equal texts, and each counts as an occurrence. Runs of
    one document may touch, overlap or repeat. A run stands for n windows, the first at word `first`.
    """
    if length < 4 * 2**rounds:
        raise ValueError("the windows are too short for so many rounds")
    rows = docs.select("k1", "k2", F.col("text").cast("string")).mapInArrow(lambda b: _window_rows(b, length, rounds, at_once), ROWS)
    near = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _repeated(b, most), FOUND)
    # Keys with too many rows: count their windows one by one, with map-side sums.
    from loomgraph import runtime

    near = runtime.materialise(near, "repeated_windows")
    found = near.where("window is null").select("k1", "k2", "first", "n")
    many = near.where("window is not null")
    if many.isEmpty():
        return found
    twice = many.groupBy("key", "window").count().where("count > 1").select("key", "window")
    return found.unionByName(many.join(twice, ["key", "window"], "left_semi").select("k1", "k2", "first", "n"))


KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, length: int = 35, digest: bool = False, **parameters) -> DataFrame:
    """Remove each word of docs(doc_id, text) that a window of `length` words covers whose sequence occurs elsewhere.

    Windows are judged on the input, every occurrence loses its words, also within one document. A row for each
    input row: doc_id, n_words, n_removed and kept_text (kept words joined by one space), or with digest=True
    kept_sha256 in its place. Null and empty texts have no words; texts shorter than a window lose nothing;
    repeated rows are repeats of each other; null doc_ids are allowed; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64(F.lit(1), "doc_id", "text"), "k2": F.xxhash64(F.lit(2), "text", "doc_id")})
    runs = repeated_windows(rows, length, **parameters)
    runs = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    name = "kept_sha256" if digest else "kept_text"

    def keep(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                gone = 0
                if found.is_valid:
                    first, n = (found.values.field(f).to_numpy() for f in ("first", "n"))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + n + length - 1, -1)
                    out = np.cumsum(step[:-1]) > 0
                    gone = int(out.sum())
                    words = [words[k] for k in np.flatnonzero(~out).tolist()]
                counts.append(len(words) + gone)
                removed.append(gone)
                text = b" ".join(words)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return rows.join(runs, ["k1", "k2"], "left").select("doc_id", "text", "runs").mapInArrow(keep, KEPT.replace("kept_text", name))
