"""Edit-aware token counts (operator 7): a segment tree of pre-token counts per document, updated where edits touch.

A text is cut into segments at spaces between visible characters, where byte-level BPE always ends a pre-token;
each segment has a length in characters and a count of tokens, and a tree holds their sums. An edit replaces a range
of characters: the segments it touches, with one more on either side as context, are joined, cut and encoded again,
and only the sums above them change.

The leaves of all trees are kept in a table (segment_trees()), from which apply_edits() makes the next one: the
sums are read back, and text that no edit touches is never encoded again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm.tokens import Encoder, encoder

#: A space after a visible character and before one: the text before it and from it on are encoded apart.
CUT = re.compile(r"(?<=\S) (?=\S)")


def _cuts(text: str, size: int) -> list[int]:
    """Every size-th place at which a text may be cut."""
    return [m.start() for m in CUT.finditer(text)][size - 1 :: size]


class TokenTree:
    """Token counts of one text under edits.

    Segments hold up to `size` cuts' worth of text each; `nodes` is a complete binary tree in an array whose leaf k
    is at `leaves + k` with (characters, tokens). A segment that edits have made empty stays as an empty leaf.
    """

    def __init__(self, text: str, count, size: int = 32, leaves: tuple[list[int], list[int]] | None = None):
        """Cut and count the text, or take the characters and tokens of its segments from `leaves`."""
        self.count, self.encoded = count, 0
        if leaves is None:
            edges = [0, *_cuts(text, size), len(text)]
        else:
            edges = [0, *np.cumsum(leaves[0]).tolist()]
            if edges[-1] != len(text):
                raise ValueError("the leaves are not of this text")
        self.segments = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.leaves = 1 << max(0, len(self.segments) - 1).bit_length()
        self.chars = [0] * (2 * self.leaves)
        self.tokens = [0] * (2 * self.leaves)
        for k, s in enumerate(self.segments):
            self.chars[self.leaves + k], self.tokens[self.leaves + k] = len(s), self._encode(s) if leaves is None else leaves[1][k]
        for k in range(self.leaves - 1, 0, -1):
            self._sum(k)

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the segments."""
        n = len(self.segments)
        return self.chars[self.leaves : self.leaves + n], self.tokens[self.leaves : self.leaves + n]

    def _encode(self, segment: str) -> int:
        self.encoded += len(segment)
        return self.count(segment)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.segments)

    def find(self, at: int) -> tuple[int, int]:
        """The segment that holds character `at`, and the place in it; the end of the text is in the last one."""
        if at >= self.chars[1]:
            k = len(self.segments) - 1
            return k, len(self.segments[k]) + at - self.chars[1]
        k = 1
        while k < self.leaves:
            k *= 2
            if at >= self.chars[k]:
                at -= self.chars[k]
                k += 1
        return k - self.leaves, at

    def replace(self, start: int, stop: int, new: str) -> None:
        """Replace the characters [start, stop) of the present text."""
        if not 0 <= start <= stop <= len(self):
            raise ValueError("the edit is outside the text")
        first, a = self.find(start)
        last, b = self.find(max(start, stop - 1))
        region = "".join(self.segments[first : last + 1])
        region = region[:a] + new + region[a + stop - start :]
        # Take context on either side until both borders are safe cuts again.
        low, high = first, last
        while low > 0 and (low == first or not self._safe(self.segments[low - 1], region)):
            low -= 1
            region = self.segments[low] + region
        while high + 1 < len(self.segments) and (high == last or not self._safe(region, self.segments[high + 1])):
            high += 1
            region += self.segments[high]
        while low > 0 and not self._safe(self.segments[low - 1], region):
            low -= 1
            region = self.segments[low] + region
        # The region's new text goes back into as many leaves as it came from.
        room = high - low + 1
        cuts = [m.start() for m in CUT.finditer(region)]
        step = max(1, -(-(len(cuts) + 1) // room))
        edges = [0, *cuts[step - 1 :: step][: room - 1], len(region)]
        parts = [region[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        parts += [""] * (room - len(parts))
        touched = set()
        for k, part in enumerate(parts, low):
            if part != self.segments[k]:
                self.segments[k] = part
                self.chars[self.leaves + k], self.tokens[self.leaves + k] = len(part), self._encode(part)
                touched.add((self.leaves + k) // 2)
        while touched and touched != {0}:
            for k in touched:
                self._sum(k)
            touched = {k // 2 for k in touched if k > 1}

    @staticmethod
    def _safe(left: str, right: str) -> bool:
        """Whether the texts can be encoded apart: a visible character, then a space and a visible one."""
        return bool(left) and not left[-1].isspace() and len(right) > 1 and right[0] == " " and not right[1].isspace()


# What the redaction edits look for, and what they put in its place.
EDITS = ((re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "[EMAIL]"), (re.compile(r"\+?\d[\d ()-]{7,}\d"), "[PHONE]"), (re.compile(r"AKIA[A-Z0-9]{16,}"), "[KEY]"))


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, stop, new) that hide mail addresses, telephone numbers and access keys; they do not overlap."""
    found = sorted((m.start(), m.end(), new) for pattern, new in EDITS for m in pattern.finditer(text))
    out: list[tuple[int, int, str]] = []
    for edit in found:
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def leaves_of(enc: Encoder, texts: pa.Array, size: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments of a batch of texts: their characters and tokens one after another, and the edges of each text."""
    found = enc.batch(texts)
    spaced = np.arange(len(found.texts)) < found.spaced
    long = pc.utf8_length(found.texts).to_numpy().astype(np.int64) + spaced
    firm = spaced & pc.match_substring_regex(found.texts, r"\A[^\t-\r\x1c-\x20\x{85}\p{Z}]").to_numpy(zero_copy_only=False)
    codes, edges = found.codes, found.edges
    place = np.arange(codes.size) - np.repeat(edges[:-1], np.diff(edges))
    begin = np.flatnonzero((place == 0) | ((place % size == 0) & firm[codes]))
    chars, tokens = (np.add.reduceat(x, begin) if begin.size else x[:0] for x in (long[codes], found.sizes))
    at = np.searchsorted(begin, edges)
    # Texts that the encoder takes whole (white space in runs, added tokens) are cut where that is safe.
    uncut = np.flatnonzero(found.codes[edges[:-1]] >= found.uncut)
    if uncut.size:
        parts = [[t[a:b] for a, b in zip([0, *c], [*c, len(t)], strict=True)] for t in texts.take(pa.array(uncut)).fill_null("").to_pylist() for c in [_cuts(t, size)]]
        flat = [p for own in parts for p in own]
        counts = np.diff(enc.batch(pa.array(flat, pa.string())).id_edges)
        many = np.ones(len(texts), np.int64) * np.diff(at)
        many[uncut] = [len(own) for own in parts]
        new = np.concatenate([[0], np.cumsum(many)])
        where = np.repeat(np.isin(np.arange(len(texts)), uncut), many)
        out = np.empty(new[-1], np.int64), np.empty(new[-1], np.int64)
        kept = ~np.repeat(np.isin(np.arange(len(texts)), uncut), np.diff(at))
        out[0][~where], out[1][~where] = chars[kept], tokens[kept]
        out[0][where], out[1][where] = [len(p) for p in flat], counts
        (chars, tokens), at = out, new
    return chars, tokens, at


TREES = "row long, doc_id long, chars array<int>, tokens array<int>"


def segment_trees(docs: DataFrame, tokenizer_path: str, size: int = 32) -> DataFrame:
    """The kept form of the segment tree of each row of docs(doc_id, text): characters and tokens of its leaves.

    `row` is a hash of doc_id and text and names the tree from then on. A row for each input row; null texts are
    empty (one empty leaf); texts are read whole; other columns are not read; an empty table gives an empty one.
    """

    def build(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            chars, tokens, edges = leaves_of(enc, batch.column(2), size)
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32())) for x in (chars, tokens)]
            yield pa.record_batch([*batch.columns[:2], *lists], names=["row", "doc_id", "chars", "tokens"])

    return _named(docs).mapInArrow(build, TREES)


def _named(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


LOG = "row long, text string, edits array<struct<start:int,stop:int,new:string>>"


def edit_log(docs: DataFrame, edits=redactions) -> DataFrame:
    """(row, text, edits) of the rows of docs(doc_id, text) that have an edit, each once.

    `edits(text)` gives (start, stop, new) ascending and without overlap, in characters.
    """

    def find(batches):
        for batch in batches:
            out = [(r, t, e) for r, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (t := x.as_py()) and (e := edits(t))]
            lists = pa.array([[dict(zip(("start", "stop", "new"), e, strict=True)) for e in own] for _, _, own in out], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())])))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), lists], names=["row", "text", "edits"])

    return _named(docs).select("row", "text").mapInArrow(find, LOG).dropDuplicates(["row"])


EDITED = TREES + ", n_tokens long, n_edits long, n_tokens_after long, n_chars_encoded_again long, text string"


def apply_edits(trees: DataFrame, log: DataFrame, tokenizer_path: str) -> DataFrame:
    """The trees after the edits of log(row, text, edits), with counts; a table that later edits can start from.

    Returns row, doc_id and leaves as segment_trees() does, n_tokens before, n_edits, n_tokens_after, the characters
    that the edits had encoded again, and the new text where there were edits. Rows without an edit pass with their sums;
    nothing of them is encoded. log holds a row once; rows of log without a tree are left out.
    """

    def run(batches):
        enc = encoder(tokenizer_path)

        def count(segment: str) -> int:
            return len(enc.ids_bytes(segment)) // enc.dtype.itemsize

        for batch in batches:
            row, doc_id, chars, tokens, texts, edits = batch.columns
            sums = [sum(t) for t in tokens.to_pylist()]
            after, n_edits, again = list(sums), [0] * len(sums), [0] * len(sums)
            changed: dict[int, tuple] = {}
            for k in np.flatnonzero(edits.is_valid().to_numpy(zero_copy_only=False)).tolist():
                tree = TokenTree(texts[k].as_py(), count, leaves=(chars[k].as_py(), tokens[k].as_py()))
                own = edits[k].as_py()
                for e in reversed(own):
                    tree.replace(e["start"], e["stop"], e["new"])
                after[k], n_edits[k], again[k], changed[k] = tree.n_tokens, len(own), tree.encoded, (*tree.kept(), tree.text)
            if changed:
                chars, tokens = (pa.array([changed[k][j] if k in changed else x for k, x in enumerate(c.to_pylist())], pa.list_(pa.int32())) for j, c in enumerate((chars, tokens)))
            new = pa.array([changed[k][2] if k in changed else None for k in range(len(sums))], pa.string())
            yield pa.record_batch([row, doc_id, chars, tokens, *(pa.array(x, pa.int64()) for x in (sums, n_edits, after, again)), new], names=[c.split()[0] for c in EDITED.split(", ")])

    return trees.select(*[c.split()[0] for c in TREES.split(", ")]).join(log, "row", "left").mapInArrow(run, EDITED)


def edited_counts(docs: DataFrame, tokenizer_path: str, edits=redactions) -> DataFrame:
    """Count the tokens of each row of docs(doc_id, text), apply edits(text) one by one and count again.

    A row for each input row: doc_id, n_tokens before, n_edits, n_tokens_after, and the characters that the edits
    had encoded again. Null texts are empty (0 tokens); texts are read whole; repeated rows give repeated results;
    other columns are not read. `edits` gives (start, stop, new) ascending and without overlap. The trees are kept
    as a table in the shared folder between the two counts.
    """
    trees = runtime.materialise(segment_trees(docs, tokenizer_path), "segment_trees")
    found = apply_edits(trees, edit_log(docs, edits), tokenizer_path)
    return found.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_encoded_again")
