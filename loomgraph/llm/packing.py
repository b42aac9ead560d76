"""Packing documents into fixed-capacity sequences by bounded-space online best fit (operator 4)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.hashing import unused
from loomgraph.llm.tokens import encoder


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space.

    Bit f of the bitset is set while some open bin has f units free, so the best fit for a piece of n units is
    the lowest set bit at or above n. When a new bin would be one too many, the fullest open bin closes. Bins
    with no space left are closed at once.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.at[free]
        b = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        """The bin for a piece of n units, and the place in it."""
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.capacity, self.made
            self.made += 1
        left = free - n
        if left:
            if not self.at[left]:
                self.bits |= 1 << left
            self.at[left].append(b)
            self.open += 1
        return b, self.capacity - free


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
PIECES_WITH_IDS = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())])


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text): a document longer than capacity is cut, its first piece being the short one.

    Null texts count as empty, so every row has at least the end id; repeated rows are packed as often as they
    occur; other columns are not read. with_ids adds the ids as little-endian unsigned integers (16 bits where
    the vocabulary allows, else 32), for writing sequences.
    """

    def cut(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            found = enc.batch(batch.column(1), end_id)
            total = np.diff(found.id_edges)
            count = -(-total // capacity)
            doc = np.repeat(np.arange(total.size), count)
            piece = np.arange(doc.size) - np.repeat(np.cumsum(count) - count, count)
            head = total - (count - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            raw = memoryview(found.ids.astype("<u4").tobytes())
            at = (found.id_edges[doc] + start).tolist()
            crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
            if with_ids:
                columns.append(pa.array([found.ids[a : a + n].tobytes() for a, n in zip(at, length.tolist(), strict=True)], pa.binary()))
            yield pa.record_batch(columns, names=[f.name for f in (PIECES_WITH_IDS if with_ids else PIECES)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, PIECES_WITH_IDS if with_ids else PIECES)


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = 4096) -> DataFrame:
    """Give each row of pieces(length, ...) a sequence_id and an offset; all other columns pass through.

    Columns of pieces that have those two names already are replaced.
    Rows are dealt out by a hash of what identifies them and met in hash order, which is as good as random order
    for best fit and the same on every attempt of a task. Each task packs its share with its own `open_bins`
    bins, so it holds no more than those. Pieces as long as the capacity get a sequence each. Lengths must lie
    between 1 and capacity; a length outside fails the job. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    name = unused(pieces.columns, "order")
    keys = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    order = F.xxhash64(F.lit(4), *[F.col(k) for k in keys], F.col("length"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = pieces.withColumn(name, order).repartition(name).sortWithinPartitions(name, *keys)

    def fit(batches):
        bins, top = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            if any(n is None or not 1 <= n <= capacity for n in lengths):
                raise ValueError(f"a piece's length is not between 1 and {capacity}")
            placed = np.array([bins.place(n) for n in lengths], "i8").reshape(-1, 2)
            kept = batch.select([n for n in batch.schema.names if n != name])
            yield pa.record_batch([*kept.columns, pa.array(top + placed[:, 0]), pa.array(placed[:, 1])], names=[*kept.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(fit, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from pack() over pieces with ids: sequence_id, ids (binary), lengths, doc_ids.

    A sequence holds at most `capacity` ids, so its group is bounded.
    """
    part = F.struct("offset", "length", "doc_id", "ids")
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"), F.col("parts.length").alias("lengths"), F.col("parts.doc_id").alias("doc_ids"))
