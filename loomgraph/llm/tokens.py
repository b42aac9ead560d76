"""Token ids of whole texts, and the fixed-shape Arrow files that hold them (operator 10).

`Encoder` gives the same ids as the tokenizers library gives for the whole text, but asks the library's model only
for words it has not met: byte-level BPE never merges across a space that follows a visible character, so texts are
cut there, the distinct pieces of a batch are looked up, and the ids are gathered from those. Texts whose white space
makes such a cut unsafe go through slower exact paths. The caches are bounded and are emptied when full.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import runtime

# The pre-tokens of byte-level BPE for texts of the letters below U+0250, ASCII marks and white space.
LETTER, DIGIT, SPACE = "A-Za-zÀ-ÖØ-öø-ɏ", "0-9", r"\t-\r\x1c-\x20"
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{LETTER}{DIGIT}{SPACE}\0]+|[{SPACE}]+(?![^{SPACE}\0])|[{SPACE}]+|\0")
#: Texts for which PRE_TOKEN is exact, whatever Unicode version the library knows.
KNOWN = re.compile(rf"[{LETTER}\t-\r\x20-\x7e]*")
KNOWN_RE2 = rf"\A[{LETTER}\t-\r\x20-\x7e]*\z"
#: Pieces that are empty or end in white space.
LOOSE_RE2 = r"(?:\A|[\t-\r\x1c-\x20\x{85}\p{Z}])\z"
#: Stands between pieces that are looked up together.
MARK = "\0"


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: visible Latin-1 bytes are themselves, others follow U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


def _joined(texts: pa.Array, mark: str) -> str:
    """The texts one after another with a mark between them."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts.cast(pa.large_string())), pa.scalar(mark, pa.large_string()))[0].as_py()


class _Pieces(dict):
    """Piece of a text -> the bytes of its ids."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(piece)
        if len(self) >= self.most:
            self.clear()
        self[piece] = out
        return out


@dataclass
class Encoded:
    """A batch of texts as runs of pieces: `codes` into a table of ids, and the edges of each text in `codes`."""

    codes: np.ndarray
    edges: np.ndarray
    table: np.ndarray  # ids of the distinct pieces, one after another
    first: np.ndarray  # where each of them begins in the table
    size: np.ndarray  # and how many ids it has
    texts: pa.Array  # the distinct pieces, the first `spaced` of which follow a space
    spaced: int
    uncut: int  # the first piece that is a whole text

    @cached_property
    def sizes(self) -> np.ndarray:
        """Ids of each piece."""
        return self.size[self.codes]

    @cached_property
    def id_edges(self) -> np.ndarray:
        """Where each text's ids begin, and the end of the last."""
        return np.concatenate([[0], np.cumsum(self.sizes)])[self.edges]

    @cached_property
    def ids(self) -> np.ndarray:
        """The ids of all texts one after another."""
        ends = np.cumsum(self.sizes)
        total = int(ends[-1]) if ends.size else 0
        return self.table[np.repeat(self.first[self.codes] - (ends - self.sizes), self.sizes) + np.arange(total)]


class Encoder:
    """Ids of texts by a tokenizers file; equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    ids_bytes() packs ids as little-endian unsigned integers of `dtype`: 16 bits where the vocabulary allows.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path) as f:
            kind = json.load(f)
        pre = kind["pre_tokenizer"] or {}
        #: Whether words can be handed to the model itself; other kinds of files go through the whole library.
        self.plain = kind["model"]["type"] == "BPE" and kind["normalizer"] is None and kind["post_processor"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        self.letters = _byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Pieces(self._by_model, most)
        self.foreign = _Pieces(self._by_library, most // 10)

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _by_model(self, word: str) -> bytes:
        """The ids of one pre-token; none for the mark between pieces."""
        if word == MARK:
            return b""
        spelled = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        """The ids of a text that is not cut."""
        if self.plain and KNOWN.fullmatch(text) and not any(a in text for a in self.added):
            return b"".join(map(self.words.__getitem__, PRE_TOKEN.findall(text)))
        return self._by_library(text)

    def ids_bytes(self, text: str) -> bytes:
        """The ids of one text."""
        return self.batch(pa.array([text], pa.large_string())).ids.tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids_bytes(text), self.dtype)

    def _pieces(self, pieces: pa.Array, heads: pa.Array) -> tuple[bytes, np.ndarray]:
        """Ids of all pieces, each after a space, and of heads, without one; and the number of ids of each."""
        both = pa.concat_arrays([pieces, heads])
        odd = np.flatnonzero(~pc.match_substring_regex(both, KNOWN_RE2).to_numpy(zero_copy_only=False))
        if odd.size:  # these are left out of the joined text and asked for one by one
            both = pc.if_else(pa.array(np.isin(np.arange(len(both)), odd)), pa.scalar("", both.type), both)
        spaced = _joined(both.slice(0, len(pieces)), MARK + " ")
        joined = f" {spaced}{MARK}" * bool(len(pieces)) + _joined(both.slice(len(pieces)), MARK) + MARK * bool(len(heads))
        found = list(map(self.words.__getitem__, PRE_TOKEN.findall(joined)))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        ends = np.cumsum(size)[size == 0]  # only marks have no id
        each = np.diff(ends, prepend=0)
        raw = b"".join(found)
        if odd.size:
            given = np.flatnonzero(each * np.isin(np.arange(each.size), odd))  # a piece left out is the lone space before it
            kept = np.repeat(~np.isin(np.arange(each.size), given), each)
            raw = np.frombuffer(raw, self.dtype)[kept].tobytes()
            each[given] = 0
            texts = pa.concat_arrays([pieces, heads]).take(pa.array(odd)).to_pylist()
            asked = [self.foreign[" " + t if k < len(pieces) else t] for k, t in zip(odd.tolist(), texts, strict=True)]
            edges = (np.cumsum(each)[odd] * self.dtype.itemsize).tolist()
            out, at = [], 0
            for edge, ids in zip(edges, asked, strict=True):
                out += [raw[at:edge], ids]
                at = edge
            raw = b"".join([*out, raw[at:]])
            each[odd] = [len(ids) // self.dtype.itemsize for ids in asked]
        return raw, each

    def batch(self, texts: pa.Array, end_id: int | None = None) -> Encoded:
        """The ids of an Arrow array of texts (null: empty), each followed by end_id where one is given."""
        if not len(texts):
            none = np.zeros(0, np.int64)
            return Encoded(none, np.zeros(1, np.int64), none.astype(self.dtype), none, none, pa.array([], pa.string()), 0, 0)
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        first = parts.offsets.to_numpy().astype(np.int64)
        first, flat = first - first[0], parts.flatten().dictionary_encode()
        codes, pieces = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        # A piece that ends in white space, or is empty, makes the cuts beside it unsafe.
        loose = pc.match_substring_regex(pieces, LOOSE_RE2).to_numpy(zero_copy_only=False)
        whole = np.add.reduceat(loose[codes], first[:-1], dtype=np.int64) > 0 if self.plain else np.ones(len(texts), bool)
        for a in self.added:
            whole |= pc.fill_null(pc.match_substring(texts, a), False).to_numpy(zero_copy_only=False)
        # The first piece of a text has no space before it; a text that is not cut is one piece of its own.
        heads = np.flatnonzero(~whole)
        head_codes = codes[first[:-1][heads]]
        codes[first[:-1][heads]] = len(pieces) + np.arange(heads.size)
        more: list[bytes] = []
        uncut = texts.filter(pa.array(whole))
        if whole.any():
            kept = np.repeat(~whole, np.diff(first))
            kept[first[:-1][whole]] = True
            codes[first[:-1][whole]] = len(pieces) + heads.size + np.arange(int(whole.sum()))
            first = np.concatenate([[0], np.cumsum(np.where(whole, 1, np.diff(first)))])
            codes = codes[kept]
            more = [self._whole(t.as_py() or "") for t in uncut]
        if end_id is not None:
            more.append(np.array([end_id], self.dtype).tobytes())
            codes = np.insert(codes, first[1:], len(pieces) + heads.size + len(more) - 1)
            first = first + np.arange(first.size)
        used = np.zeros(len(pieces), bool)
        used[codes[codes < len(pieces)]] = True
        first_pieces = pieces.take(pa.array(head_codes))
        raw, size = self._pieces(pc.if_else(pa.array(used), pieces, pa.scalar("", pieces.type)), first_pieces)
        size = np.concatenate([size, np.fromiter(map(len, more), np.int64, len(more)) // self.dtype.itemsize])
        return Encoded(codes, first, np.frombuffer(raw + b"".join(more), self.dtype), np.cumsum(size) - size, size, pa.concat_arrays([pieces, first_pieces, pc.fill_null(uncut, "")]), len(pieces), len(pieces) + heads.size)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; kept between tasks, so its caches stay warm."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def strings(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one at a time, null as the empty text."""
    return (x.as_py() or "" for x in column)


# --- operator 10: the file format -----------------------------------------------------------------------------


def filesystem(uri: str):
    """The Arrow file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes ids as record batches of fixed-size lists: `ids` [length] and `mask` [length], false over padding."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch_rows: int):
        self.kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.dtype, self.length, self.most = dtype, length, batch_rows * length
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.size += len(ids) // self.dtype.itemsize
        if self.size >= self.most:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        whole = ids.size if last else ids.size // self.length * self.length
        self.waiting, self.size = [ids[whole:].tobytes()], ids.size - whole
        full = -(-whole // self.length) * self.length
        if full:
            values = np.zeros(full, self.dtype)
            values[:whole] = ids[:whole]
            mask = np.arange(full) < whole
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()


class SequenceFile:
    """Random access to a file of SequenceWriter; local files are memory-mapped, so a row is a view, not a copy."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.source = pa.memory_map(path) if files.type_name == "local" else files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = [self.reader.get_batch(k) for k in range(self.reader.num_record_batches)]
        self.first = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.first[-1])

    def _values(self, k: int) -> np.ndarray:
        return self.batches[k].column(0).flatten().to_numpy()

    def __getitem__(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of one sequence."""
        k = int(np.searchsorted(self.first, row, "right")) - 1
        at = (row - int(self.first[k])) * self.length
        mask = self.batches[k].column(1).slice(row - int(self.first[k]), 1).flatten().to_numpy(zero_copy_only=False)
        return self._values(k)[at : at + self.length], mask

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids [start, stop) of the file as one run, whatever sequences they lie in."""
        out = []
        edges = self.first * self.length
        k = int(np.searchsorted(edges, start, "right")) - 1
        while start < stop:
            end = min(stop, int(edges[k + 1]))
            out.append(self._values(k)[start - int(edges[k]) : end - int(edges[k])])
            start, k = end, k + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, "<u2")

    def close(self) -> None:
        self.source.close()


MANIFEST = "shard int, ids_uri string, docs_uri string, n_docs long, n_ids long, n_sequences long"


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, length: int = 1024, end_id: int = 2, batch_rows: int = 1024) -> DataFrame:
    """Encode docs(doc_id, text) and write them as Arrow files in ascending doc_id order; returns the manifest.

    A shard is one range of doc_id: `*.ids.arrow` holds equal-length sequences with masks, `*.docs.arrow` holds
    doc_id, start and length (in ids of the shard) of its documents. Every attempt of a task writes names of its
    own, and only those of attempts that succeed reach the manifest. Null texts are empty (only the end id);
    equal doc_ids are ordered by text; null doc_ids come first; other columns are not read; an empty table gives
    an empty manifest. The manifest has a row for each shard: shard, URIs, n_docs, n_ids, n_sequences.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        import uuid

        enc, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        files, top = filesystem(folder)
        doc_ids, lengths, out = [], [], None
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(top, recursive=True)
                name = f"{shard:06d}-{uuid.uuid4().hex}"
                sink = files.open_output_stream(f"{top}/{name}.ids.arrow")
                out = SequenceWriter(sink, enc.dtype, length, batch_rows)
            if batch.num_rows:
                found = enc.batch(batch.column(1), end_id)
                out.add(found.ids.tobytes())
                doc_ids.append(batch.column(0))
                lengths.append(np.diff(found.id_edges))
        if out is None:
            return
        out.close()
        sink.close()
        n = np.concatenate(lengths)
        table = pa.table({"doc_id": pa.chunked_array(doc_ids, pa.int64()), "start": np.cumsum(n) - n, "length": n})
        with files.open_output_stream(f"{top}/{name}.docs.arrow") as sink, pa.ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
        total = int(n.sum())
        uri = f"{folder}/{name}"
        yield pa.RecordBatch.from_pylist([{"shard": shard, "ids_uri": uri + ".ids.arrow", "docs_uri": uri + ".docs.arrow", "n_docs": len(n), "n_ids": total, "n_sequences": -(-total // length)}], pa.schema([("shard", pa.int32()), ("ids_uri", pa.string()), ("docs_uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_sequences", pa.int64())]))

    return runtime.materialise(ordered.mapInArrow(write, MANIFEST), "token_manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "ids_uri", "docs_uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, path = filesystem(row["docs_uri"])
                with files.open_input_file(path) as f:
                    docs = pa.ipc.open_file(f).read_all()
                ids = SequenceFile(row["ids_uri"])
                starts, lengths = docs["start"].to_numpy(), docs["length"].to_numpy()
                crcs = [crc32_of_ids(ids.span(s, s + n)) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield from pa.table({"doc_id": docs["doc_id"], "start": starts + row["base"], "n_tokens": lengths, "ids_crc32": pa.array(crcs, pa.int64())}).to_batches(max_chunksize=50_000)
                ids.close()

    # One small row stands for one shard: deal the rows out so that each shard is a task of its own.
    n = max(1, manifest.count())
    return placed.repartitionByRange(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
