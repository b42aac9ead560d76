"""Word hashes and mixing shared by the operators on words and shingles, and names for columns that they add."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd multiplier for polynomial hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def chain(names: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every run of `length` consecutive names (one for each start that has so many after it)."""
    n = names.size - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = names[:n].copy()
    for k in range(1, length):
        out *= BASE
        out += names[k : n + k]
    return mix(out)


#: Of each byte: whether it is white space, and A-Z lower-cased; of each number of bytes: the mask of so many in 64 bits.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed together with other words; longer ones are hashed one by one.
_LONG = 64


def lower_word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, A-Z lower-cased, one text after another, and how many words each text has.

    The bytes of all texts are taken at once: eight at a time are a number, and those of a word are mixed in turn.
    """
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    texts = texts.fill_null("").cast(pa.large_binary())
    edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(edge[-1] - edge[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    flat = np.frombuffer(texts.buffers()[2], np.uint8)[edge[0] : edge[-1]]
    edge = edge - edge[0]
    held = ~_SPACE[flat]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    cut = edge[(edge > 0) & (edge < size)]  # a word ends where its text does
    first[cut], last[cut - 1] = held[cut], held[cut - 1]
    begin = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - begin
    lower = np.zeros(size + 8, np.uint8)
    lower[:size] = _LOWER[flat]
    eight = np.ndarray((size,), "<u8", lower, strides=(1,))
    out = mix((eight[begin] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * BASE)
    rest = np.flatnonzero(length > 8)
    for k in range(8, _LONG, 8):
        out[rest] = mix(out[rest] + (eight[begin[rest] + k] & _MASK[np.minimum(length[rest] - k, 8)]))
        rest = rest[length[rest] > k + 8]
    for i in rest.tolist():
        out[i] = xxhash.xxh3_64_intdigest(lower[begin[i] : begin[i] + length[i]].tobytes())
    return out, np.diff(np.searchsorted(begin, edge))


def unused(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column has it (names do not differ by case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
