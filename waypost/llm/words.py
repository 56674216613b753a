"""Words and word windows of whole Arrow batches as numpy arrays.

Texts are handled as their UTF-8 bytes. All word patterns used here have only
ASCII separators, so cutting bytes and cutting characters is the same. Nulls
count as empty texts, and no word or window ever crosses a document's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Words of more bytes are hashed one by one.
LONG = 256
#: Words or windows that are worked on at once.
STRETCH = 1 << 14
#: A Mersenne prime: window hashes are polynomials modulo it, so no sequence of words and its mirror cancel.
PRIME = (1 << 61) - 1
_rng = np.random.Generator(np.random.PCG64(20240131))
#: For each of two independent hashes: the seed of a word's hash and the base of a window's.
_SEEDS = [int(x) for x in _rng.integers(1, 2**63, size=2)]
_BASES = [int(x) for x in _rng.integers(1 << 40, PRIME, size=2)]
_STEP = U64(0xD1342543DE82EF95)
#: The bytes that count of a block that ends a word, by their number.
_ENDS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def table_of(separators: bytes | range) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: `[^\x20\x09-\x0D]+`
SPACED = table_of(b" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = table_of([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: `\n`-split lines
LINES = table_of(b"\n")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Words:
    """Words of a batch, in order; ``first[d]:first[d + 1]`` are those of text ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, second: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, second)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    inside = member[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = False
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def words_of(column: pa.Array, member: np.ndarray = SPACED, fold: bool = False) -> Words:
    """Words of a string array; ``fold`` lower-cases A-Z first."""
    data, offsets = bytes_of(column)
    return split(_FOLD[data] if fold else data, offsets, member)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes a step for all spans at once; ``second`` gives independent ones.

    Each step is a bijection of the eight bytes, so equally long spans of up to eight bytes never collide.
    """
    size, out = end - start, np.empty(len(start), dtype=U64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    blocks = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    heads = mix(np.arange(LONG + 1, dtype=U64) * _STEP + U64(_SEEDS[second]))
    for low in range(0, len(start), STRETCH):  # stretches that stay in a processor's cache
        part = slice(low, low + STRETCH)
        first, n = start[part], np.minimum(size[part], LONG)
        value = mix(heads[n] ^ (blocks[first] & _ENDS[np.minimum(n, 8)]))
        rest = np.flatnonzero(n > 8)
        for at in range(8, LONG, 8):
            if not len(rest):
                break
            value[rest] = mix(value[rest] ^ (blocks[first[rest] + at] & _ENDS[np.minimum(n[rest] - at, 8)]))
            rest = rest[n[rest] > at + 8]
        out[part] = value
    key = _SEEDS[second].to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which a window of ``k`` words of one text starts."""
    room = np.maximum(np.diff(first) - k + 1, 0)
    n = int(room.sum())
    if not n:
        return np.zeros(0, np.int64)
    ends = np.cumsum(room)
    return np.arange(n) + np.repeat(first[:-1] - (ends - room), room)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.minimum(x, x - U64(PRIME))  # below the prime the difference wraps and is larger


def _times(x: np.ndarray, factor: int) -> np.ndarray:
    """x * factor modulo ``PRIME``, both below it, by halves of 31 bits."""
    high, low = x >> U64(31), x & U64(0x7FFFFFFF)
    f_high, f_low = U64(factor >> 31), U64(factor & 0x7FFFFFFF)
    middle = high * f_low + low * f_high
    return _reduced(
        U64(2) * (high * f_high) + (middle >> U64(30)) + ((middle & U64(0x3FFFFFFF)) << U64(31)) + low * f_low
    )


def polynomials(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Rabin-Karp hashes of all ``k``-windows of a word-hash sequence, below ``PRIME``; ends of texts ignored.

    Window i is sum(hashes[i + t] * base ** t) modulo ``PRIME``. Windows of
    doubled length come from two of half of it, so the cost is log2(k) products.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    base, out = _BASES[second], np.empty(n, dtype=U64)
    for at in range(0, n, STRETCH):
        m = min(STRETCH, n - at)
        power, length = _reduced(hashes[at : at + m + k - 1]), 1  # all windows of ``length`` words
        total, done = None, 0
        while True:
            if k & length:
                part = power[done : done + m]
                total = part if total is None else _reduced(total + _times(part, pow(base, done, PRIME)))
                done += length
            if 2 * length > k:
                break
            power = _reduced(power[:-length] + _times(power[length:], pow(base, length, PRIME)))
            length *= 2
        out[at : at + m] = total
    return out


def rolling(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """``polynomials``, scrambled over 64 bits. ``second`` is the independent hash, for independent ``hashes``."""
    return mix(polynomials(hashes, k, second) + U64(k))


def covered(n: int, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + k, -1)
    return np.cumsum(marks[:-1]) > 0


def small(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has at most ``limit`` bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = bytes_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = min(to, n)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
