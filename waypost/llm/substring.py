"""Exact removal of long repeated word sequences by Rabin-Karp window hashes.

Every window of ``k`` words of every text is hashed. A task sorts the hashes
of many texts, keeps each once with the smallest doc_id it saw, and ships them
as sorted, compressed blocks to partitions by the hash's range; so a partition
gets a repeated window at most once from each block, however many copies there
are. A partition reads its ranges one after the other, counts the hashes of one
and sends back, for each block's document that isn't the first, the hash to
remove. These meet the texts again in groups of documents, of which a task
holds the hashes of one at a time while the texts stream by; there, windows to
remove merge into maximal word intervals.

``BITS`` bits of two polynomials modulo 2 ** 61 - 1, over independent hashes of the
words and under different bases, decide that windows are equal; words aren't
compared again. At 1.5e13 windows, about 100 TB of text,
a third of a pair of different windows is expected to be taken for equal; at
1.5e12, a three-hundredth. Windows are judged on the
input, never on what is left.

Edge cases: null and empty texts, and texts shorter than a window, lose
nothing. Rows that repeat a doc_id are one document and don't repeat each
other. Rows without doc_id neither remove words elsewhere nor lose any; they
are spread by their texts. A task needs about twenty times the bytes of its
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm import words as W
from waypost.llm.shared import parts

U64 = np.uint64
#: Windows that a task gathers before it sorts and ships them.
BLOCK = 1 << 20
#: Windows of a block that a range should get at least, and ranges a partition at most.
RANGE, RANGES = 1 << 10, 16
BITS = 88
_CODEC = pa.Codec("zstd", 1)


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns as one block of byte planes, each compressed by itself if its bytes lie close, and so may shrink."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        planes = np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T)
        close = (np.ptp(planes, axis=1) < 200).tolist() if len(c) else [False] * c.itemsize
        for plane, shrinks in zip(planes, close, strict=True):
            raw = plane.tobytes()
            small = _CODEC.compress(raw, asbytes=True) if shrinks else raw
            small = raw if len(small) >= len(raw) else small
            out += [len(small).to_bytes(4, "little"), small]
    return b"".join(out)


def unpack(block: bytes, *types) -> list[np.ndarray]:
    n, at, out = int.from_bytes(block[:8], "little"), 8, []
    for kind in map(np.dtype, types):
        planes = np.empty((kind.itemsize, n), np.uint8)
        for plane in planes:
            size = int.from_bytes(block[at : at + 4], "little")
            raw = block[at + 4 : at + 4 + size]
            plane[:] = np.frombuffer(raw if size == n else _CODEC.decompress(raw, n, asbytes=True), np.uint8)
            at += 4 + size
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
    return out


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ranges of equal width of the hash space, in its order."""
    return (((hashes >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


def _by_group(key: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The stretches of an ascending key below ``n``."""
    edges = np.searchsorted(key, np.arange(n + 1))
    for g in np.flatnonzero(np.diff(edges)):
        yield int(g), slice(int(edges[g]), int(edges[g + 1]))


def _owner(doc: np.ndarray, groups: int) -> np.ndarray:
    """A document's group; ``_group_column`` is the same in Spark."""
    return np.mod(doc ^ (doc >> 17) ^ (doc >> 31), groups).astype(np.int32)


def _group_column(groups: int) -> Column:
    doc = F.col("doc_id")
    spread = F.coalesce(
        doc.bitwiseXOR(F.shiftright(doc, 17)).bitwiseXOR(F.shiftright(doc, 31)),
        F.xxhash64("text", F.spark_partition_id())
    )
    return F.pmod(spread, F.lit(groups)).cast("int")


def _returned(doc: np.ndarray, first: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(document group, block of (doc_id, hash to remove))."""
    group = _owner(doc, groups)
    order = np.lexsort((first, doc, group))
    doc, first, group = doc[order], first[order], group[order]
    for g, part in _by_group(group, groups):
        yield g, pack(doc[part], first[part])


_SENT = pa.schema([("bucket", pa.int32()), ("back", pa.bool_()), ("data", pa.binary())])


def _window_hashes(found: W.Words, k: int):
    """Starts of the windows, and ``BITS`` of their two hashes as 64 bits and the rest."""
    starts = W.window_starts(found.first, k)
    one = W.polynomials(found.hashes(), k)[starts]
    two = W.polynomials(found.hashes(second=True), k, second=True)[starts]
    return starts, W.mix(one | (two << U64(61))), ((two >> U64(3)) & U64((1 << BITS - 64) - 1)).astype(np.uint32)


def _distinct(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows sorted by their hashes, where each run of equal ones starts, and which are later than the first."""
    order = np.argsort(a)
    a, b, doc = a[order], b[order], doc[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((b, a))
        a, b, doc = a[order], b[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(doc, heads)
    return a, b, doc, heads, least, doc > np.repeat(least, np.diff(np.append(heads, len(a))))


def _windows(k: int, buckets: int):
    def ship(held: list) -> pa.RecordBatch | None:
        a, b, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(a):
            return None
        a, b, doc, heads, least, later = _distinct(a, b, doc)
        rows = [(g, True, block) for g, block in _returned(doc[later], a[later], buckets)]
        a, b = a[heads], b[heads]
        rows += [
            (g, False, pack(np.diff(a[part], prepend=U64(0)), b[part], least[part])) for g,
            part in _by_group(_bucket(a, buckets), buckets)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SENT.types, strict=True)], schema=_SENT
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in W.small(batches):
            found = W.words_of(W.column(batch, "text"))
            starts, a, b = _window_hashes(found, k)
            held.append((a, b, W.column(batch, "doc_id").to_numpy(zero_copy_only=False)[found.text[starts]]))
            size += len(a)
            if size >= BLOCK:
                if out := ship(held):
                    yield out
                held, size = [], 0
        if held and (out := ship(held)):
            yield out

    return run


_BACK = pa.schema([("grp", pa.int32()), ("data", pa.binary())])


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of rows with equal keys."""
    if len(keys[0]):
        new = np.append(True, np.any([key[1:] != key[:-1] for key in keys], axis=0))
        heads = np.flatnonzero(new).tolist()
        yield from zip(heads, [*heads[1:], len(keys[0])], strict=True)


def _count(buckets: int):
    """Of rows sorted by bucket, those to be sent back, a bucket at a time."""

    def counted(blocks: list[bytes]) -> Iterator[tuple[int, bytes]]:
        if blocks:
            delta, b, doc = zip(*(unpack(x, U64, np.uint32, np.int64) for x in blocks), strict=True)
            a, _, doc, _, _, later = _distinct(
                np.concatenate([np.cumsum(x, dtype=U64) for x in delta]), np.concatenate(b), np.concatenate(doc)
            )
            yield from _returned(doc[later], a[later], buckets)

    def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=_BACK
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            buckets_, back, data = W.column(batch, "bucket").to_numpy(), W.column(batch, "back").to_numpy(
                zero_copy_only=False
            ), W.column(batch, "data")
            for low, high in _runs(buckets_, back):
                blocks = data.slice(low, high - low).to_pylist()
                if back[low]:  # decided within its block, on its way to its group
                    yield batch_of([(int(buckets_[low]), x) for x in blocks])
                    continue
                if buckets_[low] != bucket:
                    yield batch_of(list(counted(held)))
                    bucket, held = buckets_[low], []
                held += blocks
        yield batch_of(list(counted(held)))

    return run


_SPAN = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))
_KEPT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", _SPAN),
        ("text", pa.string())
    ]
)


def _by_document(blocks: list[bytes]) -> dict[int, np.ndarray]:
    """The hashes to remove of each document."""
    doc, first = (np.concatenate(x) for x in zip(*(unpack(x, np.int64, U64) for x in blocks), strict=True))
    order = np.argsort(doc, kind="stable")
    doc, first = doc[order], first[order]
    heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return dict(zip(doc[heads].tolist(), np.split(first, heads[1:]), strict=True))


def _cut(k: int):
    """Of rows sorted by group, each group's hashes before its texts, what is left of the texts."""

    def left(texts: pa.RecordBatch, flagged: dict[int, np.ndarray]) -> pa.RecordBatch:
        ids = W.column(texts, "doc_id")
        n_words, n_removed, spans, kept = [], [], [], []
        for doc, text in zip(ids.to_pylist(), W.column(texts, "text").cast(pa.binary()).to_pylist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            gone, cut = 0, []
            if doc is not None and (hit := flagged.get(doc)) is not None:
                found = W.words_of(pa.array([text], pa.binary()))
                starts, a, _ = _window_hashes(found, k)
                out = W.covered(len(words), starts[np.isin(a, hit)], k)
                gone = int(out.sum())
                if gone:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
                    cut = [{"from_word": int(x), "to_word": int(y)} for x, y in edge.reshape(-1, 2)]
                    words = compress(words, (~out).tolist())
            n_removed.append(gone)
            spans.append(cut)
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, _SPAN),
                pa.array(kept, pa.binary()).cast(pa.string())
            ],
            schema=_KEPT
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, flagged = None, [], {}
        for batch in batches:
            groups, is_text, data = W.column(batch, "grp").to_numpy(), W.column(batch, "is_text").to_numpy(
                zero_copy_only=False
            ), W.column(batch, "data")
            for low, high in _runs(groups, is_text):
                if groups[low] != group:
                    group, held, flagged = groups[low], [], {}
                if not is_text[low]:
                    held += data.slice(low, high - low).to_pylist()
                    continue
                if held:
                    flagged, held = _by_document(held), []
                for texts in W.small([batch.slice(low, high - low)]):
                    yield left(texts, flagged)

    return run


def remove_repeats(docs: DataFrame, k: int = 50) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, removed, text.

    ``removed`` lists the maximal word intervals [from_word, to_word) that a
    window of ``k`` words covers whose words also start in a document with a
    smaller doc_id; ``text`` is the other words, joined by one space.
    """
    n = parts(docs.sparkSession)
    ranges = max(1, min(RANGES, BLOCK // (n * RANGE)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = lambda df, column: df.repartitionById(n, F.floor(F.col(column) / ranges).cast("int"))
    sent = texts.filter("doc_id is not null").mapInArrow(
        _windows(k, n * ranges), "bucket int, back boolean, data binary"
    )
    back = own(sent, "bucket").sortWithinPartitions("bucket", "back").mapInArrow(
        _count(n * ranges), "grp int, data binary"
    )
    both = texts.select(
        _group_column(n * ranges).alias("grp"), F.lit(True).alias("is_text"), "doc_id", "text",
        F.lit(None).cast("binary").alias("data")
    )
    both = both.unionByName(
        back.select(
            "grp", F.lit(False).alias("is_text"), F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("string").alias("text"), "data"
        )
    )
    return own(both, "grp").sortWithinPartitions("grp", "is_text").mapInArrow(
        _cut(k),
        "doc_id long, n_words long, n_removed long, removed array<struct<from_word: long, to_word: long>>, text string"
    )
