"""Token ids as flat binary files.

Texts are dealt out by ranges of doc_id, so a shard is a stretch of the
corpus; each task encodes its texts in ascending doc_id order and writes

* ``shard-N.bin``: the ids, unsigned little-endian, 16 bits wide where the
  vocabulary allows, else 32, each document closed by ``end_id``;
* ``shard-N.idx``: signed 64-bit offsets in ids, one more than documents;
* ``shard-N.ids``: the documents' ids, signed 64-bit.

The manifest (a Parquet table: shard, path, docs, tokens, width) closes the
write. A shard's base, the number of ids before it, is a prefix sum over the
manifest. Readers map local files into memory and read others by stretches.
Writing is idempotent: a task that runs again replaces its files by equal ones.

Encoding calls the tokenizer once for each distinct unit a process meets: a
word, the punctuation after it, white space. A byte-level vocabulary never
merges across a space that a word follows, nor from a letter or digit to
punctuation (but for the apostrophe), so a text's ids are those of its units
in order. Units of letters alone go straight to the tokenizer's merge model,
which skips its splitting; that this is the same is tried out on words when an
encoder is made. Texts with white space other than space, tab, newline and
carriage return are encoded whole, and so are those that hold one of the
tokenizer's added tokens, before which white space is split in another way.

Edge cases: null and empty texts are written as ``end_id`` alone. Rows that
repeat a doc_id follow each other in an order that hashes of their texts give.
Rows without doc_id come first, marked by the smallest integer in ``.ids``.
Ranges are cut between texts of one doc_id, too, so many rows without one aren't
one shard. An empty table gives no shard. A task needs about ten times the bytes
of its longest text.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waypost.llm import words as W
from waypost.llm.shared import beside, file_system, parts, put_file, scratch

#: Letters of the Latin blocks up to U+024F, all of which are letters but two.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_UNIT = re.compile(
    rf" ?[0-9{_LETTERS}]+(?=[ \t\n\r!-&(-/:-@\[-`{{-~]|\Z)| ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
)
_WORD = re.compile(rf" ?[{_LETTERS}]+")
#: Characters that some Unicode version takes for white space, but those four.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_NO_ID = np.iinfo(np.int64).min
#: Distinct units that an encoder remembers.
_MEMORY = 3 << 18


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as little-endian bytes of ``width`` bytes an id."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # units come once; ``known`` is the memory
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.whole = re.compile("|".join([_ODD.pattern, *added]))
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        probes = [" word", "Word", " straße", "déjà", " ĳsselmeerĦ", "unbekanntes", "a"]
        self.direct = self._merged(probes) == self._raw(probes)

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.type).tobytes() for x in found]

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space but a leading space, from the merge model alone."""
        kind = "H" if self.type.itemsize == 2 else "I"
        spelled = "\n".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        found = ([x.id for x in tokens] for tokens in map(self.model.tokenize, spelled))
        return [struct.pack(f"<{len(ids)}{kind}", *ids) for ids in found]

    def _learn(self, units: set[str]) -> None:
        words = [u for u in units if _WORD.fullmatch(u)] if self.direct else []
        self.known.update(zip(words, self._merged(words) if words else [], strict=True))
        rest = list(units.difference(words))
        self.known.update(zip(rest, self._raw(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _MEMORY:
            for unit in list(islice(self.known, len(self.known) // 2)):  # the longest known
                del self.known[unit]
        known = self.known
        units = [None if self.whole.search(x) else _UNIT.findall(x) for x in texts]
        pieces = [None if x is None else list(map(known.get, x)) for x in units]
        missing = [[] if x is None else [i for i, p in enumerate(x) if p is None] for x in pieces]
        new = {own[i] for own, at in zip(units, missing, strict=True) for i in at}
        if new:
            self._learn(new)
        for own, got, at in zip(units, pieces, missing, strict=True):
            for i in at:
                got[i] = known[own[i]]
        return [self._raw([text])[0] if got is None else b"".join(got) for text, got in zip(texts, pieces, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_path: str) -> Encoder:
    """The process's encoder, which outlives a task where Spark reuses its Python workers."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def _write(root: str, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        end = np.array([end_id], dtype=own.type).tobytes()
        sizes: list[int] = []
        ids: list[np.ndarray] = []

        def body():
            for batch in W.small(batches):
                texts = ["" if x is None else x for x in W.column(batch, "text").to_pylist()]
                pieces = own.encode(texts)
                sizes.extend(len(x) // own.type.itemsize + 1 for x in pieces)
                ids.append(W.column(batch, "doc_id").fill_null(_NO_ID).to_numpy())
                yield end.join(pieces) + end

        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}"
        started = body()
        first = next(started, None)
        if first is None:
            return

        def all_of():
            yield first
            yield from started

        put_file(f"{path}.bin", all_of())
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype("<i8")
        put_file(f"{path}.idx", [offsets.tobytes()])
        put_file(f"{path}.ids", [np.concatenate(ids).astype("<i8").tobytes()])
        values = [shard, path, len(sizes), int(offsets[-1]), own.type.itemsize]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(values, _MANIFEST.types, strict=True)], schema=_MANIFEST
        )

    return run


_MANIFEST = pa.schema(
    [("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]
)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, root: str | None = None, shards: int | None = None
) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text) below ``root``; returns the manifest, stored there too."""
    spark = docs.sparkSession
    given, root = root, root or scratch(spark, "tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    dealt = texts.repartitionByRange(shards or parts(spark), *order).sortWithinPartitions(*order, "text")
    written = dealt.mapInArrow(
        _write(root, tokenizer_path, end_id), "shard int, path string, docs long, tokens long, width int"
    )
    return beside(written, given, "manifest")


class Shard:
    """The files of one shard: mapped where they are local, else read by stretches."""

    def __init__(self, path: str, width: int):
        from pyarrow import fs

        self.type, self.path = np.dtype(f"<u{width}"), path
        self.offsets, self.ids = self._array(".idx", "<i8"), self._array(".ids", "<i8")
        files, inner = file_system(f"{path}.bin")
        self.mapped = np.memmap(inner, dtype=self.type, mode="r") if isinstance(files, fs.LocalFileSystem) else None
        self.file = None if self.mapped is not None else files.open_input_file(inner)

    def _array(self, ending: str, kind: str) -> np.ndarray:
        files, inner = file_system(self.path + ending)
        with files.open_input_stream(inner) as f:
            return np.frombuffer(f.read(), dtype=kind)

    def tokens(self, start: int, end: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:end]
        return np.frombuffer(
            self.file.read_at((end - start) * self.type.itemsize, start * self.type.itemsize), dtype=self.type
        )


_READ = "doc_id long, start long, n_tokens long, ids binary"


def _read(limit: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], row["width"])
                offsets, n, at = shard.offsets, row["docs"], 0
                while at < n:
                    to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
                    raw = shard.tokens(int(offsets[at]), int(offsets[to])).astype("<u4").tobytes()
                    own = (offsets[at : to + 1] - offsets[at]) * 4
                    lists = pa.Array.from_buffers(
                        pa.large_binary(), to - at,
                        [None, pa.py_buffer(own.astype(np.int64).tobytes()), pa.py_buffer(raw)]
                    ).cast(pa.binary())
                    ids = shard.ids[at:to]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, mask=ids == _NO_ID), pa.array(row["base"] + offsets[at:to]),
                            pa.array(np.diff(offsets[at : to + 1])), lists
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"]
                    )
                    at = to

    return run


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids (unsigned 32-bit little-endian bytes), from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return based.repartitionByRange(parts(manifest.sparkSession), "shard").mapInArrow(_read(), _READ)


def tokens_of(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write, then read back."""
    return read_tokens(write_tokens(docs, tokenizer_path, end_id))
