"""Benchmark decontamination by winnowing.

With windows of ``n`` words, fingerprints are hashes of ``k``-grams, of which
winnowing keeps the smallest of each ``n - k + 1`` in a row: two texts that
share ``n`` words share the fingerprint picked there. The benchmark's
fingerprints meet those of the documents; around each hit the windows of ``n``
words that hold it are compared with the benchmark's by 128 bits of two hashes,
which extends hits to every word of every shared window. Items shorter than a
window count as one window of their own length, and of them every such gram of
a document is compared in the same way.

The benchmark is measured first. Up to ``broadcast_bytes`` of text, its
fingerprints and windows are sent to the executors and documents aren't
shuffled. A larger one stays in tables: the fingerprints of the documents, by
a digest of their text, are joined to its fingerprints; the texts that have any,
usually few, are read again, and their windows that hold one are joined to its
windows. No text is shuffled or written but those of the second step, and the
corpus is read twice however large the benchmark is.

Edge cases: null and empty texts have no words and no hits; items without
words are ignored; items without item_id hit words but are named nowhere; rows
that repeat an item_id are one item, and rows that repeat a doc_id are each
returned. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm import words as W
from waypost.llm.shared import stored, unnamed_numbered

U64 = np.uint64


def winnowed(first: np.ndarray, grams: np.ndarray, starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Indices into ``starts`` of the fingerprints: the leftmost smallest of each ``n - k + 1`` grams of a text.

    ``grams`` belong to the windows of ``k`` words at ``starts``.
    """
    span = n - k + 1
    offsets = np.searchsorted(starts, first)
    at = W.window_starts(offsets, span)
    if not len(at):
        return at
    best, value = at.copy(), grams[at]
    for step in range(1, span):
        other = grams[at + step]
        less = other < value
        best[less], value[less] = at[less] + step, other[less]
    chosen = np.zeros(len(grams), bool)
    chosen[best] = True
    return np.flatnonzero(chosen)


class Index:
    """Windows of benchmark items, by length, with the items they occur in."""

    def __init__(self, names: list[str | None], texts: list[str | None], n: int, k: int):
        self.n, self.k = n, k
        self.names = sorted({x for x in names if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        found = W.words_of(pa.array(texts, pa.string()), W.ALNUM, fold=True)
        item = np.array([number.get(x, -1) for x in names], dtype=np.int64)
        hashes, again, counts = found.hashes(), found.hashes(second=True), found.counts
        starts = W.window_starts(found.first, k)
        grams = W.rolling(hashes, k)[starts]
        self.fingerprints = np.unique(grams[winnowed(found.first, grams, starts, k, n)])
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in range(1, n + 1):
            if length < n:
                of = np.flatnonzero(counts == length)
                at, owner = found.first[of], item[of]
            else:
                at = W.window_starts(found.first, n)
                owner = item[found.text[at]]
            if len(at):
                grams = W.rolling(hashes, length)[at]
                pairs = np.unique(np.stack([grams, owner.view(U64)]), axis=1)
                value, head = np.unique(pairs[0], return_index=True)
                second = W.rolling(again, length, True)[at][np.unique(grams, return_index=True)[1]]
                self.windows[length] = (value, second, np.append(head, pairs.shape[1]), pairs[1].view(np.int64))

    def found_in(self, words: W.Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which words are hit, and pairs of arrays (text, item number)."""
        hashes, again, hit, pairs = words.hashes(), None, np.zeros(len(words.start), bool), []
        for length, (value, second, head, items) in self.windows.items():
            starts = self._candidates(words, hashes) if length == self.n else W.window_starts(words.first, length)
            if not len(starts):
                continue
            grams = W.rolling(hashes, length)[starts]
            at = np.minimum(np.searchsorted(value, grams), len(value) - 1)
            same = value[at] == grams
            if same.any():
                again = words.hashes(second=True) if again is None else again
                same[same] = W.rolling(again, length, True)[starts[same]] == second[at[same]]
            starts, at = starts[same], at[same]
            hit |= W.covered(len(hit), starts, length)
            many = head[at + 1] - head[at]
            each = np.arange(int(many.sum())) + np.repeat(head[at] - (np.cumsum(many) - many), many)
            pairs.append((np.repeat(np.searchsorted(words.first, starts, "right") - 1, many), items[each]))
        return hit, pairs

    def _candidates(self, words: W.Words, hashes: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a fingerprint of the items."""
        starts = W.window_starts(words.first, self.k)
        grams = W.rolling(hashes, self.k)[starts]
        chosen = winnowed(words.first, grams, starts, self.k, self.n)
        if not len(chosen) or not len(self.fingerprints):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.fingerprints, grams[chosen]), len(self.fingerprints) - 1)
        chosen = chosen[self.fingerprints[at] == grams[chosen]]
        near = np.unique((starts[chosen][:, None] - np.arange(self.n - self.k + 1)).ravel())
        near = near[near >= 0]
        own = np.searchsorted(words.first, near, "right") - 1
        return near[near + self.n <= words.first[own + 1]]


_SPANS = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))
_HITS = "hits array<struct<from_word: long, to_word: long>>"


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"from_word": int(x), "to_word": int(y)} for x, y in edge.reshape(-1, 2)]


def _pass(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for batch in W.small(batches):
            words, n = W.words_of(W.column(batch, "text"), W.ALNUM, fold=True), batch.num_rows
            hit, pairs = block.found_in(words)
            items: list[set[str]] = [set() for _ in range(n)]
            for text, item in pairs:
                for t, i in np.unique(np.stack([text, item])[:, item >= 0], axis=1).T:
                    items[t].add(block.names[i])
            sums = np.concatenate(([0], np.cumsum(hit)))
            n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
            spans = [[] for _ in range(n)]
            for row in np.flatnonzero(n_hit):
                spans[row] = _spans(hit[words.first[row] : words.first[row + 1]])
            yield pa.RecordBatch.from_arrays(
                [
                    W.column(batch, "doc_id"), pa.array(words.counts), pa.array(n_hit), pa.array(spans, _SPANS),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                ],
                names=["doc_id", "n_words", "n_hit", "hits", "items"]
            )

    return run


def _key(length: int, grams: np.ndarray) -> np.ndarray:
    """Fingerprints of ``k``-grams have the length 0; those of short items their number of words."""
    return W.mix(grams + U64(length)).view(np.int64)


def _fingerprints(n: int, k: int, lengths: list[int] | None):
    """Distinct (digest, fp) of the texts of (digest, text); of documents all grams of the ``lengths`` of short items count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            words = W.words_of(W.column(batch, "text"), W.ALNUM, fold=True)
            hashes, counts = words.hashes(), words.counts
            starts = W.window_starts(words.first, k)
            grams = W.rolling(hashes, k)[starts]
            chosen = winnowed(words.first, grams, starts, k, n)
            found = [(_key(0, grams[chosen]), words.text[starts[chosen]])]
            for length in range(1, n) if lengths is None else lengths:
                if lengths is None:  # items: only those of that length, whole
                    texts = np.flatnonzero(counts == length)
                    at = words.first[texts]
                else:
                    at = W.window_starts(words.first, length)
                    texts = words.text[at]
                if len(at):
                    found.append((_key(length, W.rolling(hashes, length)[at]), texts))
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            digest = W.column(batch, "digest").take(pa.array(both[1]))
            yield pa.RecordBatch.from_arrays([digest, pa.array(both[0])], names=["digest", "fp"])

    return run


_WINDOW = "digest binary, length int, at long, h1 long, h2 long"


def _windows(n: int, k: int):
    """The windows (digest, length, at, h1, h2) of (digest, text, fps): those that hold one of the fingerprints ``fps``, all where it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            for digest, text, fps in zip(*(W.column(batch, c).to_pylist() for c in ("digest", "text", "fps")), strict=True):
                words = W.words_of(pa.array([text], pa.string()), W.ALNUM, fold=True)
                hashes, again, count = words.hashes(), words.hashes(second=True), len(words.start)
                wanted, out = None if fps is None else np.sort(np.array(fps, np.int64)), []
                for length in range(1, n + 1):
                    if fps is None and length < n and length != count:
                        continue
                    at = W.window_starts(words.first, length)
                    if not len(at):
                        continue
                    grams = W.rolling(hashes, length)[at]
                    if wanted is not None and length < n:
                        keep = np.isin(_key(length, grams), wanted)
                    elif wanted is not None:
                        starts = W.window_starts(words.first, k)
                        held = np.isin(_key(0, W.rolling(hashes, k)[starts]), wanted).astype(np.int64)
                        sums = np.concatenate(([0], np.cumsum(held)))
                        keep = sums[at + n - k + 1] > sums[at]
                    else:
                        keep = np.ones(len(at), bool)
                    at, grams = at[keep], grams[keep]
                    out.append((np.full(len(at), length, np.int32), at, grams.view(np.int64), W.rolling(again, length)[at].view(np.int64) if len(at) else at))
                if out:
                    length, at, h1, h2 = (pa.array(np.concatenate(x)) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest] * len(at), pa.binary()), length, at.cast(pa.int64()), h1, h2], names=["digest", "length", "at", "h1", "h2"]
                    )

    return run


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, n_hit = [], []
        for windows in W.column(batch, "windows").to_pylist():
            at, length = (np.array([w[c] for w in windows], np.int64) for c in ("at", "length"))
            hit = np.zeros(int((at + length).max()) + 1, np.int64)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            hit = np.cumsum(hit) > 0
            spans.append(_spans(hit))
            n_hit.append(int(hit.sum()))
        yield pa.RecordBatch.from_arrays(
            [W.column(batch, "digest"), pa.array(n_hit, pa.int64()), pa.array(spans, _SPANS), W.column(batch, "items")],
            names=["digest", "n_hit", "hits", "items"]
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.small(batches):
        counts = W.words_of(W.column(batch, "text"), W.ALNUM, fold=True).counts
        yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), W.column(batch, "digest"), pa.array(counts)], names=["doc_id", "digest", "n_words"])


def _joined(docs: DataFrame, items: DataFrame, n: int, k: int) -> DataFrame:
    """``contamination`` by joins of fingerprints and of windows."""
    digested = lambda df, *more: df.select(
        *more, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"), F.coalesce("text", F.lit("")).alias("text")
    )
    texts, tests = digested(docs, "doc_id"), stored(digested(items, "item_id"), "items")
    each = lambda df: df.select("digest", "text")
    pairs = "digest binary, fp long"
    windows = stored(
        tests.select("digest", "text", F.lit(None).cast("array<long>").alias("fps")).dropDuplicates(["digest"]).mapInArrow(_windows(n, k), _WINDOW),
        "windows"
    )
    lengths = [r.length for r in windows.filter(F.col("length") < n).select("length").distinct().collect()]  # below n
    wanted = stored(each(tests).mapInArrow(_fingerprints(n, k, None), pairs).select("fp").distinct(), "fingerprints")
    met = each(texts).mapInArrow(_fingerprints(n, k, lengths), pairs).join(wanted, "fp", "left_semi")
    met = stored(met.groupBy("digest").agg(F.collect_set("fp").alias("fps")), "met")  # a text's own fingerprints
    hit = each(texts).join(met, "digest").dropDuplicates(["digest"]).mapInArrow(_windows(n, k), _WINDOW)
    names = windows.select("length", "h1", "h2", "digest").join(tests.select("digest", "item_id"), "digest").select("length", "h1", "h2", "item_id").distinct()
    found = stored(hit.join(names, ["length", "h1", "h2"]), "found")
    told = found.groupBy("digest").agg(
        F.collect_set(F.struct("at", "length")).alias("windows"), F.sort_array(F.collect_set("item_id")).alias("items")
    ).mapInArrow(_covered, f"digest binary, n_hit long, {_HITS}, items array<string>")
    counted = texts.mapInArrow(_count, "doc_id long, digest binary, n_words long")
    return counted.join(told, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hits", F.expr("cast(array() as array<struct<from_word: long, to_word: long>>)")).alias("hits"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5, broadcast_bytes: int = 16 << 20
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, hits, items.

    ``hits`` are the maximal word intervals hit, ``items`` the item_ids as
    sorted strings whose windows occur. ``broadcast_bytes`` doesn't change the result.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes:
        return _joined(texts, items, n, k)
    rows = items.collect()  # at most broadcast_bytes of text
    index = spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], n, k))
    return texts.mapInArrow(_pass(index), f"doc_id long, n_words long, n_hit long, {_HITS}, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a hit; rows that share a doc_id go together, those without one are judged one by one."""
    rows = unnamed_numbered(docs)
    key = F.coalesce("row_", "doc_id").alias("doc_id")
    bad = []
    for unnamed in (False, True) if not rows.filter("row_ is not null").isEmpty() else (False,):
        part = rows.filter(F.col("row_").isNotNull() == unnamed)
        hit = contamination(part.select(key, "text"), benchmark, **options).filter("n_hit > 0")
        bad.append(hit.select(F.col("doc_id").alias("id_"), F.lit(unnamed).alias("unnamed_")).distinct())
    bad = functools.reduce(DataFrame.unionByName, bad)
    return rows.join(
        bad, (key == F.col("id_")) & (F.col("row_").isNotNull() == F.col("unnamed_")), "left_anti"
    ).select("doc.*")
