"""Toxicity by class-conditional Kneser-Ney models of word spelling.

Each class has an interpolated Kneser-Ney model over the bytes of lower-cased
words, of order ``ORDER``; a word counts once in each text it occurs in, and
the larger class is weighed down to the smaller one's total. Only the highest
order is counted by class; what it lacks is smoothed by backoff counts that
both classes share (continuation counts of all lower orders), so a spelling
that is rare in both says next to nothing. A word's evidence is the difference
of its log-likelihoods under the toxic and the ordinary model. The evidence of
a text's distinct words is normalised by length: the mean over all of them and
over the strongest 1, 3, 8 and 20, so a long text doesn't dilute a short
abuse. A logistic curve over these means, fitted on labelled rows that the
counts haven't seen, gives the score.

The counts take every labelled row outside fold 2 and every gram. Up to
``max_grams`` grams the model is broadcast, and scoring is one pass over whole
texts without a shuffle. Beyond that it is worked out and kept as tables, and
the distinct words of the texts meet it in joins; the scores are the same.
Only the curve of six weights is fitted on at most about ``max_rows`` rows of
each class, chosen by a hash of doc_id.

Edge cases: null, empty and wordless texts have no evidence and get the score
of zero evidence. Rows that repeat a doc_id are each scored; repeated labels
count as toxic if any is. Without labelled rows of both classes every score
is 0. doc_id, lang, source and labels are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm import words as W
from waypost.llm.shared import lasting, passing, stored, unnamed_numbered

U64 = np.uint64
ORDER = 6
#: How many of a text's strongest words are averaged, beside all of them.
BEST = (1, 3, 8, 20)
#: Absolute discount of the class counts.
DISCOUNT = 1.5
_START, _END = 1, 2
#: Grams whose probabilities are worked out at once, so the driver needs little beside the model.
_SLICE = 1 << 16


def fold(name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out from all learning."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(4))


def _spellings(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct words: grams of ORDER bytes as integers, offsets by word; and each word's number."""
    _, head, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
    length = words.end[head] - words.start[head]
    room = length + ORDER
    base = np.cumsum(room) - room
    padded = np.full(int(room.sum()), _START, dtype=np.uint8)
    word = np.repeat(np.arange(len(head)), length)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    padded[base[word] + ORDER - 1 + inner] = words.data[words.start[head][word] + inner]
    padded[base + room - 1] = _END
    grams = np.zeros(len(padded) - ORDER + 1, dtype=U64) if len(padded) else np.zeros(0, U64)
    for at in range(ORDER):
        grams = (grams << U64(8)) | padded[at : at + len(grams)].astype(U64)
    offsets = np.concatenate(([0], np.cumsum(length + 1)))
    at = np.arange(int(offsets[-1])) + np.repeat(base - offsets[:-1], length + 1)
    return grams[at], offsets, number


def _once(text: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first occurrence of each distinct word in each text, in the order of (text, word)."""
    return np.unique(text * n + number, return_index=True)[1]


_COUNTS = "gram long, toxic long, ordinary long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts of (text, toxic) rows, summed over as many texts as fit."""

    def merged(parts):
        key, toxic, ordinary = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, at = np.unique(key, return_inverse=True)
        return key, np.bincount(at, toxic, len(key)), np.bincount(at, ordinary, len(key))

    held, size = [], 0
    for batch in W.small(batches):
        words = W.words_of(W.column(batch, "text"), W.ALNUM, fold=True)
        if not len(words.start):
            continue
        toxic = W.column(batch, "toxic").to_numpy(zero_copy_only=False).astype(bool)[words.text]
        grams, offsets, number = _spellings(words)
        n = len(offsets) - 1
        once = _once(words.text, number, n)
        per_word = [np.repeat(np.bincount(number[once], w[once], n), np.diff(offsets)) for w in (toxic, ~toxic)]
        held.append(merged([(grams, *per_word)]))
        size += len(held[-1][0])
        if size > 1 << 20:
            held = [merged(held)]
            size = len(held[0][0])
    if held:
        key, toxic, ordinary = merged(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array(ordinary.astype(np.int64))],
            names=["gram", "toxic", "ordinary"]
        )


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array, where each run of equal values starts, and each value's run."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1


def _shared(grams: np.ndarray) -> np.ndarray:
    """Kneser-Ney probabilities of the last byte of each gram (fewer than ORDER bytes) given the others.

    ``grams`` are the distinct highest-order grams of both classes; each lower
    order counts the distinct continuations to its left.
    """
    below = np.full(len(grams), 1 / 256)
    for order in range(1, ORDER):
        mask = U64((1 << (8 * order)) - 1)
        # distinct grams of one byte more give the continuation counts of this order
        longer = grams & U64((1 << (8 * (order + 1))) - 1)
        longer.sort()
        longer = longer[_runs(longer)[0]] & mask
        longer.sort()
        head = _runs(longer)[0]
        key, count = longer[head], np.diff(np.append(head, len(longer)))
        del longer
        head, of = _runs(key >> U64(8))
        kinds, total, d = np.diff(np.append(head, len(key))), np.add.reduceat(count, head), _discount(count)
        own, back = np.maximum(count - d, 0) / total[of], d * kinds / total
        for low in range(0, len(grams), _SLICE):
            part = slice(low, low + _SLICE)
            at = np.searchsorted(key, grams[part] & mask)
            below[part] = own[at] + back[of[at]] * below[part]
    return below


class Model:
    """Evidence of grams, and of known contexts before an unknown byte, as sorted arrays."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        order = np.argsort(grams)
        self.grams = grams[order]
        smaller = min(toxic.sum(), ordinary.sum())
        head, of = _runs(self.grams >> U64(8))
        self.contexts = self.grams[head] >> U64(8)
        below = _shared(self.grams)
        gram_evidence, context_evidence = np.zeros(len(self.grams)), np.zeros(len(head))
        for sign, counts in ((1, toxic), (-1, ordinary)):
            count = counts[order] * (smaller / counts.sum())
            total = np.maximum(np.add.reduceat(count, head), 1e-9)
            over = np.maximum(count - DISCOUNT, 0)
            rest = np.clip(1 - np.add.reduceat(over, head) / total, 1e-6, 1)
            gram_evidence += sign * np.log(over / total[of] + rest[of] * below)
            context_evidence += sign * np.log(rest)
        self.gram_evidence, self.context_evidence = gram_evidence.astype(np.float32), context_evidence.astype(np.float32)
        self.centre, self.spread, self.weights = np.zeros(
            1 + len(BEST)
        ), np.ones(1 + len(BEST)), np.zeros(2 + len(BEST))

    def evidence(self, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log-likelihood difference of each word, given the grams of its spelling."""
        out = np.zeros(len(grams), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        out[known] = self.gram_evidence[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            context = grams[rest] >> U64(8)
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            known = self.contexts[at] == context
            out[rest[known]] = self.context_evidence[at[known]]
        return np.add.reduceat(out, offsets[:-1]) if len(out) else out

    def features(self, texts: pa.Array) -> np.ndarray:
        """Mean evidence of each text's distinct words: of all, and of its strongest ones."""
        words = W.words_of(texts, W.ALNUM, fold=True)
        out = np.zeros((len(texts), 1 + len(BEST)))
        if not len(words.start):
            return out
        grams, offsets, number = _spellings(words)
        own = self.evidence(grams, offsets).astype(np.float64)
        once = _once(words.text, number, len(own))
        text, value = words.text[once], own[number[once]]
        order = np.lexsort((-value, text))
        text, value = text[order], value[order]
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        sums = np.concatenate(([0.0], np.cumsum(value)))
        total = lambda k: sums[np.minimum(first[:-1] + k, first[1:])] - sums[first[:-1]]
        out[:, 0] = total(len(value)) / np.maximum(np.diff(first), 1)
        for i, k in enumerate(BEST, 1):
            out[:, i] = total(k) / k
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.centre) / self.spread) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fitted(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, spread and logistic weights of the curve over ``features``."""
    centre, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    return centre, spread, logistic((features - centre) / spread, toxic, weight)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic curve (the last is the constant) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty @ w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _featured(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            x = model.value.features(W.column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"]
            )

    return run


def _counted(rows: DataFrame) -> DataFrame:
    summed = rows.select("text", "toxic").mapInArrow(_counts, _COUNTS).groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    )
    return stored(summed, "grams")


class Tables:
    """Evidence of grams and contexts as tables, for models beyond a broadcast; the numbers are those of ``Model``."""

    def __init__(self, counts: DataFrame, toxic: int, ordinary: int):
        below = None
        for order in range(1, ORDER):
            longer = counts.select(F.col("gram").bitwiseAND(_mask(order + 1)).alias("gram")).distinct()
            keyed = stored(
                longer.groupBy(F.col("gram").bitwiseAND(_mask(order)).alias("key")).agg(F.count("*").alias("count")),
                "keys"
            )
            once, twice = keyed.agg(F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2)).first()
            d = once / (once + 2 * twice) if once else 0.5
            keyed = keyed.withColumn("context", F.shiftright("key", 8))
            sums = stored(
                keyed.groupBy("context").agg(F.sum("count").alias("total"), F.count("*").alias("kinds")), "contexts"
            )
            keyed = keyed.join(sums, "context").withColumn("shorter", F.col("key").bitwiseAND(_mask(order - 1)))
            keyed = keyed.withColumn("lower", F.lit(1 / 256)) if below is None else keyed.join(
                below.withColumnsRenamed({"key": "shorter", "below": "lower"}), "shorter"
            )
            value = F.greatest(
                F.col("count") - d, F.lit(0.0)
            ) / F.col("total") + d * F.col("kinds") / F.col("total") * F.col("lower")
            below = stored(keyed.select("key", value.alias("below")), "below")
        smaller = min(toxic, ordinary)
        counted = counts.select(
            "gram", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(_mask(ORDER - 1)).alias("key"),
            (F.col("toxic") * (smaller / toxic)).alias("toxic"),
            (F.col("ordinary") * (smaller / ordinary)).alias("ordinary")
        )
        over = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
        total = lambda c: F.greatest(F.sum(c), F.lit(1e-9))
        rest = lambda c: F.least(F.greatest(1 - F.sum(over(c)) / total(c), F.lit(1e-6)), F.lit(1.0))
        both = ("toxic", "ordinary")
        sums = lasting(
            counted.groupBy("context").agg(
                *[total(c).alias(f"{c}_total") for c in both], *[rest(c).alias(f"{c}_rest") for c in both]
            ),
            "contexts"
        )
        log = lambda c: F.ln(over(c) / F.col(f"{c}_total") + F.col(f"{c}_rest") * F.col("below"))
        self.grams = lasting(
            counted.join(sums, "context").join(below, "key").select(
                "gram", (log("toxic") - log("ordinary")).alias("evidence")
            ),
            "evidence"
        )
        self.contexts = sums.select("context", (F.ln("toxic_rest") - F.ln("ordinary_rest")).alias("unseen"))

    def features(self, rows: DataFrame) -> DataFrame:
        """``rows`` (text and more) with ``x``, the features of ``Model``."""
        rows = stored(rows.withColumn("row_", F.monotonically_increasing_id()), "rows")
        words = rows.select("text").mapInArrow(
            _word_grams, "word long, grams array<long>"
        ).groupBy("word").agg(F.first("grams").alias("grams"))
        grams = words.select("word", F.explode("grams").alias("gram")).withColumn("context", F.shiftright("gram", 8))
        met = grams.join(self.grams, "gram", "left").join(self.contexts, "context", "left")
        value = stored(
            met.groupBy("word").agg(F.sum(F.coalesce("evidence", "unseen", F.lit(0.0))).alias("value")), "words"
        )
        own = stored(rows.select("row_", "text").mapInArrow(_row_words, "row_ long, word long"), "row-words")
        own = own.join(value, "word").groupBy("row_").agg(
            F.avg("value").alias("mean"),
            F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, max(BEST)).alias("best")
        )
        best = [F.aggregate(F.slice("best", 1, k), F.lit(0.0), lambda t, v: t + v) / k for k in BEST]
        zero = F.array(*[F.lit(0.0)] * (1 + len(BEST)))
        return rows.join(
            own.select("row_", F.array("mean", *best).alias("x")), "row_", "left"
        ).withColumn("x", F.coalesce("x", zero)).drop("row_", "text")


def _mask(n: int) -> int:
    return (1 << (8 * n)) - 1


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of the texts of a batch with the grams of their spelling."""
    for batch in W.small(batches):
        words = W.words_of(W.column(batch, "text"), W.ALNUM, fold=True)
        if len(words.start):
            grams, offsets, _ = _spellings(words)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.unique(words.hashes()).view(np.int64)), lists], names=["word", "grams"]
            )


def _row_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text."""
    for batch in W.small(batches):
        words = W.words_of(W.column(batch, "text"), W.ALNUM, fold=True)
        if len(words.start):
            known, number = np.unique(words.hashes(), return_inverse=True)
            once = _once(words.text, number, len(known))
            rows = W.column(batch, "row_").to_numpy()[words.text[once]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(known[number[once]].view(np.int64))], names=["row_", "word"]
            )


def _model(counts: DataFrame, max_grams: int) -> Model | Tables | None:
    """A model of all grams, as tables if there are more than ``max_grams``; None unless both classes have some."""
    size = counts.agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")
    ).first()
    if not size.toxic or not size.ordinary:
        return None
    if size.n > max_grams:
        return Tables(counts, size.toxic, size.ordinary)
    found = counts.toArrow()
    gram, toxic, ordinary = (found[name].to_numpy() for name in ("gram", "toxic", "ordinary"))
    del found
    return Model(gram.view(U64), toxic, ordinary)


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 50_000, max_grams: int = 2_000_000
) -> Model | Tables | None:
    """The model of the labelled rows outside fold 2; None unless both classes occur.

    The logistic curve is fitted on fold 3 by a model that counts folds 0 and 1
    only; then fold 3 is counted, too.
    """
    with passing():
        return _trained(docs, labels, max_rows, max_grams)


def _trained(docs: DataFrame, labels: DataFrame, max_rows: int, max_grams: int) -> Model | Tables | None:
    spark = docs.sparkSession
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    ).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(
        (F.max("toxic") == 1).alias("toxic")
    ).withColumn("part", fold()).filter("part <> 2")
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    share = {k: min(1.0, max_rows / n) for k, n in sizes.items()}
    drawn = F.pmod(
        F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)
    ) < F.when(F.col("toxic"), share[True] * (1 << 30)).otherwise(share[False] * (1 << 30))
    # a row a labelled document, so Spark may broadcast them while they are few
    known = stored(known.withColumn("drawn", drawn), "labels")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).join(known, "doc_id")
    rows = stored(rows, "labelled")
    first, last = _counted(rows.filter("part <> 3")), _counted(rows.filter("part = 3"))
    both = stored(
        first.unionByName(last).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")),
        "grams"
    )
    # one model after the other, as the driver holds them
    early = _model(first, max_grams)
    model = early or _model(both, max_grams)
    if model is None:
        return None

    def featured(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        df = df.filter("drawn").select("text", "toxic")
        if isinstance(model, Tables):
            found = model.features(df).toArrow()
        else:
            held = spark.sparkContext.broadcast(model)
            found = df.mapInArrow(_featured(held), "toxic boolean, x array<double>").toArrow()
            held.unpersist()
        x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return x.reshape(found.num_rows, 1 + len(BEST)), found["toxic"].to_numpy().astype(bool)

    x, toxic = featured(rows.filter("part = 3"))
    if toxic.all() or not toxic.any():
        x, toxic = featured(rows)
    weight = np.where(toxic, 1 / share[True], 1 / share[False])
    curve = fitted(x, toxic.astype(float), weight / weight.mean())
    if early is not None:
        early = None
        model = _model(both, max_grams) or model
    model.centre, model.spread, model.weights = curve
    return model


def _scored(model, keep=()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            x = model.value.features(W.column(batch, "text"))
            arrays = [
                *(W.column(batch, c) for c in ("doc_id", *keep)), pa.array(x[:, 0]), pa.array(x[:, 1]),
                pa.array(model.value.scores(x))
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *keep, "mean_evidence", "top_evidence", "score"])

    return run


def _judged(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: tuple[str, ...] = (), **options
) -> DataFrame:
    model = train(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    if model is None:
        zero = F.lit(0.0)
        scored = rows.select(
            "doc_id", *keep, zero.alias("mean_evidence"), zero.alias("top_evidence"), zero.alias("score")
        )
    elif isinstance(model, Tables):
        scored = model.features(rows)
        z = F.lit(float(model.weights[-1]))
        for i, w in enumerate(model.weights[:-1]):
            z = z + (F.col("x")[i] - float(model.centre[i])) / float(model.spread[i]) * float(w)
        z = F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))
        scored = scored.select(
            "doc_id", *keep, F.col("x")[0].alias("mean_evidence"), F.col("x")[1].alias("top_evidence"),
            (1 / (1 + F.exp(-z))).alias("score")
        )
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)
        kept = "".join(f"{c} long, " for c in keep)
        scored = rows.mapInArrow(
            _scored(held, keep), f"doc_id long, {kept}mean_evidence double, top_evidence double, score double"
        )
    return scored.select(
        "doc_id", *keep, F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "mean_evidence", "top_evidence"
    )


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, and the two evidences."""
    return _judged(docs, labels, threshold, **options)


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic; rows that share a doc_id go together, those without one are judged one by one."""
    rows = unnamed_numbered(docs)
    bad = _judged(rows, labels, keep=("row_",), **options).filter("predicted = 1").select(
        F.col("doc_id").alias("id_"), F.col("row_").alias("bad_")
    ).distinct()
    return rows.join(
        bad, F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("row_").eqNullSafe(F.col("bad_")), "left_anti"
    ).select("doc.*")
