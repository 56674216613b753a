"""Host-level quality rules.

Each document is tested on its own by two rules (too few words, too many words
in repeated 8-word windows). Failures are counted by source; the sources'
failure rates are shrunk towards each other with a beta prior fitted to all of
them by moments, so a source with few documents isn't judged by chance. A
source whose shrunk rate is over ``max_rate`` is rejected, and the verdict is
joined back to its documents.

Edge cases: null and empty texts have no words, lines or symbols and fail the
length rule. Rows without source form one source. Rows that repeat a doc_id
are judged one by one. With an empty table or a single source the prior is
uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm import words as W
from waypost.llm.shared import stored

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeats(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, key): whether it occurs twice or more in the text; whether it is a later one."""
    order = np.lexsort((key, text))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    many = same.copy()
    many[:-1] |= same[1:]
    out, later = np.empty(len(key), bool), np.empty(len(key), bool)
    out[order], later[order] = many, same
    return out, later


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _measure(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            words = W.words_of(W.column(batch, "text"))
            data, offsets, n = words.data, words.offsets, batch.num_rows
            inside = W.SPACED[data]
            starts = W.window_starts(words.first, window)
            twice, _ = _repeats(W.rolling(words.hashes(), window)[starts], words.text[starts])
            lines = W.split(data, offsets, W.LINES)
            seen = np.concatenate(([0], np.cumsum(inside)))
            full = seen[lines.end] > seen[lines.start]
            line_text = lines.text[full]
            _, later = _repeats(lines.hashes()[full], line_text)
            numbers = {
                "n_words": words.counts,
                "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets),
                "n_symbols": _per_text(_SYMBOL[data], offsets),
                "n_dup_lines": np.bincount(line_text[later], minlength=n),
                "n_repeat_words": _per_text(W.covered(len(words.start), starts[twice], window), words.first),
            }
            arrays = [
                W.column(batch, "doc_id"), W.column(batch, "source"),
                *(pa.array(x.astype(np.int64)) for x in numbers.values())
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "source", *numbers])

    return run


def measures(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, source and the five counts of each row of ``docs`` (doc_id, text, source)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(
        _measure(window),
        "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    )


def beta_prior(rates: DataFrame) -> tuple[float, float]:
    """Beta parameters fitted by moments to rows (n, failed); only sums reach the driver."""
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    s = rates.agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"),
        F.sum(n * n).alias("nn")
    ).first()
    if not s.k or s.k < 2:
        return 1.0, 1.0
    mean = (s.f + 1) / (s.n + 2)
    # spread between sources, freed of what chance gives each: sum n (p - mean)^2 = (k - 1) mean (1 - mean) + spread (n - nn / n)
    excess = max(0.0, s.ff - 2 * mean * s.f + mean * mean * s.n - (s.k - 1) * mean * (1 - mean))
    spread = excess / max(1.0, s.n - s.nn / s.n)
    strength = min(1e4, max(2.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e4
    return mean * strength, (1 - mean) * strength


def host_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, max_rate: float = 0.5) -> DataFrame:
    """Per row of ``docs``: the measures, base_failed, host_rate, host_rejected, kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    tested = stored(measures(docs).withColumn("base_failed", failed), "measures")
    rates = stored(
        tested.groupBy("source").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed")), "rates"
    )
    a, b = beta_prior(rates)
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    verdicts = rates.select(
        F.col("source").alias("host"), rate.alias("host_rate"), (rate > max_rate).alias("host_rejected")
    )
    joined = tested.join(verdicts, tested["source"].eqNullSafe(verdicts["host"]), "left").drop("host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
