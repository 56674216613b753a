"""Secrets in texts: known shapes, and windows of high Shannon entropy.

Shapes are patterns of their own kind (``assign``, ``access``, ``hex``). Beside
them, every maximal run of a character class's characters is a candidate, over
which a window of ``WINDOW`` characters slides. A window's counts by character
change by one arriving and one leaving character a step, and with them the sum
of c * log2(c), from which the entropy follows; the sum is kept in whole
1 / 65536 bits, so it never drifts. Windows at or above their class's
threshold merge to spans of the kind ``entropy_<class>``.

Suppressed are windows without a letter or without a digit (words, numbers),
candidates on the allow-list (identifiers of a public form, placeholders), and
spans within a span of a known shape, which is reported anyway.

Offsets are code points, ends exclusive. Spark cuts the rows into batches, each
row is looked at by itself, whole: no shuffle and no state. A task needs about
ten times the bytes of its longest text, and the runs of one text at a time.

Edge cases: null and empty texts have no spans. Repeated rows and rows without
key each get their spans. Other columns pass untouched, in ``doc``.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm.shared import boxed, text_or_empty

WINDOW = 20
#: Thresholds in bits a character: a class's random strings of 20 characters lie some 0.3 above.
CLASSES = {"hex": ("0-9A-Fa-f", 2.9), "base64": ("A-Za-z0-9+/_=-", 3.7)}
#: Patterns of candidates that aren't secrets.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i:example|sample|dummy|placeholder|changeme|your_?key)",
    r"0123456789|1234567890|(?i:abcdefgh)",
)
BASE = ("assign", "access", "hex")
_RANK = {kind: i for i, kind in enumerate((*BASE, *(f"entropy_{name}" for name in CLASSES)))}
SPANS = "array<struct<kind: string, start: long, end: long>>"
_UNIT = 1 << 16
Span = tuple[int, int, str]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")


def shaped(text: str) -> list[Span]:
    """(start, end, kind) of the known shapes; of each kind leftmost first, none overlapping."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


class Scanner:
    """Finds windows of high entropy in candidate strings."""

    def __init__(self, window: int = WINDOW, classes: dict[str, tuple[str, float]] | None = None, allowed: tuple[str, ...] = ALLOWED):
        self.window = window
        weights = [0, *(round(_UNIT * c * math.log2(c)) for c in range(1, window + 1))]
        #: What the sum of c * log2(c) gains when a count rises from c.
        self.gain = [b - a for a, b in zip(weights, weights[1:], strict=False)]
        self.allowed = re.compile("|".join(allowed)) if allowed else None
        self.classes = [
            (f"entropy_{name}", re.compile(f"[{letters}]{{{window},}}"), math.floor(_UNIT * window * (math.log2(window) - bits)))
            for name, (letters, bits) in (CLASSES if classes is None else classes).items()
        ]

    def high(self, run: str, most: int) -> Iterator[tuple[int, int]]:
        """Spans of windows of ``run`` whose sum of c * log2(c) is ``most`` or less and that have letters and digits."""
        gain, window = self.gain, self.window
        counts: dict[str, int] = {}
        total = letters = digits = 0
        start = end = -1
        for i, new in enumerate(run):
            if i >= window:
                old = run[i - window]
                counts[old] -= 1
                total -= gain[counts[old]]
                letters -= old.isalpha()
                digits -= old.isdigit()
            c = counts.get(new, 0)
            counts[new] = c + 1
            total += gain[c]
            letters += new.isalpha()
            digits += new.isdigit()
            if i + 1 >= window and total <= most and letters and digits:
                at = i + 1 - window
                if at > end:
                    if end >= 0:
                        yield start, end
                    start = at
                end = i + 1
        if end >= 0:
            yield start, end

    def spans(self, text: str) -> list[Span]:
        """All spans of a text by start, then kind, then end."""
        base = sorted(shaped(text))
        starts, reach = [a for a, _, _ in base], list(itertools.accumulate((b for _, b, _ in base), max))
        found = list(base)
        for kind, pattern, most in self.classes:
            for m in pattern.finditer(text):
                if self.allowed and self.allowed.search(m[0]):
                    continue
                for low, high in self.high(m[0], most):
                    low, high = low + m.start(), high + m.start()
                    before = bisect.bisect_right(starts, low)
                    if not before or reach[before - 1] < high:  # no known shape holds it
                        found.append((low, high, kind))
        return sorted(found, key=lambda s: (s[0], _RANK.get(s[2], len(_RANK)), s[1]))


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with ``mark`` for each stretch that spans, in ascending order, cover."""
    pieces, at = [], -1
    for start, end, _ in spans:
        if start > at:
            pieces += [text[max(at, 0) : start], mark]
        at = max(at, end)
    return "".join([*pieces, text[max(at, 0) :]])


def _listed(**options) -> Column:
    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(**options)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in scanner.spans(t)] for t in texts], dtype=object)

    return run(F.col("text"))


def find_secrets(
    docs: DataFrame, window: int = WINDOW, classes: dict[str, tuple[str, float]] | None = None, allowed: tuple[str, ...] = ALLOWED
) -> DataFrame:
    """Per row of ``docs`` (text): doc (all of the row), spans (kind, start, end; by start, then kind)."""
    texts = boxed(docs).select("doc", text_or_empty("doc.text").alias("text"))
    return texts.select("doc", _listed(window=window, classes=classes, allowed=allowed).alias("spans"))


def shown(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without_secrets(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with its columns; what spans cover in ``text`` is ``mark``, once for spans that overlap or touch. Null texts stay null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(**options)
        for texts in batches:
            yield pd.Series([None if t is None else redacted(t, scanner.spans(t), mark) for t in texts], dtype=object)

    texts = boxed(docs).select("doc", F.col("doc.text").cast("string").alias("text"))
    clean = texts.select("doc", run(F.col("text")).alias("text"))
    return clean.select(*[(F.col("text") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])
