"""Fill-in-middle texts by markers that are injected after every unit of a text.

A unit is a run of ASCII letters or any other single character. The text is
escaped first so that it holds no ``_MARK``; an escaped character stays one
unit. ``regexp_replace`` appends the mark to every unit, the marks are counted,
``substring_index`` takes units by rank, and what it took is unescaped. All of
it are expressions of one projection: no shuffle, no Python.

Where a text is cut depends on its key and the seed only, so a task that runs
again, or another run, cuts alike.

Edge cases: a null text counts as empty, and empty texts stay plain. A text
that holds one of the three sentinels stays plain, as it couldn't be taken
apart again. Rows that repeat a key are cut at the same ranks; rows without key
as if the key were empty. Columns of the input with the names of added ones are
kept in ``doc``. A text needs some ten times its size in a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypost.llm.shared import boxed, text_or_empty

# The mark after a unit, what starts an escape, and what follows it.
_MARK, _ESCAPE, _FOR_ESCAPE, _FOR_MARK = "\x01", "\x02", "e", "d"
_UNIT = f"{_ESCAPE}[{_FOR_ESCAPE}{_FOR_MARK}]|[A-Za-z]+|[^A-Za-z]"
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def escaped(text: Column) -> Column:
    """The text without ``_MARK``, reversibly."""
    safe = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _FOR_ESCAPE))
    return F.replace(safe, F.lit(_MARK), F.lit(_ESCAPE + _FOR_MARK))


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given, less marks."""
    bare = F.replace(text, F.lit(_MARK), F.lit(""))
    bare = F.replace(bare, F.lit(_ESCAPE + _FOR_MARK), F.lit(_MARK))
    return F.replace(bare, F.lit(_ESCAPE + _FOR_ESCAPE), F.lit(_ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a mark after every unit."""
    return F.regexp_replace(escaped(text), _UNIT, "$0" + _MARK)


def marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(_MARK), F.lit("")))


def _ranked(text: Column, low: Column, high: Column) -> Column:
    """Units number ``low`` (exclusive) to ``high`` (inclusive) of a marked text."""
    return F.call_function("substring_index", F.call_function("substring_index", text, F.lit(_MARK), high), F.lit(_MARK), low - high)


def draw(key: Column, seed: int, which: int) -> Column:
    """The 32-bit number ``which`` (from 0) of a key: 8 hex digits of sha256('seed:key')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * which + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", seed: int = 1, percent: int = 90, suffix_first: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """Per row of ``docs`` (key, text): doc (all of the row), n, form, output, prefix_chars, middle_chars.

    ``percent`` of the texts are cut in three at two drawn ranks of their ``n``
    units; of these ``suffix_first`` per cent get the form ``spm``, the others
    ``psm``. The rest is ``plain``: ``output`` is the text, no chars are given.
    """
    before, after, middle = sentinels
    numbers = [draw(F.col(f"doc.{key}"), seed, i).alias(f"h{i}") for i in range(4)]
    units = boxed(docs).select("doc", text_or_empty("doc.text").alias("text"), *numbers).withColumn("marked", marked(F.col("text")))
    ranked = units.withColumn("n", marks(F.col("marked")).cast("long"))
    ranks = [F.pmod(F.col(f"h{i}"), F.col("n") + 1).cast("int") for i in (0, 1)]
    ranked = ranked.withColumns({"low": F.least(*ranks), "high": F.greatest(*ranks)})
    plain = (F.col("text") == "") | (F.col("h2") % 100 >= percent)
    for sentinel in sentinels:
        plain = plain | F.col("text").contains(sentinel)
    form = F.when(plain, "plain").when(F.col("h3") % 100 < suffix_first, "spm").otherwise("psm")
    m = F.col("marked")
    cut = ranked.withColumns(
        {
            "form": form,
            "prefix": unescaped(_ranked(m, F.lit(0), F.col("low"))),
            "middle": unescaped(_ranked(m, F.col("low"), F.col("high"))),
            # the mark after the last unit makes an empty part after it, so one more is taken
            "suffix": unescaped(F.call_function("substring_index", m, F.lit(_MARK), F.col("high") - F.col("n").cast("int") - 1)),
        }
    )
    is_cut = F.col("form") != "plain"
    output = (
        F.when(~is_cut, F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(before), "prefix", F.lit(after), "suffix", F.lit(middle), "middle"))
        .otherwise(F.concat(F.lit(after), "suffix", F.lit(before), "prefix", F.lit(middle), "middle"))
    )
    chars = lambda part: F.when(is_cut, F.length(part)).cast("long")
    return cut.select(
        "doc", "n", "form", output.alias("output"), chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars")
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of ``fill_in_middle`` was made of, from output and form alone.

    No part holds a sentinel and no sentinel's end is its start, so the first
    occurrence of each is the one that was put there.
    """
    before, after, middle = sentinels
    skip = lambda text, taken, sentinel: F.substr(text, F.length(taken) + len(sentinel) + 1)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = skip(rest, one, second)
        two = F.substring_index(rest, middle, 1)
        return one, two, skip(rest, two, middle)

    prefix, suffix, mid = parts(before, after)
    suffix_, prefix_, mid_ = parts(after, before)
    return (
        F.when(form == "psm", F.concat(prefix, mid, suffix))
        .when(form == "spm", F.concat(prefix_, mid_, suffix_))
        .otherwise(output)
    )
