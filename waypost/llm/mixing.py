"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

1. Sources share ``ratio`` times all words by weight. A target stops at
   ``cap`` times its source's size; what is over is shared again by weight
   among the others until none is above.
2. The mix is a number of blocks of ``block_words`` words. Sainte-Laguë
   (highest quotients target / (2k + 1)) gives each source an integer number
   of blocks, and in the same way deals a source's blocks out to its shards.
3. Within a shard documents stand in a seeded order and are cut into blocks.
   A seeded systematic draw takes each block quota / blocks times, rounded up
   or down, so exactly the quota is drawn and no block more than ``cap`` times.

All of it is DataFrame expressions. Quotients are only listed around the
share that a source must get, four a source on average, not one a block.
Running sums are taken within shards of bounded row count, never over a
source, so a hot source is split; what is joined back is a row a source or a
shard.

Edge cases: null or empty texts have size 0 and take nothing; sources of size
0 get the target 0; rows without source form one source, the last; rows that
repeat a doc_id are separate rows that share the draw's order by their sizes;
rows without doc_id are drawn by a digest of their text; an empty table gives
an empty result. A task holds the sizes of one shard, ``shard_docs`` rows on
average; the windows over all sources, of a row each, are one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waypost.llm.shared import boxed, stored

#: Words are separated by space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def _draw(*parts: Column) -> Column:
    """A non-negative 48-bit integer from a digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], ratio: float, cap: int) -> DataFrame:
    """``sources`` (source, source_size) with its position by code point (null last), weight and target."""
    ranked = sources.withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int")
    )
    # a source is full once the level, words a unit of weight, reaches ``full``
    ranked = ranked.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(cap) / F.col("weight"))
    order = Window.orderBy("full", "position")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.currentRow, Window.unboundedFollowing
    )
    every = Window.partitionBy()
    level = (
        F.sum("source_size").over(every) * ratio - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(cap)
    ) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "position", "level"))).over(every)
    levelled = levelled.withColumn("fit", fits)
    below = (F.col("full") < F.col("fit.full")) | (
        (F.col("full") == F.col("fit.full")) & (F.col("position") < F.col("fit.position"))
    )
    target = F.when(
        F.col("fit").isNull() | below, F.col("source_size") * float(cap)
    ).otherwise(F.col("fit.level") * F.col("weight"))
    return levelled.select("source", "position", "source_size", "weight", target.alias("target"))


def sainte_lague(items: DataFrame, group: list[str], item: str, votes: str, seats: str) -> DataFrame:
    """``items`` with ``quota``: the ``seats`` of each group dealt out by the highest quotients votes / (2k + 1).

    Quotas lie within share * n / 2 + 1 of the exact share of n items, so only
    the quotients in that reach are listed and ranked; ties go to the smaller
    ``item``.
    """
    whole = Window.partitionBy(*group)
    share = F.col(votes) / F.nullif(F.sum(votes).over(whole), F.lit(0.0))
    reach = F.col("share") * F.count("*").over(whole) / 2 + 1
    near = items.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("reach", reach)
    low = F.greatest(F.lit(0), F.floor(F.col("share") * F.col(seats) - F.col("reach"))).cast("long")
    high = F.ceil(F.col("share") * F.col(seats) + F.col("reach")).cast("long")
    near = near.withColumn("low", low).withColumn("high", high)
    near = near.withColumn("open", F.col(seats) - F.sum("low").over(whole))
    listed = near.filter(F.col(votes) > 0).select(
        *group, item, "open", F.col(votes).alias("v"), F.explode(F.sequence("low", "high")).alias("k")
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col("v") / (F.col("k") * 2 + 1)), item, "k"))
    won = listed.withColumn("rank", rank).filter("rank <= open").groupBy(*group, item).agg(F.count("*").alias("won"))
    joined = near.join(won, [*group, item], "left")
    return joined.withColumn(
        "quota", F.col("low") + F.coalesce("won", F.lit(0))
    ).drop("share", "reach", "low", "high", "open", "won")


def _placed(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, cap: int = 2, block_words: int = 4,
    shard_docs: int = 2_000, seed: int = 17, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of ``docs`` doc_id, the columns ``keep``, source, sizes and target, and its place in the draw.

    The place: the row's words are ``a`` to ``b`` of its shard, which has
    ``words`` words and ``n`` blocks, of which ``q`` are drawn from ``u`` on;
    ``nth`` counts the shard's rows that have words by size.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.when(F.col("doc_id").isNull(), F.md5(text)).alias("name")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size, name, *keep
    )
    sized = stored(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aimed = targets(sums.drop("rows"), weights, ratio, cap)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    dealt = sainte_lague(
        aimed.withColumn("blocks", blocks).withColumn("all", F.lit(0)), ["all"], "position", "target", "blocks"
    )
    counts = sums.select(
        F.col("source").alias("s"), F.greatest(F.lit(1), F.ceil(F.col("rows") / shard_docs)).alias("shards")
    )
    dealt = stored(
        dealt.join(counts, dealt["source"].eqNullSafe(counts["s"])).select(
            "source", "position", "source_size", "target", "quota", "shards"
        ),
        "sources"
    )

    named = dealt.withColumnRenamed("source", "s")
    placed = sized.join(named, sized["source"].eqNullSafe(named["s"])).drop("s")
    named_row = F.coalesce(F.col("doc_id").cast("string"), F.col("name"))
    placed = placed.withColumn("shard", F.pmod(_draw(F.lit(seed), F.lit("shard"), named_row), F.col("shards")))
    shards = placed.groupBy("position", "shard").agg(
        F.sum("size").alias("words"), F.max("quota").alias("seats")
    ).withColumn("votes", F.col("words").cast("double"))
    shards = sainte_lague(shards, ["position"], "shard", "votes", "seats")
    n = F.ceil(F.col("words") / block_words).cast("long")
    shards = shards.select("position", "shard", "words", n.alias("n"), F.least(F.col("quota"), n * cap).alias("q"))
    shards = shards.withColumn(
        "u",
        F.when(
            F.col("n") > 0, F.pmod(_draw(F.lit(seed), F.lit("start"), F.col("position"), F.col("shard")), F.col("n"))
        )
    )
    shards = stored(shards, "shards")

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), named_row))
    order = Window.partitionBy("position", "shard").orderBy(key, "doc_id", "size")
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = Window.partitionBy("position", "shard").orderBy("size", key, "doc_id")
    placed = placed.withColumn("a", start).withColumn("b", F.col("a") + F.col("size"))
    placed = placed.withColumn(
        "nth",
        F.sum((F.col("size") > 0).cast("long")).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return placed.join(shards, ["position", "shard"])


def mix(docs: DataFrame, block_words: int = 4, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken."""
    taken = F.expr(f"{_taken('b', block_words)} - {_taken('a', block_words)}")
    return _placed(docs, block_words=block_words, **options).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken")
    )


def _times(j: str) -> str:
    """SQL: how many blocks before a shard's block ``j`` are drawn."""
    return f"((({j}) * q + u) div nullif(n, 0))"


def _taken(t: str, b: int) -> str:
    """SQL: words drawn from a shard's first ``t``; block j is drawn ((j + 1) q + u) div n - (j q + u) div n times."""
    return f"({b} * {_times(f'{t} div {b}')} + ({t} % {b}) * ({_times(f'{t} div {b} + 1')} - {_times(f'{t} div {b}')}))"


def mixed(docs: DataFrame, whole: bool = False, cap: int = 2, block_words: int = 4, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, one row a copy; what is never taken is left out.

    With ``whole`` the draw takes whole documents and no text is changed. A
    shard that gives the share r of its words gives each document r times,
    rounded up or down by a seeded systematic draw over its documents by size,
    so its words differ from what ``mix`` takes by less than its longest
    document has and four blocks.

    Without it a copy holds the words of the blocks that ``mix`` has drawn at
    least that often, wherever they lie; n_chars, where there is such a
    column, follows.
    """
    rows = stored(boxed(docs).withColumn("row_", F.monotonically_increasing_id()), "rows")
    placed = _placed(
        rows.select("row_", "doc.doc_id", "doc.text", "doc.source"), cap=cap, block_words=block_words, keep=("row_",),
        **options
    )
    if whole:
        rate = F.least(F.lit(float(cap)), F.col("q") * float(block_words) / F.col("words"))
        drawn = lambda nth: F.floor(nth * rate + F.col("u") / F.col("n"))
        chosen = placed.filter("size > 0").select(
            "row_", (drawn(F.col("nth")) - drawn(F.col("nth") - 1)).cast("int").alias("copies_")
        ).filter("copies_ > 0")
        return rows.join(chosen, "row_").withColumn("copy_", F.explode(F.sequence(F.lit(1), "copies_"))).select("doc.*")
    chosen = placed.filter(
        f"size > 0 and {_taken('b', block_words)} > {_taken('a', block_words)}"
    ).select("row_", "size", "a", "n", "q", "u")
    copies = rows.join(chosen, "row_").withColumn(
        "copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("q") / F.col("n"))))
    )
    before = lambda j: F.floor((j * F.col("q") + F.col("u")) / F.col("n"))
    block = lambda i: F.floor((F.col("a") + i) / block_words)
    words = F.regexp_extract_all(F.col("doc.text").cast("string"), F.lit(WORD), F.lit(0))
    copies = copies.withColumn(
        "words_", F.filter(words, lambda _, i: before(block(i) + 1) - before(block(i)) >= F.col("copy_"))
    ).filter("size(words_) > 0")
    uncut = F.size("words_") == F.col("size")
    cut = F.array_join("words_", " ")
    out = {c: F.col(f"doc.{c}") for c in docs.columns}
    out["text"] = F.when(uncut, F.col("doc.text")).otherwise(cut)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(uncut, F.col("doc.n_chars")).otherwise(F.length(cut).cast(kind))
    return copies.select(*[value.alias(c) for c, value in out.items()])
