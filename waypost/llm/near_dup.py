"""MinHash near-duplicate removal with SuperMinHash signatures.

1. One pass over the texts gives each document its set of word shingles as
   64-bit hashes; from it come the set's size, a 128-bit digest, and the band
   keys of a SuperMinHash signature.
2. Documents with equal sets form a class, with the smallest doc_id as its
   representative; copies are never compared again.
3. Representatives that share a band key form a bucket. A bucket isn't
   expanded into pairs: its members are compared with its smallest one,
   confirmed on full sets, and linked ones merge into components.
4. Only pairs across components of a bucket are left then. Components that
   meet in buckets gather in families around the largest of them; a family's
   members outside that one are compared with all of the family: pair by pair
   where they are few, else in blocks of bounded size, each block against each,
   of which a task returns only the links. What still meets in a bucket across
   families is compared in the same two ways. So every pair that shares a bucket
   is confirmed, refuted, or already connected, however large the group, and
   buckets with one component, usually all, need none of this.
5. Components of the links come from star contraction (``graph``).

Whole sets are compared, not signatures, as sets of window hashes modulo 2 ** 61 - 1
of 64-bit word hashes: with a thousand shingles each, two texts have one hash
in common by chance with a probability of 5e-13. Bands of 4 out of 128 positions: a pair at similarity 0.8 shares no bucket
with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8.

Edge cases: null or empty texts and texts without words have size 0, stand
alone and are kept. A text with fewer words than a shingle has one shingle,
the whole sequence. Rows that repeat a doc_id are each returned and share its
component. Rows without doc_id are returned unlinked and kept. Elements of a
long text bid in groups of ``BIDDERS``, so a task needs about twenty times the
bytes of its longest text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm import words as W
from waypost.llm.graph import components
from waypost.llm.shared import lasting, passing, stored

BANDS, ROWS = 32, 4
#: Members of a bucket that one task compares with its centre, about.
DEAL = 128
#: Elements whose bids are held at once, of ``size`` bytes each.
BIDDERS = 1 << 18
U64 = np.uint64


def shingles(found: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the n + 1 offsets of the texts."""
    hashes, counts = found.hashes(), found.counts
    starts = W.window_starts(found.first, k)
    values, owner = [W.rolling(hashes, k)[starts]], [found.text[starts]]
    for short in range(1, k):
        texts = np.flatnonzero(counts == short)
        if len(texts):
            values.append(W.rolling(hashes, short)[found.first[texts]])
            owner.append(texts)
    value, text = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def super_min_hash(value: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures (texts x size) of the sets in ``value``.

    Each element visits the positions in a random order of its own and bids
    (rank, random) there; a position keeps the least bid. At rank j all
    elements of all texts bid at once; a text is done when its largest value
    is below every bid of the next rank. Empty sets keep the largest integer.
    """
    n = len(first) - 1
    least = np.full(n * size, np.iinfo(np.int64).max, dtype=np.int64)
    text = np.repeat(np.arange(n), np.diff(first))
    for low in range(0, len(value), BIDDERS):
        _bid(least, value[low : low + BIDDERS], text[low : low + BIDDERS], size)
    return least.reshape(n, size)


def _bid(least: np.ndarray, value: np.ndarray, text: np.ndarray, size: int) -> None:
    """Lower ``least`` (texts x size, flat) to the bids of the elements ``value``."""
    order = np.tile(np.arange(size, dtype=np.uint16 if size > 256 else np.uint8), (len(value), 1))
    for rank in range(size):
        if not len(value):
            break
        draw = W.mix(value + U64((rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = rank + ((draw & U64(0xFFFFFFFF)) % U64(size - rank)).astype(np.int64)
        row = np.arange(len(value))
        place = order[row, at].astype(np.int64)
        order[row, at] = order[:, rank]
        np.minimum.at(least, text * size + place, (rank << 32) | (draw >> U64(32)).astype(np.int64))
        live = np.unique(text)
        open_ = live[least.reshape(-1, size)[live].max(axis=1) >= (rank + 1) << 32]
        if len(open_) < len(live):
            stays = np.isin(text, open_)
            value, text, order = value[stays], text[stays], order[stays]


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    n, size = signature.shape
    parts = W.mix(signature.astype(U64) + np.arange(size, dtype=U64) * U64(0xD1342543DE82EF95))
    return W.mix(parts.reshape(n, size // rows, rows).sum(axis=2, dtype=U64)).view(np.int64)


def _profile(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            value, first = shingles(W.words_of(W.column(batch, "text"), fold=True), k)
            keys = band_keys(super_min_hash(value, first, bands * rows), rows)
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            digests = []
            for seed in (1, 2):
                sums = np.zeros(batch.num_rows, dtype=U64)
                np.add.at(sums, text, W.mix(value ^ W.mix(np.full(1, seed, dtype=U64))))
                digests.append(pa.array(sums.view(np.int64)))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [W.column(batch, "doc_id"), pa.array(np.diff(first)), *digests, lists],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"]
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.small(batches):
            value, first = shingles(W.words_of(W.column(batch, "text"), fold=True), k)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), lists], names=["doc_id", "items"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, dealt: DataFrame | None = None) -> DataFrame:
    """The rows of ``pairs`` (a, b and more) whose sets have at least ``percent`` % of their union in common.

    ``dealt`` (a, tasks) has for every a how many tasks its pairs are dealt to;
    each of them gets a copy of a's set.
    """
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    key = ["a"]
    if dealt is not None:
        left = left.join(dealt, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
        pairs = pairs.withColumn("task", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int")).drop("tasks")
        key = ["a", "task"]
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(right, "b").join(left, key)
    kept = [c for c in pairs.columns if c != "task"]
    both = both.select(*kept, common.alias("c"), (F.size("x") + F.size("y") - common).alias("u"))
    return both.filter(F.col("c") * 100 >= F.col("u") * percent).drop("c", "u")


def _near(percent: int):
    """Whether two set sizes allow the similarity at all."""
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def _block_links(percent: int):
    """Links between the outsiders and the members of a block, one for each outsider and component."""

    def run(group: pa.Table) -> pa.Table:
        rep, part = group["rep"].to_numpy(), group["component"].to_numpy()
        outside = group["outside"].to_numpy(zero_copy_only=False).astype(bool)
        items = group["items"].combine_chunks()
        first, value = items.offsets.to_numpy().astype(np.int64), items.values.to_numpy()
        size = np.diff(first)
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        of_y = np.repeat(np.arange(len(y)), size[y])
        in_y = np.concatenate([value[first[i] : first[i + 1]] for i in y]) if len(y) else value[:0]
        order = np.argsort(in_y, kind="stable")
        in_y, of_y = in_y[order], of_y[order]
        a, b = [], []
        for i in x:
            own = value[first[i] : first[i + 1]]
            low, high = np.searchsorted(in_y, own), np.searchsorted(in_y, own, "right")
            many = high - low
            at = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
            common = np.bincount(of_y[at], minlength=len(y))
            near = np.flatnonzero((common * 100 >= (size[i] + size[y] - common) * percent) & (part[y] != part[i]))
            _, one = np.unique(part[y][near], return_index=True)
            a += [int(part[i])] * len(one)
            b += part[y][near][one].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """Members of groups dealt to pairs of blocks (x of outsiders, y of all).

    ``rows`` have the group ``met``, rep, component, outside, and the group's
    ``all`` members and ``outsiders``. A member is copied once for each block it
    meets.
    """
    n_in, n_out = F.ceil(F.col("all") / block), F.ceil(F.col("outsiders") / block)
    place = lambda n: F.pmod(F.xxhash64("rep"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["met", "rep", "component"]
    asking = rows.filter("outside").select(
        *columns, F.lit(True).alias("outside"), place(n_out).alias("x"), every(n_in).alias("y")
    )
    return asking.unionByName(
        rows.select(*columns, F.lit(False).alias("outside"), every(n_out).alias("x"), place(n_in).alias("y"))
    )


def _across(open_: DataFrame, sets: DataFrame, percent: int, few: int, block: int) -> DataFrame:
    """Links (a, b) between components that meet in a bucket; ``open_`` has key, rep, n, component, main, main_size."""
    hubs = stored(
        open_.groupBy("component").agg(
            F.max(F.struct("main_size", "main")).alias("h")
        ).select("component", F.col("h.main").alias("family")),
        "hubs"
    )
    placed = stored(open_.select("key", "rep", "n", "component").join(hubs, "component"), "families")

    # within families: those outside of the largest component
    kin = placed.select("rep", "n", "component", "family").distinct().withColumn(
        "outside", F.col("component") != F.col("family")
    )
    sizes = stored(
        kin.groupBy("family").agg(
            F.count("*").alias("all"), F.count_if("outside").alias("outsiders")
        ).filter("outsiders > 0"),
        "sizes"
    )
    kin = stored(kin.join(sizes, "family"), "kin")
    groups = [
        kin.select(
            F.xxhash64(F.lit("family"), "family").alias("met"), "rep", "n", "component", "outside", "all", "outsiders",
            F.lit(None).cast("long").alias("kind")
        )
    ]
    # across families: those of a bucket outside of one of its families
    foreign = placed.groupBy("key").agg(
        F.min("family").alias("low"), F.max("family").alias("high"),
        F.max_by("family", F.xxhash64("family")).alias("home")
    ).filter("low < high")
    foreign = stored(foreign.select("key", "home"), "foreign")
    if not foreign.isEmpty():
        met = stored(placed.join(foreign, "key").withColumn("outside", F.col("family") != F.col("home")), "met")
        sizes = stored(
            met.groupBy("key").agg(F.count("*").alias("all"), F.count_if("outside").alias("outsiders")), "sizes"
        )
        groups.append(
            stored(met.join(sizes, "key"), "met").select(
                F.xxhash64(F.lit("key"), "key").alias("met"), "rep", "n", "component", "outside", "all", "outsiders",
                F.col("family").alias("kind")
            )
        )
    rows = functools.reduce(DataFrame.unionByName, groups)

    # pair by pair where outsiders are few
    sparse = rows.filter(F.col("outsiders") <= few)
    other = sparse.select(
        "met", F.col("rep").alias("r"), F.col("n").alias("m"), F.col("component").alias("part"),
        F.col("kind").alias("other_kind")
    )
    apart = (F.col("component") != F.col("part")) & _near(percent) & F.coalesce(
        F.col("kind") != F.col("other_kind"), F.lit(True)
    )
    ordered = F.col("rep") < F.col("r")
    either = lambda x, y: F.when(ordered, F.col(x)).otherwise(F.col(y))
    pairs = sparse.filter("outside").join(other, "met").filter(apart).select(
        either("rep", "r").alias("a"), either("r", "rep").alias("b"), either("component", "part").alias("pa"),
        either("part", "component").alias("pb")
    ).distinct()
    close = _confirmed(pairs, sets, percent).select(F.col("pa").alias("a"), F.col("pb").alias("b"))

    # else block by block: each block of outsiders with each block of all
    dealt = _blocked(rows.filter(F.col("outsiders") > few), block)
    dealt = dealt.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select(
        "met", "x", "y", "rep", "component", "outside", "items"
    )
    in_blocks = dealt.groupBy("met", "x", "y").applyInArrow(_block_links(percent), "a long, b long")
    return close.unionByName(in_blocks)


def link(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, few: int = 16,
    block: int = 256
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Families with more than ``few`` outsiders are compared in blocks of about
    ``block`` documents; neither number changes the result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = lasting(
        texts.mapInArrow(
            _profile(shingle_words, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
        ),
        "profiles"
    )
    with passing():
        real = profile.filter("n_shingles > 0 and doc_id is not null")
        classes = stored(
            real.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")),
            "classes"
        )

        spread = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
        centres = spread.groupBy("key").agg(
            F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("size")
        ).filter("size > 1")
        centres = stored(centres, "centres")
        # a document is the centre of at most as many buckets as it has bands
        dealt = stored(
            centres.groupBy(F.col("c.rep").alias("a")).agg(F.ceil(F.max("size") / DEAL).cast("int").alias("tasks")), "dealt"
        )
        centres = centres.withColumn("a", F.col("c.rep")).join(dealt, "a")
        members = stored(
            spread.join(centres, "key").select(
                "key", "rep", "n", F.col("c.rep").alias("centre"), F.col("c.n").alias("m"), "tasks"
            ),
            "members"
        )
        wanted = members.select(F.col("rep").alias("doc_id")).distinct()
        sets = stored(
            texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "doc_id long, items array<long>"),
            "sets"
        )

        pairs = members.filter("rep <> centre").filter(_near(percent)).select(
            F.col("centre").alias("a"), F.col("rep").alias("b"), "tasks"
        ).distinct()
        label = components(_confirmed(pairs, sets, percent, dealt)).select(F.col("node").alias("rep"), "component")
        placed = stored(
            members.select("key", "rep", "n").join(label, "rep", "left").withColumn(
                "component", F.coalesce("component", "rep")
            ),
            "labelled"
        )
        named = classes.select("n_shingles", "d1", "d2", "rep").join(label, "rep", "left").withColumn(
            "component", F.coalesce("component", "rep")
        )
        mixed = stored(
            placed.groupBy("key").agg(
                F.min("component").alias("low"), F.max("component").alias("high")
            ).filter("low < high").select("key"),
            "mixed"
        )
        if not mixed.isEmpty():
            # what is joined is written first: a join of bare exchanges can be split by Spark where a key is hot
            open_ = stored(placed.join(mixed, "key"), "open")
            volume = stored(
                open_.select("rep", "component").distinct().groupBy("component").agg(F.count("*").alias("volume")),
                "volumes"
            )
            open_ = stored(open_.join(volume, "component"), "placed")
            top = open_.groupBy("key").agg(F.max(F.struct("volume", "component")).alias("top"))
            top = stored(
                top.select("key", F.col("top.component").alias("main"), F.col("top.volume").alias("main_size")), "tops"
            )
            merged = components(_across(open_.join(top, "key"), sets, percent, few, block)).select(
                F.col("node").alias("component"), F.col("component").alias("root")
            )
            named = named.join(merged, "component", "left").withColumn("component", F.coalesce("root", "component"))
        named = lasting(named.select("n_shingles", "d1", "d2", "component"), "named")
    placed = profile.select("doc_id", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the smallest doc_id."""
    kept = link(docs, **options).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
