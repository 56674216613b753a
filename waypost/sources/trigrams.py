"""Names filed under their letters, so that a search reads posting lists instead of the table.

Every sequence of one, two and three letters of a lower-cased text is a gram,
and a posting is where it stands: gram, field, text, position. A text holds
a search text if grams that cover the search text stand at fitting distances,
so positions decide and no text is read again. Search texts of one or two
letters are grams themselves. Postings are sorted by gram and dealt to files of
equal numbers of rows, frequent grams to several; a manifest tells each file's
first and last gram, and a search opens only files that may hold its grams.

A text is filed once however many places have it, under two independent hashes
(128 bits); its places are listed in files of their own, dealt by these hashes,
of which a search opens those of the texts it found. Files grow in number with
the rows, not in size.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.sources.scratch import delete, filed, written

#: Letters of the longest grams.
N = 3
FIELDS = ("naam", "provincie")
#: Rows of a file, and so of the task that sorts it.
ROWS = 1_000_000


def _grams(text: Column, n: int) -> Column:
    """(gram, at) of all sequences of ``n`` letters, positions from 1."""
    last = F.length(text) - n + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.substr(text, i, F.lit(n)).alias("gram"), i.alias("at")))


def texts(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """field (its number), text (lower-cased), place_id, for each text that there is."""
    told = [F.struct(F.lit(i).alias("field"), F.lower(F.col(c)).alias("text")) for i, c in enumerate(fields)]
    return df.select("place_id", F.explode(F.array(*told)).alias("f")).select("f.field", "f.text", "place_id").filter("text is not null")


def _keyed(df: DataFrame) -> DataFrame:
    """With the text's two hashes instead of the text."""
    return df.withColumns({"key": F.xxhash64("text"), "key_": F.xxhash64(F.lit("second"), "text")}).drop("text")


def postings(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """gram, field (its number), key, key_ (the text's), at."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by another hash than that of distinct(), and to a given number of tasks, or Spark would make one of few texts
    once = texts(df, fields).select("field", "text").distinct().repartition(parts, F.xxhash64("text"))
    grams = F.concat(*[_grams(F.col("text"), n) for n in range(1, N + 1)])
    rows = _keyed(once.withColumn("g", F.explode(grams)))
    return rows.select("g.gram", "field", "key", "key_", "g.at")


def _dealt(df: DataFrame, path: str, name: str, files: int, order: list[str]) -> None:
    """The rows in files by ranges of ``order``, at least ``files`` and no more than about ``ROWS`` rows in one, and their manifest."""
    spark, low = df.sparkSession, order[0]
    df = written(df, f"{path}/{name}-loose")
    files = max(files, -(-df.count() // ROWS))
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/{name}")
    read = spark.read.parquet(f"{path}/{name}").groupBy(F.col("_metadata.file_path").alias("file"))
    manifest = read.agg(F.min(low).alias("low"), F.max(low).alias("high"), F.count("*").alias("rows"))
    manifest.coalesce(1).write.parquet(f"{path}/manifest" if name == "rows" else f"{path}/{name}-manifest")
    delete(spark, f"{path}/{name}-loose")


def save(df: DataFrame, path: str, files: int, fields: tuple[str, ...] = FIELDS) -> None:
    """The index of the rows (place_id and the fields) below a new path."""
    _dealt(postings(df, fields), path, "rows", files, ["gram", "field", "key", "key_", "at"])
    _dealt(_keyed(texts(df, fields)), path, "members", files, ["key", "key_", "field", "place_id"])


def covering(text: str) -> list[tuple[int, str]]:
    """(offset, gram) of grams that together hold every letter of a search text of at least one letter."""
    if len(text) <= N:
        return [(0, text)]
    offsets = sorted({*range(0, len(text) - N + 1, N), len(text) - N})
    return [(i, text[i : i + N]) for i in offsets]


def files_of(spark: SparkSession, path: str, grams: list[str]) -> list[str]:
    """The files that may hold the grams; as many names as their lists fill."""
    may = functools.reduce(operator.or_, [(F.col("low") <= g) & (F.col("high") >= g) for g in grams])
    return [r.file for r in spark.read.parquet(f"{path}/manifest").filter(may).select("file").collect()]


def holding(spark: SparkSession, path: str, text: str) -> DataFrame:
    """field, key, key_: the texts that hold the lower-cased text."""
    wanted = covering(text)
    files = files_of(spark, path, [g for _, g in wanted])
    whole = spark.read.parquet(f"{path}/rows")
    lists = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    places = {g: [i for i, x in wanted if x == g] for _, g in wanted}
    offsets = F.create_map(*[x for g, at in places.items() for x in (F.lit(g), F.array(*map(F.lit, at)))])
    met = lists.filter(F.col("gram").isin(*places)).select(
        "field", "key", "key_", "at", F.explode(offsets[F.col("gram")]).alias("offset")
    ).select("field", "key", "key_", (F.col("at") - F.col("offset")).alias("start"))
    if len(wanted) > 1:
        met = met.groupBy("field", "key", "key_", "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    return met.select("field", "key", "key_").distinct()


def members(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """place_id of the texts (field, key, key_) that a search found; only files that may hold them are opened."""
    manifest = spark.read.parquet(f"{path}/members-manifest")
    near = found.join(F.broadcast(manifest), F.col("key").between(F.col("low"), F.col("high")))  # a row a file
    files = [r.file for r in near.select("file").distinct().collect()]
    whole = spark.read.parquet(f"{path}/members")
    lists = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    return lists.join(found, ["field", "key", "key_"], "left_semi").select("place_id")


def cascade(places: DataFrame, path: str, query: str) -> DataFrame:
    """Q1 by the index: place_id, use_ai of the places whose name holds the text, else whose province does, else of all.

    The table is read only where nothing holds the text, or nothing is asked.
    """
    text = query.strip().lower()
    everything = lambda ask: places.select("place_id", F.lit(ask).alias("use_ai"))
    if not text:
        return everything(False)
    hits = filed(holding(places.sparkSession, path, text), "hits")
    first = hits.agg(F.min("field")).first()[0]
    if first is None:
        return everything(True)
    return members(places.sparkSession, path, hits.filter(F.col("field") == first)).select("place_id", F.lit(False).alias("use_ai"))
