"""Session facts and shared-folder files that the operators have in common."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.sources.scratch import delete, file_system, scratch, written

#: Tables of the ``passing`` blocks that are open in this thread, the innermost last.
_open: ContextVar[tuple[dict[str, SparkSession], ...]] = ContextVar("open", default=())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends here."""
    path = scratch(df.sparkSession, name)
    if _open.get():
        _open.get()[-1][path] = df.sparkSession
    return written(df, path)


def beside(df: DataFrame, root: str | None, name: str) -> DataFrame:
    """``stored``; but below a ``root`` that the user named, where it stays with the files it tells of."""
    if root is None:
        return stored(df, name)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(schema).parquet(f"{root}/{name}")


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Tables stored within are deleted at the end, but for those stored under ``lasting``.

    What outlives the block must read lasting tables only.
    """
    own: dict[str, SparkSession] = {}
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        for path, spark in own.items():
            delete(spark, path)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """``stored``, but kept when the ``passing`` block around ends; that block's own caller may let it pass."""
    token = _open.set(_open.get()[:-1])
    try:
        return stored(df, name)
    finally:
        _open.reset(token)


def boxed(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` as one column ``doc``, so no added name clashes, beside the columns ``names``."""
    return docs.select(F.struct("*").alias("doc"), *names)


def unnamed_numbered(docs: DataFrame) -> DataFrame:
    """doc (all of a row), doc_id, text and ``row_``: a number of its own for each row without doc_id, null for others; written if there is one."""
    shown = lambda df, row: df.select(
        "doc", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"), row.alias("row_")
    )
    rows = boxed(docs)
    if docs.filter("doc_id is null").isEmpty():
        return shown(rows, F.lit(None).cast("long"))
    return shown(
        stored(rows.withColumn("row_", F.monotonically_increasing_id()), "numbered"),
        F.when(F.col("doc.doc_id").isNull(), F.col("row_"))
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, the user's knob for data size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def put_file(path: str, pieces) -> int:
    """Write ``pieces`` (bytes-likes) to ``path`` whole or not at all; returns the length.

    A task that is retried or runs twice writes under a name of its own and
    renames at the end, so readers never see half a file.
    """
    files, inner = file_system(path)
    files.create_dir(os.path.dirname(inner), recursive=True)
    own, size = f"{inner}.{uuid.uuid4().hex}.tmp", 0
    with files.open_output_stream(own) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    files.move(own, inner)
    return size
