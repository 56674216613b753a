"""What clients answered, kept by what they were asked, so that nothing is asked twice.

A row an answer: the SHA-256 of the client's name and the question, the
answer, whether there was one, and when. Failures are kept like answers for as
long as they live, as the sources' own caches do. A question is asked only if no
living answer is stored; the same question in many rows is asked once. New
answers are appended before they are used, so a job that runs again finds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.operators.enrich import fetched
from waypost.sources.scratch import exists

_SCHEMA = "digest string, answer string, error string, at timestamp"


def digest(client: str, question: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{client}\x00"), question), 256)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All answers, the dead ones too."""
    if not exists(spark, path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(path)


def living(spark: SparkSession, path: str, seconds: float, now: Column | None = None) -> DataFrame:
    """digest, answer, error: the latest answer to each question, if it is younger than ``seconds``."""
    now = F.current_timestamp() if now is None else now
    young = stored(spark, path).filter(F.col("at") > now - F.make_dt_interval(secs=F.lit(float(seconds))))
    return young.groupBy("digest").agg(F.max(F.struct("at", "answer", "error")).alias("a")).select("digest", "a.answer", "a.error")


def asked(
    df: DataFrame, question: str, client: str, call: Callable[[str], str], path: str, seconds: float, now: Column | None = None, **how
) -> DataFrame:
    """``df`` with site_text and error, what ``call`` answers to the column ``question``, asked only where no answer lives.

    ``seconds`` is how long answers live, ``now`` the time that counts (by
    default the clock); further options go to ``fetched``. Null questions aren't asked.
    """
    spark = df.sparkSession
    texts = df.select(F.col(question).alias("question_")).filter("question_ is not null").distinct()
    texts = texts.withColumn("digest", digest(client, F.col("question_")))
    new = texts.join(living(spark, path, seconds, now).select("digest"), "digest", "left_anti")
    said = fetched(new, call, "question_", **how)
    stamp = F.current_timestamp() if now is None else now
    said.select("digest", F.col("site_text").alias("answer"), "error", stamp.alias("at")).write.mode("append").parquet(path)
    known = living(spark, path, seconds, now).withColumnsRenamed({"digest": "digest_", "answer": "site_text"})
    return df.withColumn("digest_", digest(client, F.col(question))).join(known, "digest_", "left").drop("digest_")
