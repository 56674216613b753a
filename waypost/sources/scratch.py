"""Tables and files of passing use in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the setting is absent and Spark runs on one machine, as in tests,
    a temporary folder of the driver is made and announced as the checkpoint
    folder. On a cluster without the setting this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    held = getattr(context, "_waypost_root", None)
    if held is None:
        held = tempfile.mkdtemp(prefix="waypost-")
        context._waypost_root = held
        context.setCheckpointDir(f"file://{held}")
        atexit.register(shutil.rmtree, held, True)
    return f"file://{held}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/waypost/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at a path in the shared folder, read back: lineage ends here.

    The table goes when the application ends, if nobody deletes it before.
    """
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    files, where = hadoop(df.sparkSession, path)
    files.deleteOnExit(where)
    return df.sparkSession.read.schema(schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path, for the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = hadoop(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = hadoop(spark, path)
    files.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file or folder; raises where that fails."""
    files, where = hadoop(spark, path)
    if not files.rename(where, hadoop(spark, to)[1]):
        raise OSError(f"can't rename {path} to {to}")


def file_system(path: str):
    """(pyarrow file system, path in it) of a path of Spark's; usable on executors."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def filed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under a new path."""
    return written(df, scratch(df.sparkSession, name))
