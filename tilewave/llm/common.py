"""What the training-data operators share: table access, the shared folder, text columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of helper columns, so that they don't clash with a caller's own columns.
OWN = "__tw_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. A local master may leave it unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tilewave-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tilewave/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path  # type: ignore[attr-defined]
    return back


def drop_stored(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df.stored_at)  # type: ignore[attr-defined]


class Scratch:
    """Stores tables as stored() does, and deletes them when the result no longer reads them."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        self.held.append(stored(df, tag))
        return self.held[-1]

    def drop(self, *but: DataFrame) -> None:
        for df in self.held:
            if not any(df is x for x in but):
                drop_stored(df)
        self.held = [df for df in self.held if any(df is x for x in but)]


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc32_of(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once: a lambda evaluates what stands in it for each element, so a value is bound outside."""
    return F.transform(F.array(value), body)[0]


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
