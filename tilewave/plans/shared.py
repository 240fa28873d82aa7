"""The folder that driver and executors share, and streams that are drained into it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A local master may leave it unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tilewave-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def drained(stream: DataFrame, now: bool = True) -> DataFrame:
    """All rows that a stream puts out until its source is at its end. now: the source can tell its end at once, as files do."""
    spark, at = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state")
    if now:
        sink.trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    else:
        run = sink.start(f"{at}/out")
        run.processAllAvailable()
        run.stop()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def message_log(messages: DataFrame, key: list[str], batches: int = 3) -> DataFrame:
    """The stream of messages that were written to a log of some files for each batch, dealt out by their hash: in no order."""
    spark, at = messages.sparkSession, f"{shared_dir(messages.sparkSession)}/logs/{uuid.uuid4().hex}"
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    # the exchange's own hash also deals keys to the stream's tasks, so another one is taken
    messages.repartition(batches * each, F.xxhash64(*key)).write.parquet(at)
    return spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", each).parquet(at)
