"""Continuous insertion: each micro-batch of a stream goes into an index by the index's own cells."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.index import Index, insert


def stream_into(index: Index, stream: DataFrame, checkpoint: str, trigger_once: bool = True):
    """Starts a query that inserts the stream's rows; with ``trigger_once`` it ends when what is there has been taken.

    A batch is one version of the index, by its number: if it is run again after a failure it is written over what the failed attempt left, or,
    if its version has been published, passed over. Nothing else may insert into the index meanwhile.
    """
    first = index.version() + 1
    marks = f"{index.path}/stream-{abs(hash_of(checkpoint)):x}"
    hadoop = index.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks)
    fs = hadoop.getFileSystem(index.spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop):  # an earlier start of the same stream: its numbers go on
        first = int(index.spark.read.text(marks).first()[0])
    else:
        index.spark.createDataFrame([(str(first),)], "value string").coalesce(1).write.mode("overwrite").text(marks)

    def one(batch: DataFrame, number: int) -> None:
        insert(index, batch, first + number)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode())


def windowed_counts(stream: DataFrame, time: str, cell: float, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, cx, cy, value): counts per time window and square cell, with a watermark; works on a batch, too."""
    w = F.window(time, width)
    cx, cy = (F.floor(F.col(c) / cell).cast("long") for c in ("x", "y"))
    base = stream.withWatermark(time, late) if stream.isStreaming else stream
    return base.groupBy(w.alias("window"), cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("value"))
