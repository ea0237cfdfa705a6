"""Intermediate tables in the shared checkpoint folder.

A table that several later steps read is written once as Parquet and read back, which
cuts lineage and survives the loss of executors. The folder is the one that the cluster
names in ``spark.checkpoint.dir``. Where that is unset a temporary folder serves a session on one machine
(master ``local``); on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Session, folder and label of each query's tables.
_own: list[tuple[SparkSession, str, str]] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stratum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Named intermediate tables of one query. They go when dropped or when the program ends,
    because the frame that the query returns may still read them."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/stratum-{label}-{uuid.uuid4().hex}"
        _own.append((spark, self.root, label))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema: StructType = df.schema
        # Small row groups: a task buffers one in memory, with whole texts in it.
        df.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def release(spark: SparkSession, labels: set[str]) -> None:
    """Deletes the tables of earlier queries with these labels, whose results have been written elsewhere."""
    for entry in [x for x in _own if x[0] is spark and x[2] in labels]:
        _delete(spark, entry[1])
        _own.remove(entry)


@atexit.register
def _clean() -> None:
    for spark, root, _ in _own:
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than that. Gate for broadcasts."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores by ``keys``, before steps in Python: millions of narrow rows are a single split of a Parquet file, and adaptive
    execution joins small partitions to one, whatever a row costs later on."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
