"""Whole files: copies in parallel, concatenation, flattening; and the registry of readers.

Copies run in tasks, a file each, in blocks, between any file systems that pyarrow knows. A copy is written beside its place and renamed, so a task that is
run again does no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 8 << 20
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _listed(uri: str) -> list[tuple[str, str, int]]:
    """(path within the folder, uri, bytes) of the files below ``uri``, without hidden ones."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:
        return [(path.rsplit("/", 1)[-1], uri, fs.get_file_info(path).size)]
    scheme = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    inner = [(f.path[len(path.rstrip("/")) + 1 :], f"{scheme}{f.path}", f.size) for f in found if f.type == pafs.FileType.File]
    return sorted(x for x in inner if not any(part.startswith((".", "_")) for part in x[0].split("/")))


def copy(spark: SparkSession, source: str, target: str, tasks: int = 64) -> DataFrame:
    """Copies the files below ``source`` to ``target``; (path, bytes) of each. Files of the same length at their place are passed over."""
    return _copied(spark, _listed(source), target, tasks)


def flatten(spark: SparkSession, source: str, target: str, tasks: int = 64) -> DataFrame:
    """Copies the files of all folders below ``source`` into one, their folders' names joined to theirs."""
    return _copied(spark, [(path.replace("/", "-"), uri, size) for path, uri, size in _listed(source)], target, tasks)


def _copied(spark: SparkSession, listed: list[tuple[str, str, int]], target: str, tasks: int) -> DataFrame:
    files = spark.createDataFrame(listed, "path string, uri string, size long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for path, uri, size in zip(*(b.column(c).to_pylist() for c in ("path", "uri", "size"))):
                a, from_ = pafs.FileSystem.from_uri(uri)
                z, root = pafs.FileSystem.from_uri(target)
                to = f"{root.rstrip('/')}/{path}"
                info = z.get_file_info(to)
                if info.type != pafs.FileType.File or info.size != size:
                    z.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    with a.open_input_stream(from_) as src, z.open_output_stream(f"{to}.copying") as out:
                        while block := src.read(BLOCK):
                            out.write(block)
                    z.move(f"{to}.copying", to)
                done.append((path, size))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "bytes"])

    done = files.repartition(max(1, min(tasks, len(listed)))).mapInArrow(run, "path string, bytes long").collect()  # a row per file
    return spark.createDataFrame(done, "path string, bytes long")


def concat(spark: SparkSession, paths: list[str], target: str, files: int = 1) -> None:
    """Lines of text files, each file's in order and the files in the order given, in ``files`` files."""
    parts = [spark.read.text(p).select("value", F.lit(k).alias("k"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")) for k, p in enumerate(paths)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every.repartitionByRange(files, "k", "f", "i").sortWithinPartitions("k", "f", "i").select("value").write.mode("overwrite").text(target)


def compact(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Few large Parquet files in place of many small ones."""
    df.repartition(max(1, -(-df.count() // rows_per_file))).write.mode("overwrite").parquet(path)


# Readers by name.


def register_reader(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """``reader`` (session, path) takes the paths that end in ``extension``; later registrations replace earlier ones."""
    READERS[extension.lower().lstrip(".")] = reader


def read(spark: SparkSession, path: str, default: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """Reads by the path's ending: the longest registered one, else ``default``, else text."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for extension in sorted(READERS, key=len, reverse=True):
        if name.endswith(f".{extension}"):
            return READERS[extension](spark, path)
    return default(spark, path) if default else spark.read.text(path)


register_reader("parquet", lambda spark, path: spark.read.parquet(path))
register_reader("json", lambda spark, path: spark.read.json(path))
