"""Copy of a partition tree to another place, file by file.

The files are listed by Spark's binary-file source without reading them; those
that the target holds already in full length are left out, so a repeated run
goes on where a killed one stopped. Each task streams its files in blocks to a
name of its own and moves them into place, so a reader of the target never
sees half a file and a retried task does no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 8 << 20


def listing(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(name, length) of the files under ``root``, names relative to it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return spark.createDataFrame([], "name string, length long")
    full = files.makeQualified(at).toString().rstrip("/")
    path = F.regexp_replace("path", "^file:/+", "file:/")
    prefix = len(full.replace("file:///", "file:/")) + 2
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(root).select(F.substring(path, prefix, 1 << 20).alias("name"), "length"))


def _uri(root: str) -> str:
    return root if "://" in root else f"file://{root}"


def copy_tree(spark: SparkSession, source: str, target: str, pattern: str = "*.parquet", tasks: int = 64) -> int:
    """Mirror the files under ``source`` to ``target``; returns how many had to be copied."""
    have = listing(spark, target, pattern)
    todo = listing(spark, source, pattern).join(have, ["name", "length"], "left_anti")
    src, dst = _uri(source).rstrip("/"), _uri(target).rstrip("/")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_fs, from_root = fs.FileSystem.from_uri(src)
        to_fs, to_root = fs.FileSystem.from_uri(dst)
        for b in batches:
            for name in b.column(0).to_pylist():
                place = f"{to_root}/{name}"
                folder, base = place.rsplit("/", 1)
                to_fs.create_dir(folder, recursive=True)
                # Readers of the tree pass over names with a leading underscore.
                beside = f"{folder}/_part-{uuid.uuid4().hex[:8]}-{base}"
                with from_fs.open_input_stream(f"{from_root}/{name}") as r, to_fs.open_output_stream(beside) as w:
                    while block := r.read(BLOCK):
                        w.write(block)
                to_fs.move(beside, place)
            yield b

    # Long and short files spread over the tasks by their names.
    return todo.repartition(tasks, "name").mapInArrow(copy, todo.schema).count()
