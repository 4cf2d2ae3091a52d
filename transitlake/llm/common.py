"""What the training-data jobs share: table access, Arrow batch bounds, lineage cuts.

Operators take the columns they need by name and ignore every other column
of their input, so extra columns never clash with the working columns.
"""

from __future__ import annotations

import ctypes
import functools
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.session import checkpoint_dir

#: Words of the corpus operators: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch sent to a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: Rows that Parquet's reader decodes at a time; texts and chunks can be long.
READ_ROWS = 512

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and make this package importable on the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    # Workers see the package through PYTHONPATH or the working directory;
    # otherwise Spark's file server hands it out.
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT in [*seen, os.path.realpath(os.getcwd())] or "site-packages" in _ROOT:
        return
    sc = spark.sparkContext
    if getattr(sc, "_transitlake_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="transitlake-zip-"), "transitlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "transitlake")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    at = list(sys.path)
    sc.addPyFile(path)
    sys.path[:] = at
    sc._transitlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the session names (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rejoin(rows: DataFrame, found: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``found``, an aggregate of theirs by ``key``.

    The join's key is the complement of the first (integer) key. That is a new
    key to Spark, which therefore does not put the join on the aggregate's
    partitions: both sides get an exchange of their own and AQE can split the
    rows of a hot key.
    """
    keys = [key] if isinstance(key, str) else key
    turned = {keys[0]: F.bitwise_not(keys[0])}
    return rows.withColumns(turned).join(found.withColumns(turned), keys, how).withColumns(turned)


def crc_mod(id_col: str, n: int):
    """``crc32(id as text) mod n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def tidy(run: Callable) -> Callable:
    """``run``, giving freed memory back to the system as its task ends.

    Workers wait for their next task beside the JVM; without this they hold
    the largest batch that they ever worked on.
    """
    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def release() -> None:
    """Free memory that Arrow's pool and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, col: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` whose ``col`` holds about ``limit`` bytes (one row at least)."""
    text = batch.column(batch.schema.get_field_index(col))
    n, start, held = batch.num_rows, 0, 0
    sizes = pc.binary_length(text).to_pylist()
    for i in range(n):
        held += sizes[i] or 0
        if held >= limit:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < n:
        yield batch.slice(start, n - start)
