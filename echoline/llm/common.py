"""What the operators share: tables, the cluster's shared folder, and word rules."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A word of the contracts. ``bytes.split()`` cuts at exactly the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Folders of the tables written so far, by the ``temporary`` blocks that they belong to.
_scopes: list[list[str]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a temporary folder,
    which its one machine shares with itself. A cluster without it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='echoline-')}")
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared folder, of the innermost ``temporary`` block or of the one around it."""
    folder = f"{shared_dir(spark).rstrip('/')}/echoline-{uuid.uuid4().hex[:12]}"
    _scopes[max(0, len(_scopes) - 1 - outlives)].append(folder)
    return f"{folder}/{name}"


def materialise(df: DataFrame, name: str, outlives: bool = False, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    Inside a ``temporary`` block the table ends with the block, unless it ``outlives`` it. ``rows``: no more rows than
    that, a few numbers each, are expected; tasks follow from it, so that small tables are not many files.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // 200_000)))
    path = scratch(df.sparkSession, name, outlives)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: list[str]) -> int:
    conf, done = spark._jsc.hadoopConfiguration(), 0
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end; nothing lazy that reads them may leave the block."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that are left of all operators so far; call it once results are stored elsewhere."""
    folders = [f for scope in _scopes for f in scope]
    for scope in _scopes:
        scope.clear()
    return _delete(spark, folders)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffles that nothing refers to any more leave the executors' disks when the driver collects garbage, which may be much later: have it done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """``table`` (materialised, a few numbers a row) marked for broadcasting if a count shows that it is short."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Gives memory that a worker has freed back to the system, so that workers that wait hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def n_words(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
