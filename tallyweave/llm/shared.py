"""What the operators share: the folder that driver and executors both see, tables written to it, and small column rules.

Every intermediate result that is used twice is a Parquet table in that folder, never a local
checkpoint: a lost executor costs a re-read, not a recomputation, and lineage ends there.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: bounds what a Python worker holds of whole texts.
ARROW_ROWS = 1000
#: Bytes of one, unless a single row has more.
ARROW_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where it is unset (local tests) a temporary one is made and set."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tallyweave-')}"
        atexit.register(__import__("shutil").rmtree, at.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_taken: list[str] = []
_given: list[tuple] = []


def _clean() -> None:
    """Paths that are left when the driver ends go."""
    for conf, path in _given:
        with contextlib.suppress(Exception):  # the engine may be gone before
            path.getFileSystem(conf).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there is needed until the result that reads it has been used; it goes when the driver ends."""
    if not _given:
        atexit.register(_clean)
    _given.append((spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")))
    _taken.append(_given[-1][1].toString())
    return _taken[-1]


def taken() -> list[str]:
    """The paths given out since this was last asked."""
    out = list(_taken)
    _taken.clear()
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions_for(df: DataFrame, size: int) -> int:
    """Partitions of about ``size`` bytes each, by what the planner knows of the input (if it does), and as many as a shuffle has at least."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, min(known // size, 1_000_000) if known < 1 << 55 else 0)


def release(spark: SparkSession) -> None:
    """Let the driver delete the shuffle files of results that nothing refers to any more; else they stay until it happens to collect its garbage."""
    spark.range(1).collect()  # the engine holds on to the query that ran last
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, name: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder (or at ``path``)."""
    at = path or fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts stays in bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def free_name(taken: Sequence[str], name: str) -> str:
    """name, or name with underscores before it, such that no column has it (case aside)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def local_fs(path: str):
    """(file system, path in it) of pyarrow for a path in the shared folder."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


_clear: dict[str, list] = {}
_holder: list[str] = []


def holds(owner: str, clear) -> None:
    """Register how a worker lets go of what ``owner`` keeps between batches."""
    _clear.setdefault(owner, []).append(clear)


def claim(owner: str) -> None:
    """``owner`` is at work in this process: what the others keep goes, and the memory with it, so that a reused worker holds one operator's memos at a time."""
    if _holder != [owner]:
        _holder[:] = [owner]
        for name, clears in _clear.items():
            if name != owner:
                for clear in clears:
                    clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def put_file(path: str, data: bytes) -> None:
    """Write a file whole under a name of its own, then rename it: a task that runs twice leaves one whole file."""
    files, at = local_fs(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(own) as f:
        f.write(data)
    try:
        files.move(own, at)
    except OSError:  # some stores don't rename over a file; one that is there has the same bytes
        if files.get_file_info(at).type.name != "File":
            raise
        files.delete_file(own)
