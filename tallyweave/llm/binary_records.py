"""Token ids as length-delimited binary records, with an offset index beside each file.

A data file is a run of records, in ascending order of document::

    length   u64 LE   bytes of the payload
    check    u32 LE   masked CRC-32 of the 8 length bytes
    payload           i64 LE document id (-2**63 where the document has none), u8 bytes per id (and 128 where the document has no id), then the ids, unsigned LE
    check    u32 LE   masked CRC-32 of the payload

An index file has one entry for each record of its data file: u64 LE offset of the record, u64 LE
bytes of the whole record, u64 LE ids before it in the file. A reader that shuffles seeks by it.
A CRC is masked as ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2**32, so that a CRC over data that
holds CRCs stays strong.

Each task writes files of at most ``file_bytes`` (one longer record has a file of its own) under
names made of its partition and a running number, each written aside and renamed when whole. A
task that runs again writes the same bytes under the same names, so a lost executor costs only
that task. The manifest (one row for each file) is a table and never passes through the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared, tokenize

#: The mask constant of the record format.
MASK_DELTA = 0xA282EAD8
#: Bytes in one data file.
FILE_BYTES = 32 << 20
#: Bytes of input that one task sorts and writes.
TASK_BYTES = 256 << 20
#: The mark of a record whose document has no id.
NO_ID = 0x80
MANIFEST = "part int, file int, path string, records long, ids long, bytes long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int, end: int) -> bytes:
    """The payload of the record in data[at:end]; ValueError where a check or a length fails."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked_crc(head):
        raise ValueError(f"record at {at}: its length is damaged")
    n = struct.unpack("<Q", head)[0]
    if at + n + 16 != end or len(data) < end:
        raise ValueError(f"record at {at}: its length does not fit the index")
    payload = data[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", data, at + 12 + n)[0] != masked_crc(payload):
        raise ValueError(f"record at {at}: its payload is damaged")
    return payload


class _File:
    def __init__(self) -> None:
        self.data, self.index, self.bytes, self.ids = [], [], 0, 0

    def add(self, payload: bytes, n_ids: int) -> None:
        record = frame(payload)
        self.index.append((self.bytes, len(record), self.ids))
        self.data.append(record)
        self.bytes += len(record)
        self.ids += n_ids

    def close(self, path: str) -> None:
        shared.put_file(f"{path}.bin", b"".join(self.data))
        shared.put_file(f"{path}.idx", np.array(self.index, "<u8").tobytes())


def write_records(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text: str = "text", partitions: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode the whole text of each document, append ``end_id``, and write records in ascending order of id under ``path``.

    Null texts are empty (their record holds the end id alone). Documents with a null id come
    first and are marked. Rows that repeat an id are all written, next to each other,
    ordered by text. An empty table leaves no file. Returns the manifest, read back from its table.

    One range exchange by id moves the texts; ids are unique or nearly so, so ranges are even, and
    equal ids are told apart by the text. Nothing else is shuffled.
    """
    spark = docs.sparkSession
    shared.arrow_batches(spark)
    tokenizer_path = tokenizer_path or tokenize.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions or shared.partitions_for(rows, TASK_BYTES)
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokenize.encoder(tokenizer_path)
        part, k, out, made = TaskContext.get().partitionId(), 0, _File(), []
        end = np.array([end_id], enc.dtype).tobytes()
        head = lambda doc: struct.pack("<qB", -(2**63) if doc is None else doc, enc.width | (NO_ID if doc is None else 0))

        def close() -> None:
            nonlocal out, k
            at = f"{path}/part-{part:06d}-{k:06d}"
            out.close(at)
            made.append((part, k, at, len(out.index), out.ids, out.bytes))
            out, k = _File(), k + 1

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                if out.bytes and out.bytes + len(ids) > file_bytes:
                    close()
                out.add(b"".join((head(doc), ids, end)), len(ids) // enc.width + 1)
        if out.index:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "path", "records", "ids", "bytes"])

    manifest = f"{path}/manifest"
    ordered.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def file_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the ids in all files before. Sums go by part first, so the one ordered window holds a row for each part."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    before = parts.select("part", (F.sum("part_ids").over(W.orderBy("part")) - F.col("part_ids")).alias("part_start"))
    inside = F.sum("ids").over(W.partitionBy("part").orderBy("file")) - F.col("ids")
    return manifest.join(before, "part").withColumn("start", F.col("part_start") + inside).drop("part_start")


def records_of(path: str) -> Iterator[tuple[int, bool, int, np.ndarray]]:
    """(document id as stored, whether the document has one, ids before it in the file, its ids) of each record of a data file, every check made."""
    files, at = shared.local_fs(f"{path}.idx")
    with files.open_input_stream(at) as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 3).tolist()
    files, at = shared.local_fs(f"{path}.bin")
    with files.open_input_file(at) as f:
        for offset, size, before in index:
            payload = unframe(f.read_at(size, offset), 0, size)
            doc, width = struct.unpack_from("<qB", payload)
            yield doc, not width & NO_ID, before, np.frombuffer(payload, f"<u{width & ~NO_ID}", offset=9)


def read_file(path: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document id as stored, ids before it in the file, its ids) of each record of a data file."""
    for doc, _, before, ids in records_of(path):
        yield doc, before, ids


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row for each record of the files: doc_id, start (ids of all records before), n_tokens, ids_crc32 (over unsigned 32-bit LE ids).

    A marked record gives a null doc_id; records that repeat are each read; a manifest without files gives no rows. A damaged record is an error.
    """
    shared.arrow_batches(spark)
    files = file_starts(manifest).select("path", "start")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(manifest.count(), 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                rows = [(doc if known else None, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, known, before, ids in records_of(path)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
