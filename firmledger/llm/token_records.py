"""Length-delimited binary token records with masked checksums and a separate offset index (operator 4).

A record file holds, for each sequence in ascending document order:

    length     unsigned 64-bit, little-endian, bytes of the body
    check      unsigned 32-bit, masked CRC-32 of the eight length bytes
    body       the ids, unsigned 16-bit where the vocabulary fits, else unsigned 32-bit, little-endian
    check      unsigned 32-bit, masked CRC-32 of the body

The index beside it holds one fixed-size entry per record (offset, body bytes, doc_id, flag for a null doc_id), so a reader that
shuffles can seek to any record. A mask (rotation by 15 bits and a constant) keeps a checksum of data that holds checksums
from being degenerate. Files appear under their names only when whole.

Nulls and ties: a null text is empty and gives the end id alone; rows with a null doc_id come first; equal doc_ids are ordered
by text, and equal rows each get a record. Extra columns are ignored. An empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_folder
from .common import cut, open_folder, whole_file
from .encode import Encoder

_HEAD, _CHECK = struct.Struct("<Q"), struct.Struct("<I")
_ENTRY = "<QQqB"
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    head = _HEAD.pack(len(body))
    return head + _CHECK.pack(masked(head)) + body + _CHECK.pack(masked(body))


def unframe(stream) -> bytes | None:
    """Next body of a record stream; None at its end, ValueError where bytes are missing or damaged."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or _CHECK.unpack(head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = _HEAD.unpack(head[:8])[0]
    body, check = stream.read(size), stream.read(4)
    if len(body) < size or len(check) < 4 or _CHECK.unpack(check)[0] != masked(body):
        raise ValueError("damaged record body")
    return body


def write_records(docs: DataFrame, vocabulary: str, end_id: int, folder: str) -> DataFrame:
    """Write record and index files of ``docs(doc_id, text)``; return one row per file.

    Documents are range-partitioned by doc_id before they are encoded, so the shuffle carries text and not ids, and file
    numbers follow the document order. The manifest is cut, so no later read writes the files again.
    """
    type_code = "<u2" if _vocabulary_size(vocabulary) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        system, base = open_folder(folder)
        encoder, path = Encoder.of(vocabulary), f"{base}/part-{number:06d}"
        docs_done = tokens = offset = 0
        with whole_file(system, f"{path}.rec") as out, whole_file(system, f"{path}.idx") as index:
            batch = first
            while batch is not None:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.each(batch.column(1)), strict=True):
                    body = np.append(ids, np.uint32(end_id)).astype(type_code).tobytes()
                    out.write(frame(body))
                    index.write(struct.pack(_ENTRY, offset, len(body), doc_id or 0, doc_id is None))
                    offset, docs_done, tokens = offset + len(body) + 16, docs_done + 1, tokens + len(ids) + 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"file": [number], "n_docs": [docs_done], "n_tokens": [tokens]})

    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, "file bigint, n_docs bigint, n_tokens bigint"), "token-files")


def read_records(files: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Read every record back, checksums verified: doc_id, file, start in the file, ids.

    ``files`` has one row per file; each file is one unit of work and is read as a stream.
    """
    # An explicit number: one task per file, not as many as the few bytes of these rows ask for.
    return files.select("file").repartitionByRange(max(1, files.count()), "file").mapInArrow(
        _reader(vocabulary, folder), "doc_id bigint, file bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def _reader(vocabulary: str, folder: str):
    type_code = "<u2" if _vocabulary_size(vocabulary) <= 1 << 16 else "<u4"
    names = ["doc_id", "file", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                system, base = open_folder(folder)
                path, start = f"{base}/part-{number:06d}", 0
                with system.open_input_stream(f"{path}.rec") as stream, system.open_input_stream(f"{path}.idx") as index:
                    rows: list[tuple] = []
                    while entry := index.read(struct.calcsize(_ENTRY)):
                        _, size, doc_id, null = struct.unpack(_ENTRY, entry)
                        body = unframe(stream)
                        if body is None or len(body) != size:
                            raise ValueError(f"index and records of file {number} differ")
                        ids = np.frombuffer(body, type_code).astype("<u4")
                        rows.append((None if null else doc_id, number, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    return read


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def read_ids(path: str, index: int, vocabulary: str) -> np.ndarray:
    """Ids of one record by its place in the index: a seek, not a scan."""
    system, base = open_folder(path)
    with system.open_input_file(f"{base}.idx") as entries, system.open_input_file(f"{base}.rec") as records:
        entries.seek(index * struct.calcsize(_ENTRY))
        offset = struct.unpack(_ENTRY, entries.read(struct.calcsize(_ENTRY)))[0]
        records.seek(offset)
        return np.frombuffer(unframe(records), "<u2" if _vocabulary_size(vocabulary) <= 1 << 16 else "<u4")


def _vocabulary_size(vocabulary: str) -> int:
    return Encoder.of(vocabulary).tokenizer.get_vocab_size()


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encode, write and read back: doc_id, start in the whole corpus, n_tokens, ids_crc32.

    The starts of the files are a running sum over the manifest, which has one row per file.
    """
    folder = fresh_folder(docs.sparkSession, "token-records")
    files = write_records(docs, vocabulary, end_id, folder)
    bases = files.select(
        "file", (F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("base")
    )
    rows = read_records(files, vocabulary, folder)
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
