"""Archives of pages: monolithic gzip files, normalised to one gzip member per record with an offset index (operator 1).

1. ``write_monolithic`` writes one archive per task, all its records in a single gzip stream, as crawlers that compress whole
   files leave them. It returns a manifest (file, place in the file, page_id, payload digest and size).
2. ``decide`` finds, on the manifest alone, the response of each payload (smallest page_id) and the revisits of the rest.
   Digests are counted before they are shuffled, and no payload moves.
3. ``normalise`` inflates each file once as a stream, record by record, rewrites every record as a gzip member of its own,
   revisits without payload, and writes the sidecar index (offset, length, place). Memory holds one record.
4. ``read_back`` opens members by their offsets in the index and recomputes length and digest of every payload.

Every file appears under its name only when whole, and each step ends in a written table, so a lost executor repeats one file
at most. A null html is an empty payload. A null page_id is never a first page unless all pages of its payload have none;
repeated rows of the first page are responses each. Lines that the header would break (in url or id) are escaped. Extra
columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder
from .common import cut, open_folder, whole_file

LEVEL = 4
_ENTRY = "<QQQ"
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], payload: bytes) -> bytes:
    lines = "".join(f"{key}: {value}\r\n" for key, value in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not an archive record")
    return dict(line.split(": ", 1) for line in lines if line)


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    name = uri[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


class RecordStream:
    """Records of a gzip file, inflated once from front to back, however many members it has."""

    def __init__(self, stream, block: int = 1 << 18) -> None:
        self.stream, self.block, self.buffer, self.engine = stream, block, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.engine.unused_data if self.engine.eof else b""
        data = data or self.stream.read(self.block)
        if not data:
            if not self.engine.eof and self.buffer:
                raise ValueError("archive ends inside a record")
            return False
        if self.engine.eof:
            self.engine = zlib.decompressobj(31)
        self.buffer += self.engine.decompress(data)
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buffer:
                        raise ValueError("archive ends inside a header")
                    return
            headers = parse_headers(bytes(self.buffer[:end]))
            size = int(headers.pop("Content-Length"))
            while len(self.buffer) < end + size + 8:
                if not self._more():
                    raise ValueError("archive ends inside a payload")
            yield headers, bytes(self.buffer[end + 4 : end + 4 + size])
            del self.buffer[: end + size + 8]


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of whole-file gzip; returns file, place, page_id, payload_digest, payload_bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        number, place, batch = TaskContext.get().partitionId(), 0, first
        system, base = open_folder(folder)
        with whole_file(system, f"{base}/crawl-{number:06d}.warc.gz") as out:
            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            while batch is not None:
                rows = []
                for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    payload = (html.as_py() or "").encode()
                    headers = {
                        "WARC-Type": "response", "WARC-Record-ID": _uri(page_id), "WARC-Date": _DATE,
                        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Payload-Digest": f"sha1:{digest(payload)}",
                    }
                    out.write(engine.compress(record(headers, payload)))
                    rows.append((number, place, page_id, headers["WARC-Payload-Digest"][5:], len(payload)))
                    place += 1
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame(rows, columns=["file", "place", "page_id", "payload_digest", "payload_bytes"]).astype({"page_id": "Int64"}),
                    schema=pa.schema([("file", pa.int64()), ("place", pa.int64()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]),
                    preserve_index=False,
                )
                batch = next((b for b in batches if b.num_rows), None)
            out.write(engine.flush())

    _make_folder(pages.sparkSession, folder)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cut(rows.mapInArrow(write, "file bigint, place bigint, page_id bigint, payload_digest string, payload_bytes bigint"), "crawl-manifest")


def decide(manifest: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records that revisit another: file, place, refers_to. Payloads below ``least_bytes`` are never revisited."""
    rows = manifest.where(F.col("payload_bytes") >= least_bytes)
    first = rows.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    found = rows.join(first, "payload_digest").where("NOT page_id <=> first")
    return cut(found.select("file", "place", F.col("first").alias("refers_to")), "revisits")


def normalise(manifest: DataFrame, revisits: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite each archive with one member per record and a sidecar index; returns file, records.

    A file meets its own revisits only; both are as many as the records one task wrote.
    """

    def rewrite(key: tuple, files: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        if not len(files):
            return pd.DataFrame({"file": [], "records": []})
        refers = dict(zip(own["place"].tolist(), own["refers_to"].tolist(), strict=True))
        system, base = open_folder(source)
        target_system, target = open_folder(folder)
        name, offset, place = f"{target}/page-{number:06d}", 0, 0
        with (
            system.open_input_stream(f"{base}/crawl-{number:06d}.warc.gz", compression=None) as stream,
            whole_file(target_system, f"{name}.warc.gz") as out,
            whole_file(target_system, f"{name}.idx") as index,
        ):
            for headers, payload in RecordStream(stream):
                headers["Payload-Length"] = str(len(payload))
                if place in refers:
                    headers |= {"WARC-Type": "revisit", "WARC-Refers-To": _uri(int(refers[place]))}
                    payload = b""
                engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = engine.compress(record(headers, payload)) + engine.flush()
                out.write(member)
                index.write(struct.pack(_ENTRY, offset, len(member), place))
                offset, place = offset + len(member), place + 1
        return pd.DataFrame({"file": [number], "records": [place]})

    _make_folder(manifest.sparkSession, folder)
    files = manifest.select("file").distinct()
    many = max(1, files.count())  # an explicit number: tasks by files, not by the few bytes of their rows
    files = files.repartition(many, "file").groupBy("file")
    return cut(files.cogroup(revisits.repartition(many, "file").groupBy("file")).applyInPandas(rewrite, "file bigint, records bigint"), "archives")


def read_member(records, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    records.seek(offset)
    raw = zlib.decompress(records.read(length), 31)
    end = raw.index(b"\r\n\r\n")
    headers = parse_headers(raw[:end])
    payload = raw[end + 4 : -4]
    if len(payload) != int(headers["Content-Length"]):
        raise ValueError("record length differs from its header")
    return headers, payload


def read_back(archives: DataFrame, folder: str) -> DataFrame:
    """Rows of all records, found through the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        for batch in batches:
            for number in batch["file"]:
                system, base = open_folder(folder)
                path, rows = f"{base}/page-{number:06d}", []
                with system.open_input_file(f"{path}.warc.gz") as records, system.open_input_stream(f"{path}.idx", compression=None) as index:
                    while entry := index.read(struct.calcsize(_ENTRY)):
                        offset, length, _ = struct.unpack(_ENTRY, entry)
                        headers, payload = read_member(records, offset, length)
                        revisit = headers["WARC-Type"] == "revisit"
                        size = int(headers["Payload-Length"]) if revisit else len(payload)
                        mark = headers["WARC-Payload-Digest"][5:] if revisit else digest(payload)
                        refers = _page_id(headers["WARC-Refers-To"]) if revisit else None
                        rows.append((_page_id(headers["WARC-Record-ID"]), size, mark, headers["WARC-Type"], refers, headers.get("WARC-Target-URI", "")))
                        if len(rows) == 4096:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    files = archives.select("file")
    return files.repartitionByRange(max(1, files.count()), "file").mapInPandas(read, schema)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    source, folder = (fresh_folder(pages.sparkSession, label) for label in ("crawl", "warc"))
    manifest = write_monolithic(pages, source)
    return read_back(normalise(manifest, decide(manifest, least_bytes), source, folder), folder)
