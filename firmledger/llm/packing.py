"""Best-fit packing planned on the histogram of lengths (operator 10).

1. One pass over the texts cuts each document's ids (end id included) into pieces; only documents longer than a sequence are
   cut, and only their last piece may be short. The pass numbers the pieces of equal length inside its task.
2. The histogram has at most ``size`` rows whatever the corpus holds. Best-fit decreasing runs on its counts: runs of equal
   bins take runs of equal pieces, so the work depends on the number of lengths, not of documents.
3. The rank of a piece among all of its length is its number in the task plus the pieces of that length in earlier tasks: a
   window over per-task counts, so a length that a third of all pieces have is never one group of rows. Ranks then index
   the plan, and every piece knows its sequence and offset without meeting its neighbours.

Null or empty texts are pieces of one end id. Repeated rows are packed as often as they occur; a null doc_id stays null. Ties
fall to the task order of the pieces table, which is written once. Extra columns are ignored; an empty table packs to nothing.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .encode import Encoder

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, place bigint"


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` ids, with the task that made them and their number among its pieces of that length."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder.of(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + struct.pack("<I", end_id)
                for number, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    length = len(own) // 4
                    rows.append((doc_id, number, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            if rows:
                types = (pa.int64(), pa.int32(), *(pa.int64(),) * 5)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PIECES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, _PIECES)


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Returns slots (length, first rank, first sequence, offset) and the number of sequences: the pieces of a length whose rank is
    at least ``first rank`` and below that of the next slot take consecutive sequences from ``first sequence`` on.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # free ids -> runs of sequences (first, how many)
    free: list[int] = []
    slots, made = [], 0

    def leave(room: int, first: int, many: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                bisect.insort(free, room)
            runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                per = size // length  # a new sequence takes this length alone as far as it goes
                many, deep = (left // per, per) if left >= per else (1, left)
                slots += [(length, rank + k * many, made, k * length) for k in range(deep)]
                leave(size - deep * length, made, many)
                rank, left, made = rank + deep * many, left - deep * many, made + many
                continue
            room = free[at]
            first, many = runs[room].pop()
            if not runs[room]:
                del runs[room]
                free.pop(at)
            now = min(many, left)
            slots.append((length, rank, first, size - room))
            leave(room - length, first, now)
            if now < many:
                leave(room, first + now, many - now)
            rank, left = rank + now, left - now
    return slots, made


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """Pieces with their sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(pieces_of(docs, vocabulary, end_id, size), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("own"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    # At most `size` rows: one per length.
    counts = {row["length"]: row["n"] for row in counted.groupBy("length").agg(F.sum("own").alias("n")).collect()}
    slots, _ = plan(counts, size)
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = held.value
        lengths, first = np.unique(slot[:, 0], return_index=True)
        last = np.append(first[1:], len(slot))
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            own = np.searchsorted(lengths, length)
            low, high = first[own], last[own]
            while (open_ := high - low > 1).any():  # the last slot of the length that begins at or below the rank
                middle = (low + high) // 2
                right = open_ & (slot[np.minimum(middle, len(slot) - 1), 1] <= rank)
                low, high = np.where(right, middle, low), np.where(open_ & ~right, middle, high)
            columns = {name: batch.column(name) for name in batch.schema.names if name != "rank"}
            columns["sequence_id"] = pa.array(slot[low, 2] + rank - slot[low, 1])
            columns["offset"] = pa.array(slot[low, 3])
            yield pa.RecordBatch.from_pydict(columns)

    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
