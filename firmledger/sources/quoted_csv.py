"""CSV files with quoted line breaks, read by as many tasks as the file has splits.

A physical line may start inside a quoted field, which depends on everything before it. So each split of a file first states what it
does to that question: in which state it ends when it starts outside a field, and in which when it starts inside one. Composing
these pairs along the file gives the true state at the start of every split, and all splits cut their records at the same time.
Records that lie across a border are put together from their pieces. The driver holds one state per split, as Spark's own plan of
the scan does.

A quote opens a field only at the start of a field, and two quotes inside one stand for a quote; a stray quote in the middle of a
plain field is text. Files that do not split, such as gzip, are read the same way by one task each. The records are written once
to the shared folder, so that both passes see the same splits whatever happens to executors later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_folder

# Line ends as bytes of the encodings that need more than one.
_LINE_ENDS = {"UTF-16LE": "\n\x00", "UTF-16BE": "\x00\n"}


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open at the end of a line."""
    if '"' not in line:
        return inside
    at, opening = 0, sep + '"'
    if not inside and line.startswith('"'):
        inside, at = True, 1
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            doubled = line.startswith('"', quote + 1)
            inside, at = doubled, quote + 1 + doubled
        else:
            field = line.find(opening, at)
            if field < 0:
                return False
            inside, at = True, field + len(opening)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int] | None, list[str]]]:
    """Lines of a task with their split; a task may hold several."""
    for batch in batches:
        files, starts, lines = (batch.column(k).to_pylist() for k in range(3))
        first = 0
        for k in range(1, len(files) + 1):
            if k == len(files) or (files[k], starts[k]) != (files[first], starts[first]):
                yield (files[first], starts[first]), lines[first:k]
                first = k


def _transitions(sep: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], tuple[bool, bool]] = {}
        for split, lines in _by_split(batches):
            outside, inside = ends.get(split, (False, True))
            for line in lines:
                if '"' in line:
                    outside, inside = ends_inside(line, outside, sep), ends_inside(line, inside, sep)
            ends[split] = (outside, inside)
        rows = [(file, start, a, b) for (file, start), (a, b) in ends.items()]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "start", "outside", "inside"), map(list, zip(*rows, strict=True)), strict=True)))

    return step


def _records(sep: str, starts: dict[tuple[str, int], bool]):
    """Whole records of a task's splits (kind 1), and pieces: of a record begun before (0, or 2 where it does not end here), or not ended (3)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        inside, kind, held, number = False, 1, [], 0
        out: list[tuple] = []

        def put(new: int) -> None:
            nonlocal number
            out.append((*now, number, new, "\n".join(held)))
            number += 1
            held.clear()

        def end_split() -> None:
            if now is not None and held:
                put(2 if kind == 0 else 3)

        for split, lines in _by_split(batches):
            if split != now:
                end_split()
                now, number, inside = split, 0, starts[split]  # a split that the first pass did not see is an error
                kind = 0 if inside else 1
            for line in lines:
                held.append(line)
                inside = ends_inside(line, inside, sep)
                if not inside:
                    put(kind)
                    kind = 1
            if out:
                yield _batch(out)
                out = []
        end_split()
        if out:
            yield _batch(out)

    return step


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("file", "start", "number", "kind", "record"), map(list, zip(*rows, strict=True)), strict=True)))


def _starts(found: list) -> dict[tuple[str, int], bool]:
    """State at the start of each split: the composition of all splits before it in its file."""
    out, state, file = {}, False, None
    for row in sorted(found, key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            file, state = row["file"], False
        out[row["file"], row["start"]] = state
        state = row["inside"] if state else row["outside"]
    return out


def _joined(pieces: DataFrame) -> DataFrame:
    """Records across borders: an unfinished one and what follows it up to its end; at most two pieces for each split."""
    order = Window.partitionBy("file").orderBy("start", "number")
    opened = F.last(F.when(F.col("kind") == 3, F.struct("start", "number")), ignorenulls=True).over(order)
    rows = pieces.withColumn("_opened", opened).groupBy("file", "_opened").agg(F.sort_array(F.collect_list(F.struct("start", "number", "record"))).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda part: part["record"]), "\n")
    return rows.select("file", "_opened.start", "_opened.number", F.lit(1).alias("kind"), whole.alias("record"))


def logical_records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """Records of CSV files as text: file, start and number (place in the file), record."""
    line_end = _LINE_ENDS.get(encoding)
    setting = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(setting, None)
    # Both passes must cut the files alike, even when executors come or go between them.
    spark.conf.set(setting, before or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        reader = spark.read.option("lineSep", line_end) if line_end else spark.read
        value: Column = F.col("value")
        if line_end:
            value = F.decode(F.col("value").cast("binary"), encoding)
        lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("line"))
        found = lines.mapInArrow(_transitions(sep), "file string, start bigint, outside boolean, inside boolean").collect()  # one row per split
        shape = "file string, start bigint, number bigint, kind bigint, record string"
        folder = fresh_folder(spark, "csv-records")
        lines.mapInArrow(_records(sep, _starts(found)), shape).write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    rows = spark.read.schema(shape).parquet(folder)
    records = rows.filter("kind = 1").unionByName(_joined(rows.filter("kind <> 1")).select("file", "start", "number", F.col("kind").cast("bigint"), "record"))
    return records.select("file", "start", "number", F.regexp_replace("record", r"^﻿|\r$", "").alias("record"))


def read_quoted_csv(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """All rows of CSV files with a header each, as strings under the header names of the first file; empty lines are no rows."""
    records = logical_records(spark, path, sep, encoding).filter(F.col("record") != "")
    heads = records.groupBy("file").agg(F.min(F.struct("start", "number", "record")).alias("_head"))
    header = heads.agg(F.min(F.struct("file", "_head"))).first()[0]
    if header is None:
        raise ValueError(f"no header in {path}")
    options = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    width = spark.range(1).select(F.from_csv(F.lit(header["_head"]["record"]), ", ".join(f"c{k} string" for k in range(header["_head"]["record"].count(sep) + 1)), options).alias("r"))
    names = [name for name in width.first()["r"] if name is not None]
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    first = heads.select("file", F.col("_head.start").alias("start"), F.col("_head.number").alias("number"))  # one row per file
    body = records.join(first, ["file", "start", "number"], "left_anti")
    parsed = body.select(F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}").alias(name) for k, name in enumerate(names)])
