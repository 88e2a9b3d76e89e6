"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder

#: Words are runs of anything but the six ASCII white-space characters.
WHITE = "[ \\x09-\\x0D]+"


def words(text: Column | str) -> Column:
    """Words of a text in order; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def word_key(text: Column | str) -> Column:
    """128-bit key of a text's word sequence; null where the text has no word."""
    joined = F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WHITE, " "))
    return F.when(joined != "", F.unhex(F.md5(joined)))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    folder = fresh_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_folder(uri: str):
    """File system and path of a shared folder, for tasks that write files of their own format."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


@contextmanager
def whole_file(system, path: str) -> Iterator:
    """Output stream that appears under its name only when complete, so a repeated or lost task leaves no half file."""
    hidden = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(hidden) as out:
        yield out
    system.move(hidden, path)
