"""Work on whole files: Spark lists them and deals them out by size, tasks read them as streams.

The listing reads no content. A task opens each of its files and holds one block of it, so a header costs a few kilobytes
and a digest one pass, whatever the file's size.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

BLOCK = 1 << 20


def listed(spark: SparkSession, paths: str | list[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Columns path and length of the files; Spark lists no empty ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return files.load(paths).select("path", "length")


def stream(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"), compression=None)
    files, place = pafs.FileSystem.from_uri(path)
    return files.open_input_stream(place, compression=None)


def per_file(files: DataFrame, name: str, read: Callable[[pa.NativeFile], str]) -> DataFrame:
    """Adds what `read` makes of each file's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with stream(path) as source:
                    found.append(read(source))
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], ["path", "length", name])

    return files.mapInArrow(run, f"path string, length long, {name} string")


def headers(files: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """Column header: the first line of each file, null of an empty line."""

    def read(source: pa.NativeFile) -> str | None:
        decoder, line = codecs.getincrementaldecoder(encoding)(errors="replace"), ""
        while "\n" not in line:
            block = source.read(1 << 12)
            if not block:
                break
            line += decoder.decode(block)
        return line.split("\n", 1)[0].rstrip("\r") or None

    return per_file(files, "header", read)


def digests(files: DataFrame) -> DataFrame:
    """Column sha256 of each file's bytes."""

    def read(source: pa.NativeFile) -> str:
        digest = hashlib.sha256()
        while block := source.read(BLOCK):
            digest.update(block)
        return digest.hexdigest()

    return per_file(files, "sha256", read)
