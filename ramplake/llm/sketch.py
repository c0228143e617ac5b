"""Document fingerprints: threshold-scaled sketches of byte shingles.

A sketch is the set of those hashes of a text's twelve-byte shingles that lie below a fixed fraction of the range. Which
hashes stay does not depend on the text, so a sketch grows with its text, the sketch of a union is the union of sketches,
and the share of one sketch that another holds estimates how much of the one text the other contains, be they of a
hundred words and of a million. Of a text whose sketch would be empty, the hash of the whole is kept, marked by its
highest bit: such texts are like equal ones only.

Sketches take one pass and no shuffle. Merged sketches are rows (key, hash), never arrays, so a source of any size merges
by a partial aggregation, and containment in it is a hash join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ramplake.llm.common import cut_lineage, slices

#: Bytes of a shingle, and the part of all hashes that is kept: one in SCALE.
SHINGLE, SCALE = 12, 16
WHOLE = 1 << 63
#: Bytes of text that a chunk of neighbouring documents holds, about.
CHUNK_BYTES = 1 << 25


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketches_of(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes (unsigned, big-endian) that each text retains. A text shorter than a shingle is one, with
    zero bytes behind it."""
    raws = [t.encode() for t in texts]
    data = b"".join(raw.ljust(SHINGLE, b"\0") for raw in raws)
    ends = np.cumsum([max(SHINGLE, len(raw)) for raw in raws])
    n = len(data) - SHINGLE + 1
    out = []
    if n > 0:
        head = np.ndarray((n,), "<u8", data, 0, (1,)).astype(np.uint64)
        tail = np.ndarray((n,), "<u4", data, 8, (1,)).astype(np.uint64)
        hashes = scrambled(scrambled(head) + tail)
        at = np.flatnonzero(hashes < np.uint64((1 << 64) // SCALE))
        owner = np.searchsorted(ends, at, "right")
        inside = at + SHINGLE <= ends[owner]
        hashes, owner = hashes[at[inside]], owner[inside]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new].astype(">u8"), owner[new]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return [h if len(h) else np.array([xxhash.xxh64_intdigest(raw) | WHOLE], ">u8") for h, raw in zip(out, raws)]


def likeness_of(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that the other holds: 0 to 1."""
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def sketch_documents(docs: DataFrame, *, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Columns doc_id and sketch (array of hashes, as signed numbers) for each row of `docs`. Null texts are empty ones;
    repeated rows get the same sketch; a null id stays null; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = sketches_of(texts)
                flat = np.concatenate(found).astype(np.uint64).view(np.int64)
                sketches = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat))
                yield pa.record_batch([part.column(0), sketches], ["doc_id", "sketch"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, sketch array<long>")


def likeness(a: str | Column, b: str | Column) -> Column:
    """likeness_of for columns."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def merged(sketches: DataFrame, key: str) -> DataFrame:
    """The sketch of all texts of a key together, a row (key, hash) for each hash; rows of the null key merge too."""
    return sketches.select(key, F.explode("sketch").alias("hash")).distinct()


def containment(sketches: DataFrame, union: DataFrame, key: str) -> DataFrame:
    """Columns doc_id, key and contained, the estimated share of the document that the merged texts of the key hold, where
    it is above zero. Rows of one id, and rows without id, count as one document."""
    hashes = sketches.select("doc_id", F.explode("sketch").alias("hash")).distinct()
    sizes = hashes.groupBy("doc_id").agg(F.count("*").alias("n"))
    met = hashes.join(union, "hash").groupBy("doc_id", key).agg(F.count("*").alias("c"))
    joined = met.alias("m").join(sizes.alias("s"), F.col("m.doc_id").eqNullSafe(F.col("s.doc_id")))
    return joined.select("m.doc_id", F.col(key), (F.col("c") / F.col("n")).alias("contained"))


def chunked(docs: DataFrame, text: str, doc: str) -> tuple[DataFrame, int]:
    """A table and its number of chunks. Columns chunk, guest, doc_id, h and text: documents in chunks of neighbours in ascending order of id, then text hash;
    each chunk also holds, as a guest after its own rows, the first document of the next chunk (of the first, after the last).

    The chunks' least keys are found from ids and hashes alone, by a range partitioning, and looked up in two steps, so
    texts are shuffled once. Rows equal in id and text share a chunk.
    """
    key = F.struct(F.col(doc).isNotNull().alias("known"), F.col(doc).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    keys = cut_lineage(docs.select(key.alias("key"), F.octet_length(text).alias("bytes")))
    n = max(1, int(keys.agg(F.coalesce(F.ceil(F.sum("bytes") / CHUNK_BYTES), F.lit(1)).alias("n")).first().n))
    least = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    bounds = cut_lineage(least.agg(F.sort_array(F.collect_set("key")).alias("bounds")))  # a key for each chunk
    width = F.ceil(F.sqrt(F.size("bounds"))).cast("int")
    steps = F.sequence(F.lit(0), F.floor((F.size("bounds") - 1) / width).cast("int"))
    cells = F.transform(steps, lambda i: F.slice("bounds", i * width + 1, width))
    marks = bounds.filter(F.size("bounds") > 0).select(F.struct(F.size("bounds").alias("n"), width.alias("width"), cells.alias("cells"), F.transform(cells, lambda c: c[0]).alias("firsts")).alias("m"))
    rows = docs.select(key.alias("key"), F.col(text).alias("text")).withColumn("m", marks.scalar())
    cell = F.size(F.filter("m.firsts", lambda f: f <= F.col("key"))) - 1
    rows = rows.withColumn("cell", cell)
    inner = F.filter(F.get("m.cells", F.col("cell")), lambda f: f <= F.col("key"))
    rows = rows.withColumn("chunk", F.col("cell") * F.col("m.width") + F.size(inner) - 1).withColumn("first", F.element_at(inner, -1) == F.col("key"))
    places = F.when(F.col("first"), F.array(F.struct("chunk", F.lit(False).alias("guest")), F.struct(F.pmod(F.col("chunk") - 1, F.col("m.n")).alias("chunk"), F.lit(True).alias("guest"))))
    rows = rows.select("key", "text", F.explode(F.coalesce(places, F.array(F.struct("chunk", F.lit(False).alias("guest"))))).alias("place"))
    return rows.select("place.chunk", "place.guest", F.col("key.id").alias("doc_id"), "key.h", "text"), n


def spliced(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def compare_with_next(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", edit=spliced) -> DataFrame:
    """Columns doc_id, n_chars, edited (edit(text, next text)), sketch, edited_sketch (binary: hashes of eight bytes, the
    highest first), near_edited and near_next (likeness of its sketch to that of its edited text, of the next document's),
    a row for each row of `docs`.

    Documents follow one another by ascending id, those without id first, of one id by text hash; the first follows the
    last, and a single one itself. Null texts are empty ones. Repeated rows follow one another. An empty table gives an
    empty one.
    """
    rows, n = chunked(docs, text, doc)
    # by range: a hash would put several chunks into one task
    rows = rows.repartitionByRange(n, "chunk").sortWithinPartitions("chunk", "guest", F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row = None  # (chunk, doc_id, text, sketch) of a document that waits for the next
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = sketches_of(texts)
                pairs = []
                for chunk, guest, doc_id, own, sketch in zip(*(part.column(k).to_pylist() for k in range(3)), texts, found):
                    if open_row is not None and open_row[0] == chunk:
                        pairs.append((open_row, own, sketch))
                    open_row = None if guest else (chunk, doc_id, own, sketch)
                edited = [edit(row[2], following) for row, following, _ in pairs]
                others = sketches_of(edited)
                yield pa.record_batch([
                    pa.array([row[1] for row, *_ in pairs], pa.int64()), pa.array([len(row[2]) for row, *_ in pairs], pa.int64()), pa.array(edited, pa.string()),
                    pa.array([row[3].tobytes() for row, *_ in pairs], pa.binary()), pa.array([x.tobytes() for x in others], pa.binary()),
                    pa.array([likeness_of(row[3], x) for (row, *_), x in zip(pairs, others)], pa.float64()),
                    pa.array([likeness_of(row[3], x) for row, _, x in pairs], pa.float64())],
                    ["doc_id", "n_chars", "edited", "sketch", "edited_sketch", "near_edited", "near_next"])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited string, sketch binary, edited_sketch binary, near_edited double, near_next double")
