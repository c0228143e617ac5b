"""SimHash near-duplicates by the one-bit neighbours of whole fingerprints.

A fingerprint holds the majority, bit by bit, of the hashes of a text's shingles. Fingerprints are equal texts' keys
first: only distinct ones are searched. Each is filed under every point of the radius-1 balls of its four 16-bit
segments, the other segments kept as they are (65 points). Two fingerprints within two bits meet at a point: differing in
one segment or in two, the fingerprint between them lies in a ball of each. Fetching the matches of a point is a sort of
the table by point, and the complete distance of each fetched match is verified.

A point has at most 65 fingerprints within one bit, so no bucket can be large, whatever the data, and there is nothing
to cap. Matches of a point are linked in a chain, not in pairs; links between neighbours are enough for components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ramplake.llm.common import connected, cut_lineage, slices, unpacked, whole_row

SHINGLE, SEED, BITS, SEGMENT = 3, 42, 64, 16
#: Most differing bits of a link. The balls have radius 1, so two is what they find.
DISTANCE = 2
CHUNK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text: 0 without words; a text of fewer words than a shingle is one shingle."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    runs = [words[k:] for k in range(shingle)]
    grams = list(map(b" ".join, zip(*runs))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Columns doc_id, h (a hash of the whole text) and fp (64 bits as a long) for every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found)], ["doc_id", "h", "fp"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias(text)).mapInArrow(run, "doc_id long, h long, fp long")


def near_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp, enough to connect all within `distance` bits: two at most."""
    if distance > DISTANCE:
        raise ValueError(f"balls of radius 1 find links of {DISTANCE} bits at most, not {distance}")
    segments = [F.array(*(F.col("fp").bitwiseXOR(F.lit(1 << bit if bit < 63 else -(1 << 63))) for bit in range(low, low + SEGMENT))) for low in range(0, BITS, SEGMENT)]
    filed = distinct.select("fp", F.explode(F.concat(F.array("fp"), *segments)).alias("point"))
    matched = filed.select("fp", F.lag("fp").over(W.partitionBy("point").orderBy("fp")).alias("other")).filter("other IS NOT NULL")
    return matched.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance).select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Columns doc_id, h, fp, root (a name of the component) and component_id, a row for each row of `docs`.

    component_id is the smallest id that links reach from the row, its own included; null ids count only where a
    component has no other. Texts without words have fingerprint 0 and link like others. Repeated rows and ties share
    one fingerprint; an empty table gives an empty one; columns but the two named aren't read.
    """
    prints = cut_lineage(fingerprints(docs, text=text, doc=doc, shingle=shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected(near_links(distinct)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "h", "fp", "root", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def keep_first(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row of `docs` of each component, with its columns as they are: that of the smallest id, of equal ids that of the
    smallest text hash. A row without id stays only where its component has no other; of repeated rows one stays."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    first = near_duplicates(docs, text=text, doc=doc, shingle=shingle).groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.h")
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc).cast("long").alias("own"), F.xxhash64(text).alias("hash"))
    left = rows.join(first, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("h")), "left_semi").dropDuplicates(["own", "hash"])
    return unpacked(left, "row", docs.columns)
