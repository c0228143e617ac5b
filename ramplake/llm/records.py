"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames: the payload's length (8 bytes), the masked CRC-32C of those 8 bytes, the payload, the
masked CRC-32C of the payload, all little-endian; readers of such record files can read it. A payload is one document:
its id (8 bytes), 1 or 0 as it has an id or not (2), the bytes of a token id (2), the number of token ids (4), the ids, of
two bytes where all of the document's fit and of four elsewhere. An index file holds for each record its offset and the
number of ids before it in the file, so a reader can fetch records in any order.
Files are in ascending order of document id; a manifest table names them. It is written last and lists one file for each
partition, so what a lost or repeated task has left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ramplake.llm.bpe import Encoder, Vocabulary
from ramplake.llm.common import slices

POLYNOMIAL = 0x82F63B78
BLOCK = 64
#: Bytes of a frame beside its payload.
FRAME = 16
#: Chunks that a writing task remembers.
MEMO = 500_000
#: Records that one reading step fetches, and bytes of records that one reading task does, about.
STRIDE = 512
TASK_BYTES = 1 << 25


@lru_cache(maxsize=None)
def byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1))
    return table


def shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A zero-run operator, given by what it does to each byte of a checksum, applied to checksums."""
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@lru_cache(maxsize=None)
def zero_run(power: int) -> np.ndarray:
    """What 2^power zero bytes do to a checksum."""
    parts = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    if power == 0:
        return byte_table()[parts & 255] ^ parts >> np.uint32(8)
    half = zero_run(power - 1)
    return shifted(half, shifted(half, parts))


@lru_cache(maxsize=None)
def block_table() -> np.ndarray:
    """For each place of a block and each byte: its part of the block's checksum."""
    rows = [byte_table()]
    for _ in range(BLOCK - 1):
        rows.append(shifted(zero_run(0), rows[-1]))
    return np.stack(rows[::-1])


def after_zeros(crcs: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What the given numbers of zero bytes do to checksums."""
    out = crcs.copy()
    for power in range(int(zeros.max(initial=0)).bit_length()):
        some = np.flatnonzero(zeros >> power & 1)
        out[some] = shifted(zero_run(power), out[some])
    return out


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part. Checksums are linear: all blocks of all parts are taken at once, each is moved by the blocks
    that follow it, and a part is the sum of its blocks."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = np.maximum(1, -(-sizes // BLOCK))
    # zero bytes in front change nothing
    padded = b"".join([bytes(int(b) * BLOCK - len(p)) + p for p, b in zip(parts, blocks)])
    data = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK)
    table, sums = block_table(), np.zeros(len(data), np.uint32)
    for place in range(BLOCK):
        sums ^= table[place][data[:, place]]
    first = np.cumsum(blocks) - blocks
    behind = np.repeat(first + blocks - 1, blocks) - np.arange(len(data))
    sums = np.bitwise_xor.reduceat(after_zeros(sums, behind * BLOCK), first) if len(parts) else np.empty(0, np.uint32)
    return sums ^ after_zeros(np.full(len(parts), 0xFFFFFFFF, np.uint32), sizes) ^ np.uint32(0xFFFFFFFF)


def masked(parts: list[bytes]) -> np.ndarray:
    crc = crc32c(parts)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = masked(heads + payloads).tolist()
    n = len(payloads)
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b))) for h, a, p, b in zip(heads, sums[:n], payloads, sums[n:])]


def unframe(data: bytes, offsets: list[int]) -> list[bytes]:
    """Payloads of the frames at the given offsets; all checksums are verified."""
    heads = [data[at : at + 8] for at in offsets]
    payloads = [data[at + 12 : at + 12 + struct.unpack("<Q", h)[0]] for at, h in zip(offsets, heads)]
    said = [struct.unpack_from("<I", data, at + 8)[0] for at in offsets] + [struct.unpack_from("<I", data, at + 12 + len(p))[0] for at, p in zip(offsets, payloads)]
    wrong = np.flatnonzero(masked(heads + payloads) != np.array(said, np.uint32))
    if len(wrong):
        raise ValueError(f"record at {offsets[int(wrong[0]) % len(offsets)]}: a checksum is wrong")
    return payloads


MANIFEST = "part int, path string, n_records long, n_ids long, n_bytes long"


def write_records(docs: DataFrame, folder: str, encode, *, end_id: int | None = None, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Encodes every whole text and writes it in ascending order of id; returns the manifest table as read again.

    encode: makes, in a task, a function from a list of texts to a list of id arrays. Null texts are empty ones; null
    ids come first; repeated rows are records of their own. An empty table gives a manifest without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, part = encode(), TaskContext.get().partitionId()
        files, place = pafs.FileSystem.from_uri(folder)
        path = f"{place}/part-{part:06d}-{uuid.uuid4().hex}"
        data = index = None
        at = ids = records = 0
        for batch in batches:
            for piece, texts in slices(batch, text):
                if data is None:
                    files.create_dir(place, recursive=True)
                    data, index = files.open_output_stream(path + ".rec"), files.open_output_stream(path + ".idx")
                payloads, entries = [], []
                for doc_id, tokens in zip(piece.column(0).to_pylist(), tokenize(texts)):
                    tokens = np.append(tokens, end_id) if end_id is not None else tokens
                    kind = "<u2" if len(tokens) and tokens.max() < 1 << 16 else "<u4"
                    payloads.append(struct.pack("<qHHI", doc_id or 0, doc_id is not None, int(kind[2]), len(tokens)) + tokens.astype(kind).tobytes())
                    entries.append((at, ids))
                    at, ids, records = at + FRAME + len(payloads[-1]), ids + len(tokens), records + 1
                data.write(b"".join(frames(payloads)))
                index.write(np.array(entries, "<u8").tobytes())
        if data is not None:
            data.close()
            index.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), *(pa.array([v], pa.int64()) for v in (records, ids, at))], ["part", "path", "n_records", "n_ids", "n_bytes"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias(text))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(text)]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record by way of the index: columns doc_id, start (ids of all records before it), ids (binary: unsigned
    32-bit little-endian integers). The number of tasks follows the bytes in the manifest."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    tasks = 1 + (manifest.agg(F.sum("n_bytes").alias("n")).first().n or 0) // TASK_BYTES
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1, F.lit(STRIDE).cast("long")))
    steps = manifest.select("path", "n_records", "n_bytes", before.alias("before")).select("*", first.alias("first")).repartition(tasks, "path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for step in batch.to_pylist():
                n = min(STRIDE, step["n_records"] - step["first"])
                with files.open_input_file(step["path"] + ".idx") as f:
                    index = np.frombuffer(f.read_at(16 * (n + 1), 16 * step["first"]), "<u8").reshape(-1, 2).astype(np.int64)
                end = int(index[n, 0]) if len(index) > n else step["n_bytes"]
                begin = int(index[0, 0])
                with files.open_input_file(step["path"] + ".rec") as f:
                    data = f.read_at(end - begin, begin)
                docs, parts = [], []
                for payload in unframe(data, (index[:n, 0] - begin).tolist()):
                    doc_id, known, width, length = struct.unpack_from("<qHHI", payload)
                    docs.append(doc_id if known else None)
                    parts.append(np.frombuffer(payload, f"<u{width}", length, 16).astype("<u4").tobytes())
                starts = pa.array(index[:n, 1] + step["before"], pa.int64())
                yield pa.record_batch([pa.array(docs, pa.int64()), starts, pa.array(parts, pa.binary())], ["doc_id", "start", "ids"])

    return steps.mapInArrow(run, "doc_id long, start long, ids binary")


def bpe_encoder(path: str):
    """For write_records: ids as the tokenizers library gives them, by the exact merges of `bpe`."""
    vocabulary = Vocabulary(path)
    return lambda: Encoder(vocabulary, room=MEMO).encode
