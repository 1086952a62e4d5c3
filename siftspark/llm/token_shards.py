"""Operator 1: token ids in binary shards whose document boundaries are Elias-Fano coded.

A shard file holds the ids of consecutive documents (ascending doc_id) as one array of 16- or 32-bit little-endian
integers and the n+1 boundaries as an Elias-Fano sequence: the low bits packed, the high bits in unary with a sample
of every SAMPLE-th select position. Any boundary is found by select, without a table of 64-bit offsets, in about
2 + log2(ids per document) bits each. The ascending doc_ids are a second such sequence.

Rows are ranged by Spark over (doc_id, hash of the text, row), so that no doc_id, however frequent, makes a range large; a
task writes its range file by file, each of at most SHARD_DOCS documents and about SHARD_BYTES of ids, and holds one file.

Nulls and edges: a null text counts as empty, an empty text is its end id alone; a null doc_id sorts first; rows with
equal doc_id follow each other by the text's hash; an empty table gives no shard and no row; other columns are ignored."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_whole, staged, texts_of, work_dir, write_whole
from .fast_tokens import encoder, tokenizer_path

MAGIC = b"EFTK2\0\0\0"
HEAD = struct.Struct("<8sIIQQ")
PART = struct.Struct("<QIQQQ")
SAMPLE = 256
#: Documents and bytes of ids that one shard holds at most (a single document may have more bytes).
SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20
#: Bytes of text that one task should write.
TASK_BYTES = 128 << 20


class EliasFano:
    """A non-decreasing sequence of integers in 0..universe."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = v & np.uint64((1 << bits) - 1)
        spread = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones.astype(np.int64)] = 1
        return cls(n, bits, np.packbits(spread.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _low_of(self, i: int) -> int:
        at = i * self.low_bits
        word = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return (word >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, over at most SAMPLE further ones of the high bits."""
        start = int(self.samples[i // SAMPLE])
        rest, byte = i % SAMPLE, start >> 3
        seen = -bin(int(self.high[byte]) & ((1 << (start & 7)) - 1)).count("1")
        while seen + (c := bin(int(self.high[byte])).count("1")) <= rest:
            seen, byte = seen + c, byte + 1
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        return ((byte * 8 + int(ones[rest - seen]) - i) << self.low_bits) | self._low_of(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        spread = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (spread.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


    def packed(self) -> bytes:
        return PART.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def unpacked(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts at a byte, and the byte after it."""
        n, bits, n_low, n_high, n_samples = PART.unpack_from(data, at)
        at += PART.size
        low, high = np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, np.uint8, n_high, at + n_low)
        at += n_low + n_high
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", n_samples, at)), at + 4 * n_samples


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """doc_ids ascend, nulls first."""
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    names = EliasFano.encode(np.array([d - first for d in known], np.uint64), known[-1] - first if known else 0)
    head = HEAD.pack(MAGIC, width, 0, len(doc_ids) - len(known), int(bounds[-1])) + struct.pack("<q", first)
    return b"".join((head, names.packed(), EliasFano.encode(bounds, int(bounds[-1])).packed(), ids))


def open_shard(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """doc_ids, boundaries and ids of a shard file."""
    magic, width, _, nulls, total = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    (first,) = struct.unpack_from("<q", data, HEAD.size)
    names, at = EliasFano.unpacked(data, HEAD.size + 8)
    bounds, at = EliasFano.unpacked(data, at)
    return [None] * nulls + [first + names.select(i) for i in range(names.n)], bounds, np.frombuffer(data, f"<u{width}", total, at)


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenise docs (doc_id, text) into shard files in `folder`; returns the manifest (shard, file, docs, ids).

    One range shuffle; each shard is written whole and moved into place. Shards ascend with their documents."""
    total = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    tasks = max(1, math.ceil(total["bytes"] / TASK_BYTES), min(4 * spark.sparkContext.defaultParallelism, math.ceil(total["rows"] / 256)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        size = enc.kind.itemsize
        task, k = TaskContext.get().partitionId(), 0
        names, lengths, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            shard = (task << 32) + k
            file = f"{folder}/shard-{task:06d}-{k:06d}.eft"
            write_whole(file, pack_shard(names, np.array(lengths, np.int64), b"".join(ids), size))
            return pa.RecordBatch.from_pylist([{"shard": shard, "file": file, "docs": len(names), "ids": sum(lengths)}], schema)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                names.append(doc)
                ids.append(enc.packed(text.as_py()) + end)
                lengths.append(len(ids[-1]) // size)
                held += len(ids[-1])
                if len(names) >= shard_docs or held >= shard_bytes:
                    yield close()
                    names, lengths, ids, held, k = [], [], [], 0, k + 1
        if names:
            yield close()

    schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("row", F.monotonically_increasing_id())
    ranged = d.repartitionByRange(tasks, F.asc_nulls_first("doc_id"), "h", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text")
    return staged(spark, ranged.select("doc_id", "text").mapInArrow(write, "shard long, file string, docs long, ids long"), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the shard files: doc_id, start, n_tokens, ids_crc32. The manifest has one row a shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                names, ef, ids = open_shard(read_whole(file))
                at = np.array([ef.select(i) for i in range(ef.n)], np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # ids before each shard: those of earlier tasks' shards (one line a task), and of earlier ones of its own task
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    m = manifest.withColumn("task", F.shiftright("shard", 32))
    tasks = m.groupBy("task").agg(F.sum("ids").alias("all")).withColumn("earlier", F.coalesce(F.sum("all").over(before.orderBy("task")), F.lit(0)))
    own = F.coalesce(F.sum("ids").over(before.partitionBy("task").orderBy("shard")), F.lit(0))
    files = m.withColumn("own", own).join(tasks.select("task", "earlier"), "task").select("file", (F.col("own") + F.col("earlier")).alias("base"))
    return files.repartition(4 * spark.sparkContext.defaultParallelism, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write and read back: the whole operator."""
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    return read_shards(spark, write_shards(spark, docs.select("doc_id", "text"), work_dir(spark, "shards"), tokenizer))
