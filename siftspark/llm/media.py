"""Operator 9: media payloads in content-defined chunks, stored once and put together again.

A payload is cut where a gear hash of the last 32 bytes has AVERAGE's bits clear (MIN to MAX bytes a chunk). Tasks write
the chunks that are new to them, compressed, into pack files. Chunk digests are then deduplicated by a Spark aggregate
and join: one copy of each digest wins, and packs are rewritten without the losers. A payload's stored form is its ordered list of
digests and lengths with the chunks it names. Reading follows the list, checks each chunk against its digest and puts
the payload together, near where its own pack is read.

Only digests and places are shuffled, never payloads. A digest that a third of all rows share is one row after the
map-side aggregate; AQE splits its side of the join.

Nulls and edges: a null text counts as empty and is a payload of 64 zero bytes; null doc_ids and repeated rows are kept;
payloads of any length are chunked whole; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, staged, texts_of, work_dir

MIN, AVERAGE, MAX = 2048, 8192, 65536
UNIT = 64
MAGIC = b"CDCMEDIA"
PRIME = 1 << 16
#: Bytes of decompressed chunks that a reader keeps.
KEPT = 8 << 20

_GEAR = np.random.default_rng(97).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2h + G[byte] mod 2^32 at every byte, by doubling windows."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h = np.concatenate((h[:k], h[k:] + (h[:-k] << np.uint32(k))))
    return h


def cuts(data: bytes, least: int = MIN, average: int = AVERAGE, most: int = MAX) -> list[int]:
    """Ends of the chunks of a payload."""
    n = len(data)
    if n <= least:
        return [n]
    marks = np.flatnonzero((gear(np.frombuffer(data, np.uint8)) >> np.uint32(8)) & np.uint32(average - 1) == 0) + 1
    out, at = [], 0
    while n - at > least:
        i = np.searchsorted(marks, at + least)
        end = min(int(marks[i]) if i < len(marks) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of UNIT, and its length without them."""
    raw = text.encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def _zstd(prime: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if prime else None
    c = {"dict_data": d} if d else {}
    return zstandard.ZstdCompressor(level=3, write_checksum=False, **c), zstandard.ZstdDecompressor(**c)


PLACE = "struct<digest:binary,size:int,off:long,len:int>"


def write_packs(docs: DataFrame, folder: str) -> DataFrame:
    """Per row: doc_id, n_bytes, pack, chunks (digest, size and, for those its own task stored, place in the pack; off -1 else)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        seen: set[bytes] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t.as_py() for t in texts_of(batch)]
            if out is None:
                pack = uuid.uuid4().hex
                fs, path = filesystem(folder)
                fs.create_dir(path, recursive=True)
                prime, i = b"", 0
                while len(prime) < PRIME and i < len(texts):
                    prime, i = prime + texts[i].encode()[:4096], i + 1
                out = fs.open_output_stream(f"{path}/{pack}")
                out.write(struct.pack("<I", len(prime)) + prime)
                at, (zip_, _) = 4 + len(prime), _zstd(prime)
            sizes, lists = [], []
            for text in texts:
                data, n = payload_of(text)
                sizes.append(n)
                lists.append(chunks := [])
                a = 0
                for b in cuts(data):
                    part = data[a:b]
                    d = hashlib.sha256(part).digest()
                    if d in seen:
                        chunks.append({"digest": d, "size": b - a, "off": -1, "len": 0})
                    else:
                        seen.add(d)
                        z = zip_.compress(part)
                        out.write(z)
                        chunks.append({"digest": d, "size": b - a, "off": at, "len": len(z)})
                        at += len(z)
                    a = b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([pack] * len(sizes)), pa.array(lists, kind)], ["doc_id", "n_bytes", "pack", "chunks"])
        if out is not None:
            out.close()

    kind = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("off", pa.int64()), ("len", pa.int32())]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_bytes long, pack string, chunks array<{PLACE}>")


def compact(winners: DataFrame, raw: str, store: str) -> DataFrame:
    """Rewrite each pack with its winning chunks alone; per digest its new place."""

    def run(key, t):
        pack = key[0].as_py()
        fs, path = filesystem(raw)
        to, there = filesystem(store)
        to.create_dir(there, recursive=True)
        t = t.sort_by("off")
        name = f"{pack}-{uuid.uuid4().hex}"
        places = []
        with fs.open_input_file(f"{path}/{pack}") as f, to.open_output_stream(f"{there}/{name}") as g:
            head = f.read(4)
            prime = f.read(struct.unpack("<I", head)[0])
            g.write(head + prime)
            at = 4 + len(prime)
            for off, size in zip(t["off"].to_pylist(), t["len"].to_pylist()):
                g.write(f.read_at(size, off))
                places.append(at)
                at += size
        return pa.table({"digest": t["digest"], "pack": pa.array([pack] * len(t)), "file": pa.array([name] * len(t)), "off": pa.array(places, pa.int64()), "len": t["len"]})

    return winners.groupBy("pack").applyInArrow(run, "digest binary, pack string, file string, off long, len int")


class Reader:
    """Chunks of a store, by file and place; a few open files and KEPT bytes of chunks are remembered."""

    def __init__(self, store: str):
        self.fs, self.path = filesystem(store)
        self.files: OrderedDict = OrderedDict()
        self.chunks: OrderedDict = OrderedDict()
        self.size = 0

    def _file(self, name: str):
        if name not in self.files:
            f = self.fs.open_input_file(f"{self.path}/{name}")
            prime = f.read(struct.unpack("<I", f.read(4))[0])
            self.files[name] = (f, _zstd(prime)[1])
            if len(self.files) > 16:
                self.files.popitem(last=False)[1][0].close()
        self.files.move_to_end(name)
        return self.files[name]

    def chunk(self, c: dict) -> bytes:
        d = c["digest"]
        if d in self.chunks:
            self.chunks.move_to_end(d)
            return self.chunks[d]
        f, unzip = self._file(c["file"])
        data = unzip.decompress(f.read_at(c["len"], c["off"]), max_output_size=c["size"])
        if hashlib.sha256(data).digest() != d:
            raise ValueError(f"a chunk of {c['file']} doesn't match its digest")
        self.chunks[d] = data
        self.size += len(data)
        while self.size > KEPT and len(self.chunks) > 1:
            self.size -= len(self.chunks.popitem(last=False)[1])
        return data


def feature(payload: np.ndarray, chunks: int) -> str:
    """Chunks, mean, deviation, share of zero crossings around the mean, and shares of eight ranges of samples."""
    x = payload.astype(np.float64)
    mean, hist = x.mean(), np.bincount(payload >> 5, minlength=8) / len(payload)
    cross = float((np.diff(x >= mean)).mean())
    return f"{chunks}|{mean:.4f}|{x.std():.4f}|{cross:.4f}|" + ",".join(f"{v:.4f}" for v in hist)


def read_media(rows: DataFrame, store: str) -> DataFrame:
    """doc_id, n_bytes and what the stored bytes give, for rows (doc_id, n_bytes, chunks in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(store)
        for batch in batches:
            got = []
            for doc, n, chunks in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("chunks")):
                chunks = chunks.as_py()
                data = b"".join(map(reader.chunk, chunks))
                form = hashlib.sha256(MAGIC + struct.pack("<I", len(chunks)) + b"".join(c["digest"] + struct.pack("<I", c["size"]) for c in chunks))
                form.update(data)
                size = len(MAGIC) + 4 + 36 * len(chunks) + len(data)
                got.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), size, form.hexdigest(), feature(np.frombuffer(data, np.uint8), len(chunks))))
            cols = list(zip(*got)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return rows.select("doc_id", "n_bytes", "chunks").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store every text of docs (doc_id, text) and read it back."""
    raw, store = work_dir(spark, "packs"), work_dir(spark, "store")
    rows = staged(spark, write_packs(docs, raw).withColumn("row", F.monotonically_increasing_id()), "lists")
    parts = rows.select("row", "pack", F.posexplode("chunks").alias("seq", "c")).select("row", "pack", "seq", "c.*")
    winners = parts.where("off >= 0").groupBy("digest").agg(F.min(F.struct("pack", "off", "len")).alias("w")).select("digest", "w.*")
    places = staged(spark, compact(winners, raw, store), "places")
    fs, path = filesystem(raw)
    if places.count():
        fs.delete_dir(path)  # what won is stored again
    found = parts.select("row", "seq", "digest", "size").join(places.select("digest", "file", "off", "len"), "digest")
    lists = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "size", "file", "off", "len"))).alias("chunks"))
    ready = rows.select("row", "doc_id", "n_bytes", "pack").join(lists, "row")
    tasks = max(2, spark.sparkContext.defaultParallelism * 4)
    return read_media(ready.repartition(tasks, F.xxhash64("pack"), F.floor(F.col("row") % (1 << 33) / 2000)).sortWithinPartitions("pack", "row"), store)
