"""Shared helpers: the shared work folder, staged tables, range buckets and vectorised word hashing."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import staged, unstage, work_dir  # noqa: F401

#: Characters that end a word wherever this package counts or shingles words.
WORD_SPACE = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it for a folder that the cluster shares."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write under another name and move: a task that is killed or run twice leaves no half file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def read_whole(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def parts_for(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions so that none has many more than `most` rows, and small tables still use the cores."""
    cores = max(2, spark.sparkContext.defaultParallelism)
    return max(1, math.ceil(rows / most), min(cores, math.ceil(rows / 256)))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts-1 ascending key values of df that cut it into ranges of nearly equal row counts.

    It scans the key column only. Equal keys never straddle a bound."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, at, max(10000, 10 * parts)).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are at most key (null: 0), by a search of two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.lit([r[0] for r in rows])
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    coarse = below(heads)
    table = F.lit([[*r] for r in rows])
    fine = F.when(coarse > 0, (coarse - 1) * step + below(F.element_at(table, F.greatest(coarse, F.lit(1)))))
    return F.coalesce(F.when(key.isNotNull(), F.coalesce(fine, F.lit(0))), F.lit(0)).cast("int")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*cols) if cols else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df doesn't have, in any case: underscores are put before the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column of a batch with null as the empty text."""
    return pc.fill_null(batch.column(name), "")


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings, and len+1 offsets into them."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(1, n), np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POW or len(_POW[base]) < n:
        _POW[base] = _powers(base, max(n, 1 << 16))
    return _POW[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(body: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than ASCII white space) of one text."""
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64)
    space = _SPACE[body]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(_R, n), out=total[1:])
    return mix((total[last] - total[first]) * powers(_RINV, n)[first] + (last - first).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A 64-bit hash of each run of k words; of all words together where there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(_R) + words[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)
