"""Operator 4: vector bin packing of token pieces into training sequences.

A document's ids are cut into pieces of at most `tokens`; pieces are then placed under three limits at once: tokens,
segments and loss-bearing tokens a sequence. In instruction data, where `prompt_end` names the mark between prompt and
answer, the ids up to the mark bear no loss; elsewhere all ids but a piece's first do, and a loss limit below `tokens`
says how full of loss a sequence may be. One bin is open at a time; the piece that fits and has the greatest dot
product of its demand and the bin's remaining capacity (both as shares of the limits, weighted by the group's mean
demand) goes in, until nothing fits. Pieces of equal demand are one type with a count, so a choice costs the number of
types. Placement looks at lengths only; groups hold at most about GROUP pieces that are dealt by a hash of the row, so no
source or key makes a group large.

Nulls and edges: a null text counts as empty; a document of no ids is one piece of its end id; a null doc_id is kept;
repeated rows are each packed; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, texts_of
from .fast_tokens import encoder, tokenizer_path

TOKENS = 4096
SEGMENTS = 128
GROUP = 50_000


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and its order within the bin, for demand (items x dimensions) and limits per dimension.

    Raises ValueError where an item exceeds a limit by itself."""
    n = len(demand)
    bins, order = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, order
    if (demand > limits).any():
        raise ValueError("an item exceeds a limit by itself")
    kinds, of = np.unique(demand, axis=0, return_inverse=True)
    of = of.ravel()
    queue = np.argsort(of, kind="stable")
    left = np.bincount(of, minlength=len(kinds))
    at = np.concatenate(([0], np.cumsum(left)[:-1]))
    share = kinds / limits
    weight = (demand / limits).mean(axis=0)
    alive = np.arange(len(kinds))
    used, b, k, gone = np.zeros(len(limits), np.int64), 0, 0, 0
    done = 0
    while done < n:
        room = limits - used
        fit = (left[alive] > 0) & (kinds[alive] <= room).all(axis=1)
        if not fit.any():
            used, b, k = np.zeros(len(limits), np.int64), b + 1, 0
            continue
        ok = alive[fit]
        t = ok[np.argmax(share[ok] @ (weight * (room / limits)))]
        i = queue[at[t]]
        bins[i], order[i] = b, k
        used, k, done = used + kinds[t], k + 1, done + 1
        at[t], left[t] = at[t] + 1, left[t] - 1
        if not left[t]:
            gone += 1
            if gone > len(alive) // 4:
                alive, gone = alive[left[alive] > 0], 0
    return bins, order


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, tokens: int = TOKENS, loss: int | None = None, prompt_end: str | None = None) -> DataFrame:
    """Per piece of every document: doc_id, start, length, ids_crc32, doc_tokens, loss (ids that a model is to predict: all
    but the piece's first and those of the prompt), and task, row_no, which tell repeated rows apart.

    A piece has at most `tokens` ids and `loss` (default: as many) loss-bearing ones. prompt_end is a pattern; what a text
    has up to the end of its first match is its prompt, which is tokenised by itself."""
    most = tokens if loss is None else loss
    if tokens < 1 or most < 1:
        raise ValueError("limits are positive")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        mark = re.compile(prompt_end) if prompt_end else None
        row = 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss", "task", "row_no")}
            for doc, task, text in zip(batch.column("doc_id").to_pylist(), batch.column("task").to_pylist(), texts_of(batch)):
                text, prompt = text.as_py(), b""
                if mark and (m := mark.search(text)):
                    prompt, text = enc.packed(text[: m.end()]), text[m.end() :]
                silent = len(prompt) // enc.kind.itemsize
                ids = np.frombuffer(prompt + enc.packed(text) + end, enc.kind).astype("<u4")
                s = 0
                while s < len(ids):
                    e = min(len(ids), s + tokens, most + max(s + 1, silent))
                    piece = ids[s:e]
                    for k, v in zip(out, (doc, s, e - s, zlib.crc32(piece), len(ids), max(0, e - max(s + 1, silent)), task, row)):
                        out[k].append(v)
                    s, row = e, row + 1
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, task long, row_no long"
    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().cast("long").alias("task")).mapInArrow(cut, kind)


def pack(spark: SparkSession, rows: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with length, loss, task and row_no, which tells rows of a task apart.

    rows are read twice (count and placement): give a table, not a long plan."""
    loss = tokens if loss is None else loss
    groups = max(1, math.ceil(rows.count() / GROUP))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        size, lost = t["length"].to_numpy(), t["loss"].to_numpy()
        bins, order = place(np.stack([size, np.ones_like(size), lost], axis=1), np.array([tokens, segments, loss]))
        by = np.lexsort((order, bins))
        ends = np.cumsum(size[by])
        starts = ends - size[by]
        first = np.concatenate(([True], np.diff(bins[by]) > 0))
        offset = np.zeros(len(size), np.int64)
        offset[by] = starts - np.repeat(starts[first], np.diff(np.append(np.flatnonzero(first), len(size))))
        group = t["group"][0].as_py()
        for i, (k, v) in enumerate((("sequence_id", bins + (group << 32)), ("offset", offset))):
            t = t.append_column(k, pa.array(v, pa.int64()))
        yield from t.drop_columns("group").to_batches()

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("task", "row_no"), F.lit(groups)).cast("long"))
    kind = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id long, offset long"
    return dealt.repartitionById(groups, F.col("group").cast("int")).sortWithinPartitions("task", "row_no").select(*names, "group").mapInArrow(run, kind)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, prompt_end: str | None = None) -> DataFrame:
    """Tokenise, cut and place all docs (doc_id, text); one row a piece. Texts are never shuffled."""
    cut = staged(spark, pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, tokens, loss, prompt_end), "pieces")
    return pack(spark, cut, tokens, segments, loss).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss")


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence its ordered pieces, length and loss-bearing tokens; a sequence holds at most the segment limit."""
    piece = F.struct("offset", "doc_id", "start", "length")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("length").alias("n_tokens"), F.sum("loss").alias("n_loss"))
