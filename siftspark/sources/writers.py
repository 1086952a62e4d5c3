"""Records to files. Folders are committed by Spark; single files are merged on the driver, stream-wise, and moved into place."""

from __future__ import annotations

import csv
import gzip
import json
import os
import re

from pyspark.sql import DataFrame

from ..config import ConfigError
from ..operators import select
from ..operators.stats import SYSTEM
from .readers import format_of


def tagged(path: str, tag: str) -> str:
    """out.jsonl.gz -> out.TAG.jsonl.gz"""
    m = re.fullmatch(r"(.*?)((?:\.[A-Za-z0-9]+)(?:\.gz)?)?", os.path.basename(path))
    return os.path.join(os.path.dirname(path), f"{m[1]}.{tag}{m[2] or ''}")


def _plain(row) -> dict:
    return row.asDict(recursive=True)


def text_line(record: dict, fallback: str | None = None) -> str:
    """The text, else the fallback field, else the record as JSON; on one line."""
    got = record.get("text") or (record.get(fallback) if fallback else None)
    return str(got if got else json.dumps(record, ensure_ascii=False, default=str)).replace("\n", " ")


def write_file(df: DataFrame, path: str, order: str, output_format: str | None = None, append: bool = False, fallback: str | None = None) -> int:
    """One file in the order of `order`, for results that a single file is meant to hold. Returns the rows written."""
    kind = format_of(path, output_format)
    if kind == "parquet":
        write_folder(df, path)
        return df.count()
    if kind in ("xlsx", "xls"):
        try:
            df.orderBy(order).drop(*[c for c in df.columns if c in SYSTEM]).toPandas().to_excel(path, index=False)
        except ImportError as e:
            raise ConfigError(f"Excel files need a library that isn't here: {e}") from e
        return df.count()
    if append and kind not in ("jsonl", "txt", "csv"):
        raise ConfigError(f"{kind} files can't be appended to")
    names = [c for c in df.columns if c not in SYSTEM]
    opener = gzip.open if path.endswith(".gz") else open
    to = path if append else path + ".tmp"
    header = None
    if append and kind == "csv" and os.path.exists(path):
        with opener(path, "rt", newline="", encoding="utf-8") as f:
            header = next(csv.reader(f), None)
    n = 0
    try:
        with opener(to, "at" if append else "wt", newline="", encoding="utf-8") as f:
            w = csv.DictWriter(f, header or names, extrasaction="ignore") if kind == "csv" else None
            if w and not header:
                w.writeheader()
            if kind == "json":
                f.write("[")
            for row in df.orderBy(order).select(*names).toLocalIterator(prefetchPartitions=True):
                r = _plain(row)
                if w:
                    w.writerow({k: v if isinstance(v, str | int | float | None) else json.dumps(v, ensure_ascii=False, default=str) for k, v in r.items()})
                elif kind == "txt":
                    f.write(text_line(r, fallback) + "\n")
                elif kind == "json":
                    f.write((",\n" if n else "\n") + json.dumps(r, ensure_ascii=False, default=str))
                else:
                    f.write(json.dumps(r, ensure_ascii=False, default=str) + "\n")
                n += 1
            if kind == "json":
                f.write("\n]")
        if not append:
            os.replace(to, path)
    except BaseException:
        if not append and os.path.exists(to):
            os.remove(to)
        raise
    return n


def write_folder(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """A folder of part files, which is the sink for large results."""
    d = df.drop(*[c for c in df.columns if c in SYSTEM])
    w = d.write.mode(mode)
    {"parquet": w.parquet, "jsonl": lambda p: w.option("ignoreNullFields", "false").json(p), "csv": lambda p: w.option("header", True).csv(p)}[kind](path)


def write_shards(df: DataFrame, path: str, order: str, size: int) -> DataFrame:
    """Folders _shard=N of exactly `size` rows in order."""
    d = select.shards(df, order, size)
    d.repartition("_shard").sortWithinPartitions(order).drop(*SYSTEM).write.mode("overwrite").partitionBy("_shard").option("ignoreNullFields", "false").json(path)
    return d


def write_splits(df: DataFrame, path: str, order: str, spec: str, seed: int = 0) -> DataFrame:
    d = select.split(df, order, spec, seed)
    d.drop(*SYSTEM).write.mode("overwrite").partitionBy("_split").option("ignoreNullFields", "false").json(path)
    return d


def write_summary(stats: dict, path: str) -> None:
    from .. import __version__

    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(stats | {"version": __version__}, f, ensure_ascii=False, indent=2)
    os.replace(path + ".tmp", path)


def write_names(table: DataFrame, path: str) -> int:
    """The table of pseudonyms as one JSON object value -> pseudonym, written as it streams in. Returns its size."""
    n = 0
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write("{")
        for r in table.orderBy("kind", "n").select("value", "pseudonym").toLocalIterator(prefetchPartitions=True):
            f.write((",\n" if n else "\n") + json.dumps(r["value"], ensure_ascii=False) + ": " + json.dumps(r["pseudonym"]))
            n += 1
        f.write("\n}")
    os.replace(path + ".tmp", path)
    return n


def null_sink(df: DataFrame) -> None:
    """Runs the plan and writes nothing."""
    df.write.format("noop").mode("overwrite").save()


