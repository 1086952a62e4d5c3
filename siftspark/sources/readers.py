"""Records from files. `_ord` gives the input order: it grows with file and line, and is unique."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ConfigError
from ..functions.text import strip
from ..operators.decontam import REGISTRY

FORMATS = ("jsonl", "json", "csv", "tsv", "txt", "parquet", "xlsx", "xls")


def format_of(path: str, override: str | None = None) -> str:
    """The override, or the extension without .gz."""
    got = override or re.sub(r"\.gz$", "", path.rstrip("/").lower()).rpartition(".")[2]
    if got not in FORMATS:
        raise ConfigError(f"unknown input format {got!r}; there are {', '.join(FORMATS)}")
    return got


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files have fewer splits than these, as files of one row group do; no change elsewhere."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_order(df: DataFrame) -> DataFrame:
    return df.withColumn("_ord", F.monotonically_increasing_id())


def read_records(spark: SparkSession, path: str, input_format: str | None = None, **o) -> DataFrame:
    """Options: schema, paragraphs (txt), delimiter, header, columns (csv, tsv), sheet (Excel), json_path."""
    kind = format_of(path, input_format)
    if path == "-":
        raise ConfigError("standard input is spooled by the command line first")
    schema = o.get("schema")
    if kind == "parquet":
        return with_order(spark.read.parquet(path))
    if kind == "jsonl":
        return with_order(_json_lines(spark, path, schema))
    if kind == "json":
        d = (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)
        steps = [p for p in (o.get("json_path") or "item").split(".") if p != "item"]
        if steps:
            c = F.col(".".join(steps))
            d = d.select(F.explode(c).alias("r")).select("r.*")
        return with_order(d)
    if kind in ("csv", "tsv"):
        return with_order(_delimited(spark, path, o.get("delimiter") or ("\t" if kind == "tsv" else ","), o.get("header", True), o.get("columns")))
    if kind == "txt":
        return _paragraphs(spark, path) if o.get("paragraphs") else _lines(spark, path)
    return _excel(spark, path, o.get("sheet", 0))


def _json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None) -> DataFrame:
    """A row a line. Blank lines and what isn't JSON are skipped; JSON that is no object is a row with _malformed."""
    if schema is None:
        schema = spark.read.option("mode", "DROPMALFORMED").json(path).schema
    d = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    d = d.select((~strip(F.col("value")).startswith("{")).alias("_malformed"), "value")
    record = F.from_json(F.when(~F.col("_malformed"), F.col("value")), schema)
    return d.select(record.alias("__r"), "_malformed").select("__r.*", "_malformed")


def _delimited(spark: SparkSession, path: str, sep: str, header: bool, columns: list[str] | None) -> DataFrame:
    """All values are strings; `columns` name the fields (with a header they replace it); unnamed files get col_0, col_1.
    Cells beyond the names are a list _extra, where a file has any."""
    read = lambda **o: spark.read.options(sep=sep, header=header, multiLine=True, quote='"', escape='"').csv(path, **o)
    found = read(inferSchema=False).columns
    names = columns or (found if header else [f"col_{i}" for i in range(len(found))])
    more = 4
    while True:  # the cells beyond the names of the widest row
        d = read(schema=T.StructType([T.StructField(n, T.StringType()) for n in [*names, *(f"__x{i}" for i in range(more))]]), enforceSchema=True)
        if d.where(F.col(f"__x{more - 1}").isNotNull()).isEmpty():
            break
        more *= 4
    extra = F.array_compact(F.array(*[f"__x{i}" for i in range(more)]))
    d = d.withColumn("_extra", F.when(F.size(extra) > 0, extra))
    keep = [F.col(f"`{n}`") for n in names]
    return d.select(*keep, "_extra") if not d.where("_extra IS NOT NULL").isEmpty() else d.select(*keep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path).select(strip(F.col("value")).alias("text"))
    return with_order(d.where("text <> ''"))


def _paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Groups of lines between blank ones, each joined by single spaces."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.split("value", r"\n[ \t\r]*(?:\n[ \t\r]*)+")
    joined = F.transform(parts, lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != ""), " "))
    return with_order(whole.select(F.explode(joined).alias("text")).where("text <> ''"))


def _excel(spark: SparkSession, path: str, sheet: str | int) -> DataFrame:
    """One sheet through pandas, where a library for it is installed; workbooks are small by nature."""
    import pandas as pd

    try:
        frame = pd.read_excel(path.removeprefix("file://"), sheet_name=sheet)
    except ImportError as e:
        raise ConfigError(f"Excel files need a library that isn't here: {e}") from e
    return with_order(spark.createDataFrame(frame))


HUB = re.compile(r"hf://(?P<owner>[^/]+)/(?P<name>[^/]+)(?:/(?P<config>[^/]+)(?:/(?P<split>[^/]+))?)?/?$")


def parse_hub(uri: str) -> dict[str, str | None]:
    """owner, name, config and split of hf://owner/name[/config[/split]]; the split defaults to train."""
    m = HUB.match(uri)
    if not m:
        raise ConfigError(f"not a dataset address: {uri}")
    return m.groupdict() | {"split": m["split"] or "train"}


def read_hub(spark: SparkSession, uri: str, cache: str) -> DataFrame:
    """Shards that were staged as Parquet below cache/owner/name/config/split; nothing is downloaded here."""
    u = parse_hub(uri)
    return with_order(spark.read.parquet(f"{cache}/{u['owner']}/{u['name']}/{u['config'] or 'default'}/{u['split']}"))


def reference_texts(df: DataFrame) -> DataFrame:
    """Every non-blank string at any depth as a reference of its own."""

    def flat(c, kind):
        if isinstance(kind, T.StringType):
            return F.array(c)
        if isinstance(kind, T.ArrayType):
            return F.flatten(F.transform(c, lambda x: flat(x, kind.elementType)))
        if isinstance(kind, T.StructType):
            return F.flatten(F.array(*[flat(c[f.name], f.dataType) for f in kind.fields])) if kind.fields else F.array().cast("array<string>")
        return F.array().cast("array<string>")

    parts = [flat(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if not f.name.startswith("_")]
    d = df.select(F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))).alias("text"))
    return d.where(strip(F.col("text")) != "")


def benchmark_refs(spark: SparkSession, names: list[str], cache: str) -> DataFrame:
    """The texts of benchmarks of the registry that are staged as Parquet below cache/owner/name/config/split."""
    out = None
    for name in names:
        repo, parts, wanted = REGISTRY[name]
        for config, split in parts:
            d = read_hub(spark, f"hf://{repo}/{config}/{split}", cache)
            got = [d.select(F.col(f).cast("string").alias("text")) for f in wanted if f in d.columns]
            for one in got:
                out = one if out is None else out.union(one)
    if out is None:
        raise ConfigError("none of these benchmarks has a text field")
    return out.where(strip(F.col("text")) != "")
