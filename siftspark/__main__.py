"""python -m siftspark --input FILE --output FILE [options]: a run from the command line."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import tempfile
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from .config import PROFILES, ConfigError, CurationConfig, load_file, resolve
from .operators import decontam, stats
from .plans import curate, report
from .sources import readers, writers

_LISTS = ("text_fields", "require_fields", "lang_filter", "dedup_fields", "drop", "pii_only", "no_clean", "chat_roles", "decontam_refs")
_PATHS = ("input-format", "output-format", "config", "stats-file", "report", "split", "csv-delimiter", "json-path", "txt-fallback-field", "quality-script", "pii-patterns-file", "field-config", "decontaminate", "decontam-cache", "hf-cache", "pseudo-map-file", "excel-sheet-name")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftspark", argument_default=argparse.SUPPRESS)
    p.add_argument("--input", help="a file, hf://owner/name[/config[/split]] staged below --hf-cache, or - for standard input")
    p.add_argument("--output", help="a file, or a folder (with a slash at its end) that all executors write to")
    for name in _PATHS:
        p.add_argument(f"--{name}")
    p.add_argument("--profile", choices=sorted(PROFILES))
    p.add_argument("--generate-config", nargs="?", const="yaml", choices=["json", "yaml"])
    p.add_argument("--log-format", choices=["text", "json"])
    for name in ("dry-run", "stats-only", "paragraph-mode", "csv-no-header", "quick", "append", "resume", "quiet"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--csv-columns", type=lambda s: s.split(","))
    for name in ("shard-size", "dry-run-size", "excel-sheet-index"):
        p.add_argument(f"--{name}", type=int)
    for f in fields(CurationConfig):
        flag = f"--{f.name.replace('_', '-')}"
        if f.name in ("rename", "extra_patterns", "ner", "detector", "perplexity", "quality_check", "ner_entities"):
            continue
        if isinstance(f.default, bool):
            p.add_argument(flag, action="store_true")
        elif f.name in _LISTS:
            p.add_argument(flag, type=lambda s: [x.strip() for x in s.split(",") if x.strip()])
        else:
            kind = int if "int" in str(f.type) else float if "float" in str(f.type) else str
            p.add_argument(flag, type=kind)
    return p


def quality_script(path: str):
    """quality_check(record) of a Python file, as a function of the record's struct column; workers get the source."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if "quality_check" not in source:
        raise ConfigError(f"{path} has no quality_check")

    @arrow_udf(BooleanType())
    def run(v: pa.Array) -> pa.Array:
        space: dict = {"__name__": "quality_script"}
        exec(compile(source, path, "exec"), space)
        return pa.array([bool(space["quality_check"](r)) for r in v.to_pylist()], pa.bool_())

    return run


def check(a: dict) -> None:
    """Options that exclude each other."""
    wrong = [
        ("input" not in a, "--input is needed"),
        ("split" in a and "shard_size" in a, "--split and --shard-size exclude each other"),
        ("excel_sheet_name" in a and "excel_sheet_index" in a, "a sheet has a name or an index"),
        ("pseudo_map_file" in a and not a.get("pii_pseudonymize"), "--pseudo-map-file needs --pii-pseudonymize"),
        (a.get("resume") and ("split" in a or "shard_size" in a or "output" not in a), "--resume needs one --output"),
        (a.get("resume") and a.get("input") == "-", "standard input can't be resumed"),
        (a.get("format_chatml") and a.get("format_instruct"), "a record has one format"),
        ("decontaminate" in a and a["decontaminate"] != "list" and "decontam_cache" not in a, "--decontaminate reads staged benchmarks: name --decontam-cache"),
        (str(a.get("input", "")).startswith("hf://") and "hf_cache" not in a, "hub data must be staged: name --hf-cache"),
    ]
    for bad, said in wrong:
        if bad:
            raise ConfigError(said)


def configure(a: dict) -> CurationConfig:
    names = {f.name for f in fields(CurationConfig)}
    explicit = {k: v for k, v in a.items() if k in names}
    if "pii_patterns_file" in a:
        with open(a["pii_patterns_file"], encoding="utf-8") as f:
            explicit["extra_patterns"] = [(x["pattern"], x["token"], x.get("kind", "custom")) for x in json.load(f)]
    if "field_config" in a:
        with open(a["field_config"], encoding="utf-8") as f:
            explicit |= {k: v for k, v in json.load(f).items() if k in ("rename", "drop", "pii_only", "no_clean")}
    if "quality_script" in a:
        explicit["quality_check"] = quality_script(a["quality_script"])
    file = load_file(a["config"]) if "config" in a else {}
    if a.get("quick"):
        file |= {k: True for k in ("remove_pii", "deduplicate", "clean_html", "dedup_normalize")}
    return resolve(explicit, file, a.get("profile"))


def spooled(spark: SparkSession, kind: str) -> str:
    """Standard input as a file that executors can read: only in local mode is that one of this machine."""
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigError("on a cluster, put the input where all executors can read it")
    with tempfile.NamedTemporaryFile("wb", suffix=f".{kind}", delete=False) as f:
        f.write(sys.stdin.buffer.read())
    return f.name


def fingerprint(a: dict) -> str:
    """What a finished run depends on: options, and the input's path, size and time."""
    path = a["input"].removeprefix("file://")
    seen = [os.path.getsize(path), os.path.getmtime(path)] if os.path.exists(path) else []
    return hashlib.sha256(json.dumps([{k: v for k, v in sorted(a.items()) if k != "resume"}, seen], default=str).encode()).hexdigest()


def main(argv: list[str] | None = None) -> int:
    a = vars(parser().parse_args(argv))
    if "generate_config" in a:
        known = {f.name: getattr(CurationConfig(), f.name) for f in fields(CurationConfig)}
        plain = {k: v for k, v in known.items() if isinstance(v, bool | int | float | str)}
        print(json.dumps(plain, indent=2) if a["generate_config"] == "json" else "\n".join(f"{k}: {json.dumps(v)}" for k, v in plain.items()))
        return 0
    if a.get("decontaminate") == "list":
        print("\n".join(sorted(decontam.REGISTRY)))
        return 0
    try:
        check(a)
        cfg = configure(a)
        benchmarks = decontam.benchmark_names(a["decontaminate"]) if "decontaminate" in a else []
    except (ConfigError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    mark = a["output"].rstrip("/") + ".checkpoint.json" if "output" in a else None
    if a.get("resume") and os.path.exists(mark):
        with open(mark, encoding="utf-8") as f:
            done = json.load(f)
        if done["run"] == fingerprint(a):  # a run either has its whole output or starts again
            return finish(a, done["stats"])
    spark = SparkSession.builder.appName("siftspark").getOrCreate()
    spool = spooled(spark, a.get("input_format", "jsonl")) if a["input"] == "-" else None
    try:
        return execute(spark, a, cfg, spool or a["input"], benchmarks, mark)
    except ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        if spool:
            os.remove(spool)


def execute(spark: SparkSession, a: dict, cfg: CurationConfig, path: str, benchmarks: list[str], mark: str | None) -> int:
    if path.startswith("hf://"):
        d = readers.read_hub(spark, path, a["hf_cache"])
    else:
        d = readers.read_records(spark, path, a.get("input_format"), paragraphs=a.get("paragraph_mode"), delimiter=a.get("csv_delimiter"), header=not a.get("csv_no_header"), columns=a.get("csv_columns"), json_path=a.get("json_path"), sheet=a.get("excel_sheet_name", a.get("excel_sheet_index", 0)))
    if a.get("dry_run"):
        d = d.orderBy("_ord").limit(a.get("dry_run_size", 10_000))
    refs = readers.benchmark_refs(spark, benchmarks, a["decontam_cache"]) if benchmarks else None
    for r in cfg.decontam_refs or []:
        one = readers.reference_texts(readers.read_records(spark, r))
        refs = one if refs is None else refs.union(one)
    run = curate.run(spark, d, cfg, "_ord", refs)
    kept = curate.kept(run.rows, cfg)
    if "output" in a and not (a.get("dry_run") or a.get("stats_only")):
        out = a["output"]
        if "shard_size" in a:
            writers.write_shards(kept, out, "_ord", a["shard_size"])
        elif "split" in a:
            writers.write_splits(kept, out, "_ord", a["split"], cfg.seed)
        elif out.endswith("/"):
            writers.write_folder(kept, out, a.get("output_format", "jsonl"))
        elif out != "/dev/null":
            writers.write_file(kept, out, "_ord", a.get("output_format"), append=a.get("append", False), fallback=a.get("txt_fallback_field"))
        run.commit()
    if "pseudo_map_file" in a and run.pseudonyms is not None:
        writers.write_names(run.pseudonyms, a["pseudo_map_file"])
    said = stats.as_dict(run.rows)
    if "report" in a:
        with open(a["report"], "w", encoding="utf-8") as f:
            f.write(report.html_report(run.rows, "_ord", before=d))
    if a.get("resume"):
        with open(mark + ".tmp", "w", encoding="utf-8") as f:
            json.dump({"version": 1, "run": fingerprint(a), "stats": said}, f)
        os.replace(mark + ".tmp", mark)
    return finish(a, said)


def finish(a: dict, said: dict) -> int:
    """The summary: to a file if asked for, and to standard error as text or as one JSON event."""
    if "stats_file" in a:
        writers.write_summary(said, a["stats_file"])
    if not a.get("quiet"):
        lines = [f"{k}: {v}" for k, v in said.items() if v]
        print(json.dumps({"event": "complete"} | said) if a.get("log_format") == "json" else "\n".join(lines), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
