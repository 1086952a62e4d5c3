import json

import pytest
from pyspark.sql import functions as F

from siftspark import __main__ as cli
from siftspark.sources import readers

GOOD = "The quick brown fox jumps over the lazy dog and then it runs home to see what there is for dinner"


@pytest.fixture()
def records(tmp_path):
    rows = [{"text": f"{GOOD}, number {i}.", "n": i} for i in range(6)] + [{"text": "mail ann@x.org about it. " + GOOD, "n": 9}]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "7\n")
    return tmp_path


def test_run_with_script_map_report_and_resume(spark, records, capsys):
    (records / "q.py").write_text("def quality_check(r):\n    return r['n'] != 3\n")
    args = ["--input", f"{records}/in.jsonl", "--output", f"{records}/out.jsonl", "--quality-script", f"{records}/q.py", "--remove-pii", "--pii-pseudonymize", "--pseudo-map-file", f"{records}/map.json", "--report", f"{records}/r.html", "--stats-file", f"{records}/s.json", "--resume", "--log-format", "json"]
    assert cli.main(args) == 0
    out = [json.loads(x) for x in (records / "out.jsonl").read_text().splitlines()]
    assert [r["n"] for r in out] == [0, 1, 2, 4, 5, 9] and "email_0001@redacted.local" in out[-1]["text"]
    assert json.loads((records / "map.json").read_text()) == {"ann@x.org": "email_0001@redacted.local"}
    said = json.loads((records / "s.json").read_text())
    assert (said["total"], said["kept"], said["malformed"], said["quality"]) == (8, 6, 1, 1)
    page = (records / "r.html").read_text()
    assert "before and after" in page and "ann@x.org" in page and "Redacted, by kind" in page
    assert json.loads(capsys.readouterr().err.strip().splitlines()[-1])["event"] == "complete"
    (records / "out.jsonl").unlink()
    assert cli.main(args) == 0 and not (records / "out.jsonl").exists()  # the finished run isn't made again


def test_folder_sink_and_staged_benchmarks(spark, records):
    text = "which number of foxes jumps over the lazy dog at night " + GOOD
    spark.createDataFrame([(text,)], "question string").write.parquet(f"{records}/cache/openai/gsm8k/main/test")
    assert cli.main(["--input", f"{records}/in.jsonl", "--output", f"{records}/o/", "--decontaminate", "gsm8k", "--decontam-cache", f"{records}/cache", "--quiet"]) == 0
    assert spark.read.schema("text string, n long").json(f"{records}/o").count() == 0  # all repeat the benchmark's words
    d = readers.read_hub(spark, "hf://openai/gsm8k/main/test", f"{records}/cache")
    assert d.select(F.count("*")).first()[0] == 1
    assert cli.main(["--input", "hf://openai/gsm8k/main/test", "--hf-cache", f"{records}/cache", "--output", f"{records}/h.jsonl", "--text-fields", "question", "--quiet"]) == 0
    assert json.loads((records / "h.jsonl").read_text())["question"] == text


@pytest.mark.parametrize("args", [["--output", "x.jsonl"], ["--input", "x.jsonl", "--split", "a=0.5,b=0.5", "--shard-size", "3"], ["--input", "x.jsonl", "--pseudo-map-file", "m"], ["--input", "x.jsonl", "--decontaminate", "mmlu"], ["--input", "x.jsonl", "--decontaminate", "nope", "--decontam-cache", "c"], ["--input", "x.jsonl", "--fuzzy-dedup", "--semantic-dedup"], ["--input", "hf://a/b"]])
def test_options_that_cannot_hold(args):
    assert cli.main(args) == 2
