"""Files in and out, logs that resume, and pairs from samples."""

import json

import pytest
from pyspark.sql import functions as F

from lumenspark.operators import curate, preference, similar
from lumenspark.sources import files
from lumenspark.streaming import log


def test_json_arrays(spark, tmp_path):
    raw = [{"id": "a", "filename": "CO/2009/p.pdf", "pre_text": ["x"], "post_text": [], "table": [["h"], ["r", "1"]], "qa": {"question": "q", "answer": "", "program": "add(1, 2)", "program_re": "", "exe_ans": 3.0, "gold_inds": {"text_1": "e"}}}]
    raw.append(raw[0] | {"id": "b", "filename": "CO/2009", "qa": raw[0]["qa"] | {"exe_ans": "yes"}})
    (tmp_path / "t.json").write_text(json.dumps(raw))
    df = files.read_arrays(spark, {"train": str(tmp_path / "t.json")}, files.PROGRAM_RECORD, curate.standardize_program_records).orderBy("id")
    a, b = df.withColumn("issues", curate.structural_issues()).collect()
    assert (a["company"], a["year"], a["exe_num"], a["exe_txt"]) == ("CO", 2009, 3.0, None) and a["issues"] == ["ragged_table", "empty_answer_text"]
    assert (b["exe_num"], b["exe_txt"]) == (None, "yes") and b["issues"][-2:] == ["non_numeric_exe_ans", "unparsed_report_id"]
    assert curate.duplicate_ids(df).count() == 0


def test_sheet_round_trip(spark, tmp_path):
    row = [(1, "1", *["é, \"x\""] * 8)]
    df = spark.createDataFrame(row, ", ".join(f"`{c}` {'int' if i == 0 else 'string'}" for i, c in enumerate(files.SHEET)))
    files.write_sheet(df, str(tmp_path / "s"))
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "s")).collect()] == [(1, True)]
    files.write_sheet(df.withColumn(files.SHEET[1], F.lit("maybe")), str(tmp_path / "t"))
    with pytest.raises(Exception, match="label"):
        files.read_labels(spark, str(tmp_path / "t")).collect()


def test_runs_lines_and_reports(spark, tmp_path):
    ids = [files.log_run(spark, p, "{}", "{}", str(tmp_path / "runs")) for p in ("clean", "eval")]
    assert [r["run_id"] for r in files.load_runs(spark, str(tmp_path / "runs"), "eval").collect()] == ids[1:]
    df = spark.createDataFrame([(2, "ü</b>"), (1, "x")], "n int, t string")
    files.write_lines(df, str(tmp_path / "l"))
    assert files.read_lines(spark, str(tmp_path / "l"), df.schema).count() == 2
    assert files.head(df, "n", 1).first()["n"] == 1 and files.head(df, "n", None).count() == 2
    assert files.calibration_text(df, "t", "n").first()["text"] == "x\n\nü</b>"
    assert files.html_report("<a>__DATA__</a>", '{"x": "</b>"}') == '<a>{"x": "<\\/b>"}</a>'
    assert "ü" in files.report_json(df).first()["json"]


def test_append_log_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    step = lambda: log.append_log(spark, str(source), "id string, seq int, v int", str(tmp_path / "out"), str(tmp_path / "c"))
    (source / "1.json").write_text('{"id": "a", "seq": 1, "v": 1}\n{"id": "b", "seq": 2, "v": 2}\n')
    step()
    (source / "2.json").write_text('{"id": "a", "seq": 3, "v": 9}\n')
    step()
    step()
    assert {tuple(r) for r in log.resume(spark, str(tmp_path / "out"), "id", "seq").select("id", "v").collect()} == {("a", 9), ("b", 2)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_edges_and_status(spark):
    rows = spark.createDataFrame([("p1", False), ("p2", False), ("t", True), ("a", False), ("b", False), ("c", False)], "id string, is_test boolean")
    edges = spark.createDataFrame([("p1", "p2"), ("p1", "t"), ("a", "b"), ("b", "c"), ("b", "t")], "a string, b string")
    got = {r["id"]: r["status"] for r in similar.apply_edges(rows, edges).collect()}
    assert got == {"p1": "contaminated", "p2": "kept", "a": "kept", "b": "contaminated", "c": "duplicate"}
    spread = {r["id"]: r["status"] for r in similar.apply_edges(rows, edges, spread=True).collect()}
    assert set(spread.values()) == {"contaminated"}


def test_pairs_respect_target(spark):
    one = lambda o, c: {"output": o, "correct": c, "extracted": o[-1]}
    rows = [(i, [one("answer: 1", True), one("so 2", False), one("Answer: 3", False), one(" Answer: 3 ", False), one("  ", False)]) for i in range(6)]
    rows.append((6, [one("answer: 1", True)]))
    samples = spark.createDataFrame(rows, "id int, samples array<struct<output:string,correct:boolean,extracted:string>>")
    prompts = samples.select("id", F.lit("ref").alias("reference"), F.lit("1").alias("answer"))
    got = preference.build_pairs(samples, prompts, 8, 1).collect()
    assert len(got) == 8 and sum(r["i"] == 0 for r in got) == 6
    assert all(r["rejected"].strip() == "Answer: 3" for r in got if r["i"] == 0) and {r["source_id"] for r in got} == set(range(6))


def test_large_files_are_hashed_piece_by_piece(spark, tmp_path, monkeypatch):
    """Files that binaryFile can't hold: any bytes, line ends, byte-order marks and names; a task reads a split at most."""
    import hashlib
    import random

    rng, bom = random.Random(3), b"\xef\xbb\xbf"
    noise = rng.randbytes(90_000)
    contents = {
        "noise": noise,
        "ended[1] {a}": noise + b"\n",
        "ends": bytes(rng.choice(b"\n\r\0a") for _ in range(70_000)) + b"\n\n",
        "marked.csv": bom + noise[:66_000] + b"\r\n",
        "marked": bom + b"\n" + noise[:66_000].rstrip(b"\n"),
        "one line": b"x" * 70_000,
        "small": b"a\n",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(files, "LARGE", 60_000, raising=False)
    held = {"spark.sql.sources.binaryFile.maxLength": "60000", "spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["path"].rsplit("/", 1)[-1]: (r["bytes"], r["sha256"]) for r in files.manifest(spark, f"file://{tmp_path}").collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}


def test_packed_large_files_stay_whole(spark, tmp_path, monkeypatch):
    import gzip
    import hashlib

    (tmp_path / "a.gz").write_bytes(data := gzip.compress(b"a\nb\n" * 50, mtime=0))
    monkeypatch.setattr(files, "LARGE", 10)
    assert [r["sha256"] for r in files.manifest(spark, f"file://{tmp_path}").collect()] == [hashlib.sha256(data).hexdigest()]


def test_pair_report_reads_outputs_once(spark, sf, monkeypatch):
    from lumenspark.catalog import QUERIES

    calls, plain = [], preference.distinct_outputs
    monkeypatch.setattr(preference, "distinct_outputs", lambda s: calls.append(1) or plain(s))
    assert QUERIES["pair_report"](spark, sf).count() == 1 and len(calls) == 1
    one = lambda *x: [{"output": t, "correct": c, "extracted": None} for t, c in x]
    rows = [(1, one(("a", True), (" a ", False))), (2, one(("a", False), ("b", True), ("c", False), ("d", False))), (3, []), (4, one(("  ", False))), (5, one(("x", None))), (6, None), (7, one(("Answer: 1", False), ("z", False)))]
    samples = spark.createDataFrame(rows, "id long, samples array<struct<output:string,correct:boolean,extracted:string>>")
    pairs = preference.build_pairs(samples, samples.select("id", F.lit("r").alias("reference"), F.lit("1").alias("answer")), 100, 1)
    got = sorted((r["source_id"], r["i"], r["chosen"], r["chosen_source"]) for r in pairs.collect())
    assert got == [(2, 0, "b", "sampled"), (2, 1, "b", "sampled"), (7, 0, "r", "reference"), (7, 1, "r", "reference")]
    assert pairs.filter("source_id = 7 and i = 0").first()["rejected"] == "Answer: 1"
    assert [preference.unpaired(samples, p).first()[0] for p in (None, pairs)] == [5, 5]
