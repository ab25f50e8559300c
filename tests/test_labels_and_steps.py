"""Label sheets, the generation hook, resumable steps and log scans on small fixtures."""

import pytest

from lumenspark.operators import labels
from lumenspark.operators.generate import generate
from lumenspark.plans.spread import spread
from lumenspark.plans.steps import Step, last_match, log_tail, run_steps
from lumenspark.sources import files

RECORDS = "id long, question string, answer_text string, gold_evidence array<struct<key:string,value:string>>, report_id string"


@pytest.fixture
def records(spark):
    return spark.createDataFrame([(i, f"q{i}", str(i), [("k", "one"), ("l", f"e{i}")], None) for i in range(6)], RECORDS)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, sim double, same_answer boolean")


def test_draw_keeps_to_plan_and_weights(spark):
    rows = [(i, i + 100, 0.85, i % 2 == 0) for i in range(40)] + [(500, 501, 0.5, True), (1, 900, 1.0, None)]
    got = labels.draw(pairs(spark, rows), 3).collect()
    assert sorted(r["pair_id"] for r in got) == list(range(1, len(got) + 1))
    by = {}
    for r in got:
        by.setdefault(r["stratum"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"0.80-0.88|same": 6, "0.80-0.88|diff": 10, "0.99-1.00|diff": 1}
    assert all(abs(r["weight"] - 20 / len(by[r["stratum"]])) < 1e-12 for r in got if r["sim"] == 0.85)


def test_draw_of_nothing(spark):
    assert labels.draw(pairs(spark, []), 3).collect() == []


def test_sheet_round_trip(spark, records, tmp_path):
    drawn = labels.draw(pairs(spark, [(0, 1, 0.9, True), (2, 3, 0.85, False)]), 3)
    blank = labels.sheet(drawn, records)
    assert blank.columns == files.SHEET
    got = {r["a_question"]: r for r in blank.collect()}
    assert set(got) == {"q0", "q2"} and got["q0"]["b_evidence"] == "one e1" and got["q0"]["a_report"] is None
    from pyspark.sql import functions as F

    filled = blank.withColumn(files.SHEET[1], F.when(F.col("a_question") == "q0", " 1").otherwise("0"))
    files.write_sheet(filled, str(tmp_path / "s"))
    read = files.read_labels(spark, str(tmp_path / "s"))
    ids = spark.createDataFrame([(0, [1.0], [1.0, 0.0]), (1, [1.0], [0.6, 0.8]), (2, [], [1.0, 0.0])], "id long, args array<double>, embedding array<float>")
    out = labels.labelled(read, drawn, ids.select("id", "args"), ids.select("id", "embedding")).collect()
    assert [(r["a"], r["b"], round(r["sim"], 6), r["same_args"], r["duplicate"]) for r in out] == [(0, 1, 0.6, True, True)]
    assert [(r["a"], r["b"]) for r in labels.lost_pairs(read, drawn, ids).collect()] == [(2, 3)]


def test_generate(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "a\nb c")], "id long, prompt string")
    seen = generate(df, lambda ps: [p[::-1] for p in ps], batch=2).collect()
    assert sorted((r["id"], r["output"]) for r in seen) == [(1, "ba"), (2, ""), (3, "c b\na")]
    assert generate(df.limit(0), lambda ps: ps).collect() == []
    with pytest.raises(Exception, match="prompts gave"):
        generate(df.coalesce(1), lambda ps: []).collect()


def test_steps_resume_and_stop_at_first_failure():
    made, told = {"a"}, []

    def step(name, works=True):
        return Step(name, lambda: name in made, lambda: made.add(name) if works else None)

    def broken():
        raise ValueError("no model")

    status = run_steps([step("a"), step("b"), step("c", works=False), step("d")], told.append)
    assert status == {"a": "done (already)", "b": "done", "c": "failed: not done after its run", "d": "pending"}
    assert told[0]["b"] == "pending" and told[-1] == status
    assert run_steps([Step("x", lambda: False, broken)])["x"] == "failed: no model"
    assert run_steps([]) == {}


def test_log_tail_and_last_match(spark):
    rows = [(i, t) for i, t in enumerate(["load 1/9 done", "", "x" * 300, "progress bar 7%", "load 5/9 done", None, "end"])]
    log = spark.createDataFrame(rows, "line int, text string")
    assert [(r["line"], len(r["text"])) for r in log_tail(log, ["bar"], 3).collect()] == [(6, 3), (4, 13), (2, 200)]
    assert last_match(log, r"load (\d+)/\d+").first()["found"] == "5"
    assert last_match(log, r"gone (\d+)").first()["found"] is None


def test_spread_keeps_rows_and_leaves_wide_scans(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        assert spread(scan).rdd.getNumPartitions() == cores
    assert sorted(r["id"] for r in spread(scan).collect()) == list(range(1000))
    wide = spark.range(0, 100, 1, cores + 1)
    assert spread(wide) is wide
