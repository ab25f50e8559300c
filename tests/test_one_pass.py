"""Programs and texts go to Python once, and only where it is needed."""

import pyarrow as pa
from pyspark.sql import functions as F

from lumenspark import catalog, catalog_io  # noqa: F401
from lumenspark.functions import numbers as N
from lumenspark.functions import program as P
from lumenspark.functions import render as R
from lumenspark.functions import text as X
from lumenspark.operators import curate


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_programs_pass_python_once(spark, sf):
    for name in ("program_exec", "executed_programs", "program_parse_deep"):
        assert plan(catalog.QUERIES[name](spark, sf)).count("ArrowEvalPython [") == 1, name


def test_flat_programs_parse_as_others():
    texts = ["add(1, 2), subtract(#0, 3)", " add (1,  2),,divide(a, b, c) ,", "add(1,2)", "table_max(net (loss), none)", "1add(1, 2)", "add(1, 2) x", "add(é, 2)", "add(\t1, 2)", "add(, )", "", None, "add(1, 2)(", "add(1, 2)add(3, 4)"]
    assert P._parsed(pa.array(texts)).to_pylist() == [P._steps(t) for t in texts]
    assert P._parsed(pa.array(texts[:2])).to_pylist() == [P._steps(t) for t in texts[:2]]
    assert P._parsed(pa.array([None], pa.string())).to_pylist() == [None]


def test_arguments_read_alike():
    texts = ["1", "-2.50", "1,000", "12.5%", "const_100", "const_m1", "#3", "#x", "none", "1e3", "9" * 20, "", "5.", ".5", "#²"]
    value, refers = P._arguments(pa.array(texts))
    want = [float("nan") if t[:1] == "#" else P._number(t) for t in texts]
    assert [v if v == v else None for v in value.tolist()] == [w if w == w else None for w in want]
    assert refers.tolist() == [3 if t == "#3" else -2 if t[:1] == "#" else -1 for t in texts]


def test_run_is_the_last_result(spark):
    rows = [("add(1, 2), multiply(#0, 3)", None), ("table_sum(a, none)", [["x"], ["a", "$ 1", "2 (3)"]]), ("greater(2, 1)", None), ("divide(1, 0)", None), ("bad", None), (None, None), ("table_max(b, none)", [["a", "1"], []])]
    df = spark.createDataFrame(rows, "program string, table array<array<string>>")
    got = df.select(P.run(F.col("program"), F.col("table")).alias("r"), F.try_element_at(P.execute_steps(P.parse(F.col("program")), F.col("table")), F.lit(-1)).alias("w"), P.execute(F.col("program"), F.col("table")).alias("e"), P.results(F.col("program"), F.col("table")).alias("all"))
    got = got.collect()
    assert [(r["r"]["num"], r["r"]["txt"]) for r in got] == [(r["w"]["num"], r["w"]["txt"]) if r["w"] else (None, None) for r in got]
    assert [r["e"] for r in got] == [r["w"] for r in got] and [r["all"][-1] if r["all"] else None for r in got] == [r["w"] for r in got]
    assert [r["r"]["num"] for r in got] == [9.0, 3.0, None, None, None, None, None]


def test_short_prompts_pass_without_a_count(spark):
    df = spark.createDataFrame([(["a b"], [["x", "|"], ["1"]], ["c"], "q?"), ([], [], [], ""), (["w " * 50], [[""] * 9, []], ["e"], "z " * 40)], "pre array<string>, t array<array<string>>, post array<string>, q string")
    c = [F.col(n) for n in df.columns]
    got = df.select(F.length(R.prompt(*c)).alias("n"), R.longest_prompt(*c).alias("most")).collect()
    assert all(r["most"] is None or r["n"] <= r["most"] for r in got) and got[0]["most"] is not None


def test_texts_in_one_go(spark):
    df = spark.createDataFrame([(["a f0b7 b", "x 2019s"],), (["1,234.5", ".5 and 007"],), ([None, " \x1c"],)], "t array<string>")
    whole = F.array_join(F.transform("t", X.decode_artifacts), " ")
    got = df.select(X.decoded_join(F.col("t")).alias("a"), whole.alias("b"), N.numbers_in(whole).alias("n"), F.transform("t", curate.blank).alias("k")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    assert got[1]["n"] == [0.5, 7.0, 1234.5] and got[2]["k"] == [True, True]


def test_rule_totals_normalise_only_what_is_not_ascii(spark, monkeypatch):
    def strict(s):
        assert not any(x.isascii() for x in s)
        return s.str.normalize("NFKC")

    df = spark.createDataFrame([("5 %",), ("5 ％",), ("a  b",), ("é  b",), (None,), ("",)], "t string")
    want = {"percent_space": 2, "multi_space": 2}
    assert {r["rule"]: r["n"] for r in curate.rule_totals(df, "t").collect()} == want
    monkeypatch.setattr(X, "nfkc", F.pandas_udf(strict, "string"))
    assert {r["rule"]: r["n"] for r in curate.rule_totals(df, "t").collect()} == want
    assert curate.rule_totals(df.limit(0), "t").count() == 0
