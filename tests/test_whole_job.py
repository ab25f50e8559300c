"""Queries apply their operator to every row of their tables."""

import duckdb

from lumenspark.catalog import ORACLES, QUERIES


def test_answer_agreement_compares_every_answer(spark, tmp_path):
    rows = [(int(q), n, q) for n in range(1, 11) for q in (1.0, 50.0, 2000.0)] + [(9, 3, None), (9, 4, None)]
    file = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(file)
    # a yes never is a number; only n/a and missing results leave nothing to compare
    want = {(o, n): None if q is None else {0: True, 1: q == 2000, 2: True, 3: False, 4: None}[n % 5] for o, n, q in rows}
    got = QUERIES["answer_agreement"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {(r["l_orderkey"], r["l_linenumber"]): r["agrees"] for r in got} == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{file}/*.parquet'")
    assert {(o, n): agrees for o, n, agrees in db.execute(ORACLES["answer_agreement"]).fetchall()} == want
