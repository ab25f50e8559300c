"""Running sums, sweeps, components in batches, levels, blocked matrices, items in blocks, jobs beside each other."""

import threading
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark.catalog import QUERIES
from lumenspark.operators import graph, levels, matrix, similar
from lumenspark.plans import scratch
from lumenspark.plans.ranking import running_sums
from lumenspark.sources import files

# --- running sums and sweeps


def test_running_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(x), None if k % 7 == 0 else 1) for k, x in zip(rng.permutation(500), rng.normal(size=500))]
    df = spark.createDataFrame(rows, "k long, x double, n long").repartition(6)
    got = {r["k"]: (r["x"], r["n"]) for r in running_sums(df, [F.desc("k")], ["x", "n"], 5).collect()}
    x = n = 0.0
    for k, a, b in sorted(rows, reverse=True):
        x, n = x + a, n + (b or 0)
        assert abs(got[k][0] - x) < 1e-9 and got[k][1] == n
    assert running_sums(df.limit(0), ["k"], ["x"], 3).count() == 0


def brute_sweep(rows, thresholds):
    out = {}
    positives = sum(w for _, _, _, w, d in rows if d)
    for i, rule in enumerate(similar.RULES):
        for t in thresholds:
            hits = [(w, d) for s, a, g, w, d in rows if s is not None and s >= t and (i == 0 or a) and (i < 2 or (a and g))]
            tp, every = sum(w for w, d in hits if d), sum(w for w, _ in hits)
            p, r = tp / every if every else 0, tp / positives if positives else 0
            out[rule, t] = (p, r, 2 * p * r / (p + r) if p + r else 0)
    return out


def test_sweep(spark):
    rng = np.random.default_rng(1)
    flag = lambda: [True, False, None][int(rng.integers(0, 3))]
    rows = [(round(float(rng.random()), 2) if rng.random() > 0.05 else None, flag(), flag(), float(rng.integers(1, 5)), bool(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "sim double, same_answer boolean, same_args boolean, weight double, duplicate boolean").repartition(4)
    values = {s for s, *_ in rows if s is not None}
    for got, thresholds, digits in ((similar.threshold_sweep(df), values, 6), (similar.detector_grid(df, [0.9, 0.2, 0.5, 2.0]), [0.2, 0.5, 0.9, 2.0], 3)):
        want = brute_sweep(rows, thresholds)
        told = {(r["rule"], r["threshold"]): (r["precision"], r["recall"], r["f1"]) for r in got.collect()}
        assert told.keys() == want.keys() and all(np.allclose(told[k], want[k], atol=10**-digits) for k in want)
    assert similar.threshold_sweep(df.limit(0)).count() == 0
    assert {r["precision"] for r in similar.detector_grid(df.limit(0), [0.5]).collect()} == {0.0}


# --- components


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_components_in_batches(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(5, None), (7, 7), (1000, 1000)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    known = graph.connected_components(frame(edges[:90]))
    for some in (edges[90:150], edges[150:], []):
        told = []
        known = graph.update_components(known, frame(some), told=told)
        assert all(n <= len(some) for n in told)  # rounds run over new edges only
    got = [tuple(r) for r in known.collect()]
    assert len(got) == len({x for x, _ in got}) and dict(got) == brute_components(edges)


# --- levels


def test_levels(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], None if i % 5 == 0 else i % 5, float(x), int(i % 700)) for i, x in enumerate(rng.normal(size=6000))]
    df = spark.createDataFrame(rows, "a string, b int, x double, who long").repartition(5)
    parts = levels.states(df.filter("who < 300"), ["a", "b"], "x", "who").unionByName(levels.states(df.filter("who >= 300"), ["a", "b"], "x", "who"))
    for held in (levels.states(df, ["a", "b"], "x", "who"), levels.merged(parts, ["a", "b"])):
        got = levels.roll_up(held, [["a", "b"], ["b"], []], {"p10": 0.1, "p50": 0.5}).collect()
        groups = defaultdict(list)
        for a, b, x, who in rows:
            for k, key in enumerate(((a, b), (None, b), (None, None))):
                groups[k, *key].append((x, who))
        assert len(got) == len(groups)
        for r in got:
            own = groups[r["level"], r["a"], r["b"]]
            x = np.array([v for v, _ in own])
            assert r["n"] == len(own) and abs(r["total"] - x.sum()) < 1e-6
            assert abs((x <= r["p50"]).mean() - 0.5) < 0.03 and abs((x <= r["p10"]).mean() - 0.1) < 0.03
            assert abs(r["distinct"] / len({w for _, w in own}) - 1) < 0.05


# --- matrices


@pytest.mark.parametrize("shape", [(70, 33, 51), (64, 1, 64), (5, 200, 3)])
def test_blocked_product(spark, shape):
    n, r, m = shape
    rng = np.random.default_rng(n)
    w, b, a = rng.normal(size=(n, m)), rng.normal(size=(n, r)), rng.normal(size=(r, m))
    b[3] = 0  # a row that is missing below
    blocks = lambda x: matrix.to_blocks(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x) if row.any()], "row long, values array<double>"), 16)
    got = {x["row"]: x["values"] for x in matrix.to_rows(matrix.merge_update(blocks(w), blocks(b), blocks(a), 8.0, r), 16).collect()}
    want = w + 8.0 / r * b @ a
    assert sorted(got) == list(range(n)) and all(np.allclose(got[i], want[i]) for i in range(n))
    plain = {x["row"]: x["values"] for x in matrix.to_rows(matrix.product(blocks(b), blocks(a)), 16).collect()}
    assert all(np.allclose(plain[i], (b @ a)[i]) for i in range(n))
    empty = blocks(w).limit(0)
    assert matrix.product(empty, blocks(a)).count() == 0 and matrix.add(empty, blocks(w)).count() == blocks(w).count()
    with pytest.raises(ValueError, match="rank"):
        matrix.merge_update(empty, empty, empty, 1.0, 0)


# --- blocks of items, jobs, runs


def test_holding_in_measured_blocks(spark):
    rng = np.random.default_rng(5)
    items = ["".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(60)] + ["abcabc" * 40, None]
    texts = ["".join(rng.choice(list("abcd"), rng.integers(0, 30))) for _ in range(200)] + ["x" + "abcabc" * 40, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    frame = spark.createDataFrame([(x,) for x in items + items[:5]], "item string")
    want = {i for i, t in enumerate(texts) if t is not None and any(x in t for x in items if x is not None)}
    for most in (8_000_000, 100, 7):
        got = [r["doc_id"] for r in similar.holding(docs, frame, most).collect()]
        assert set(got) == want and len(got) == len(want)
    everything = spark.createDataFrame([("",), ("zz",)], "item string")
    assert {r["doc_id"] for r in similar.holding(docs, everything).collect()} == {i for i, t in enumerate(texts) if t is not None}


def test_jobs_in_two_threads(spark):
    """A job deletes what it has written itself, not what another thread's job still reads."""
    first, second, held = threading.Event(), threading.Event(), {}

    def other():
        with scratch.job(spark) as own:
            held["table"] = scratch.materialize(spark.range(9), "other")
            first.set()
            second.wait(60)
            held["n"] = held["table"].count()
            own.release()

    t = threading.Thread(target=other)
    t.start()
    first.wait(60)
    with scratch.job(spark) as own:
        a, b = scratch.materialize(spark.range(3), "a"), scratch.materialize(spark.range(4), "b")
        assert own.release({b._scratch}) == 1 and b.count() == 4
        assert a._scratch not in scratch.written() and held["table"]._scratch in scratch.written()
    second.set()
    t.join(60)
    assert held["n"] == 9 and held["table"]._scratch not in scratch.written() and b._scratch in scratch.written()
    scratch.drop(b)


def test_runs_of_any_shape(spark, tmp_path):
    for phase, metrics in (("eval", '{"acc": {"dev": 0.5}}'), ("eval", '{"acc": {"dev": 0.9}, "n": [1, 2]}'), ("eval", '{"acc": "none"}'), ("eval", "no json"), ("train", '{"acc": {"dev": 0.7}}')):
        files.log_run(spark, phase, '{"seed": 1}', metrics, str(tmp_path / "runs"))
    runs = files.load_runs(spark, str(tmp_path / "runs"))
    found = lambda *a, **k: sorted(r["found"] for r in files.runs_where(runs, *a, **k).collect())
    assert found("metrics", "$.acc.dev") == [0.5, 0.7, 0.9] and found("metrics", "$.acc.dev", low=0.6) == [0.7, 0.9]
    assert found("metrics", "$.acc.dev", low=0.6, high=0.8) == [0.7] and found("metrics", "$.n[1]") == [2.0] and found("config", "$.seed") == [1.0] * 5
    assert files.typed_runs(runs).filter("metrics is null").count() == 1


# --- neighbours in tiles


def test_neighbours_memory():
    """Thousands of queries against thousands of rows in a bounded piece of memory, ties by id."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 16))
    x = np.concatenate([v] * 20)
    ids = rng.permutation(len(x))
    batches = ((pa.array(ids[i : i + 5000]), x[i : i + 5000]) for i in range(0, len(x), 5000))
    tracemalloc.start()
    found, sims, names = similar._closest(x, pa.array(ids), 3, batches)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all similarities of one batch are 240 MB
    for q in (0, 7, 4711, 5999):
        s = (v * x[q]).sum(axis=1)
        order = np.lexsort((ids, -np.concatenate([s] * 20)))
        assert names.take(pa.array(found[q])).to_pylist() == [ids[o] for o in order if o != q][:3]


def test_neighbours_odd_vectors(spark):
    """Fewer rows than places, vectors without a similarity, and text ids."""
    nan = float("nan")
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [nan, 1.0]), ("d", [0.0, 1.0])], "id string, embedding array<double>")
    got = {(r["a"], r["rank"]): (r["b"], r["sim"]) for r in similar.neighbours(df, 5).collect()}
    assert got == {("a", 1): ("b", 1.0), ("a", 2): ("d", 0.0), ("b", 1): ("a", 1.0), ("b", 2): ("d", 0.0), ("d", 1): ("a", 0.0), ("d", 2): ("b", 0.0)}
    blocks = {(r["a"], r["rank"]): (r["b"], r["sim"]) for r in similar.neighbours(df, 5, block=1).collect()}
    assert blocks == got


# --- tables as large copies and odd files hold them


def test_broken_pairs_of_large_keys(spark, tmp_path):
    """Keys beyond a million: a wrong answer must not come within the relative tolerance of the key."""
    keys = [2_000_003, 2_000_005, 2_000_012, 35_999_997, 60_000_010, 7, 10, 11]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"] for r in QUERIES["broken_pairs"](spark, str(tmp_path)).collect()}
    assert got == {k for k in keys if k % 5 == 0 or k % 7 == 0}


def test_levels_of_null_keys(spark, tmp_path):
    """A null language or source is a group of its own."""
    rows = [(i, [None, "en", "de"][i % 3], [None, "web"][i % 2], 10 + i) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["multi_level_report"](spark, str(tmp_path)).collect()
    assert sorted((r["level"], r["lang"] or "", r["source"] or "", r["n"]) for r in got) == sorted([(0, a, b, 10) for a in ("", "en", "de") for b in ("", "web")] + [(1, a, "", 20) for a in ("", "en", "de")] + [(2, "", "", 60)])
    assert all(r["median_close"] and r["distinct_close"] for r in got)


def test_distinct_counts_are_close(spark):
    """Of 200 groups none is off by 3 %."""
    df = spark.range(200 * 5000).select((F.col("id") % 200).alias("g"), (F.col("id") * 1_000_003).alias("who"))
    told = levels.roll_up(levels.states(df, ["g"], "who", "who"), [["g"]], {"median": 0.5})
    assert told.filter(F.abs(F.col("distinct") - 5000) > 150).count() == 0


def test_texts_become_strings_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([*["é" * 20_000 + "z"] * 300, None, "", "é"])
    made = similar._automaton("one", ["éz"])
    tracemalloc.start()
    hit = similar._hits(texts, made.iter, False).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit == [*[True] * 300, False, False, False] and peak < 1_000_000
    assert similar._hits(texts, made.iter, True).to_pylist() == [*[True] * 300, False, True, True]
