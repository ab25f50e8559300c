"""The pipeline and its stages against the operators' brute-force versions, with odd rows and clashing columns."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, brute_components, brute_hits, brute_lines, check, library, plain_fingerprint

from lumenspark.llm import op1_quality
from lumenspark.plans import scratch

#: Names that operators use themselves.
CLASHES = ["__row", "row", "__score", "score", "__cuts", "cuts", "fp", "spans", "items", "n_words", "first", "none", "__text"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The small tables; documents have odd rows, repeated rows and clashing columns."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i if i else None, t, "en", "odd", 1) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars int")
    both = docs.unionByName(odd.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).unionByName(docs.filter("doc_id % 40 = 0"))
    for i, c in enumerate(CLASHES):
        both = both.withColumn(c, F.coalesce(F.col("doc_id"), F.lit(-1)) * 100 + i)
    both.repartition(3).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


def rows_of(df):
    """Rows with all columns, in the order of the operators: doc_id with nulls last, then text."""
    return sorted([r.asDict() for r in df.collect()], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))


def whole(r):
    return r["doc_id"], r["text"], *[r[c] for c in CLASHES]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, rows_of(docs)
    model = op1_quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        after = rows_of(docs)
        if name == "quality":
            want = [r for r in before if model.score(model.margin(op1_quality.features(r["text"] or ""))) >= 0.3]
            assert 0 < len(want) < len(before)
        elif name == "line_dedup":
            held = [r for r in before if r["text"] is not None]
            cut = iter(brute_lines([r["text"] for r in held], 20))
            want = [r | {"text": next(cut) if r["text"] is not None else None} for r in before]
            assert sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in want) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in after)
            assert {c: sorted(str(r[c]) for r in want) for c in CLASHES} == {c: sorted(str(r[c]) for r in after) for c in CLASHES}
            before = after
            continue
        elif name == "simhash":
            label = brute_components([plain_fingerprint(r["text"]) for r in before])
            firsts = {}
            for r, k in zip(before, label):
                firsts.setdefault(k, r)
            want = list(firsts.values())
            # equal rows of a doc_id may stand for each other
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in want) == sorted((r["doc_id"] is None, r["doc_id"]) for r in after)
            assert all(whole(r) in {whole(x) for x in before} for r in after)
            before = after
            continue
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
            bad = brute_hits([(i, r["text"]) for i, r in enumerate(before)], items)
            want = [r for r, b in zip(before, bad) if not b[5]]
            assert len(want) < len(before)
        check([whole(r) for r in after], [whole(r) for r in want])
        before = after


def test_run(spark, folder):
    """run() gives the digests of what the first four stages keep, and leaves one table behind."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, folder), "stage")
    t, want = library("word_bpe_49k.json"), []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    held = scratch.written()
    got = corpus_pipeline.run(spark, folder)
    assert len(scratch.written() - held) == 1
    check(got.collect(), want)


def test_empty(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == docs.count()


def test_descent_against_projected_gradient():
    """The dual coordinate descent reaches the optimum that projected gradient steps on the dual reach."""
    rng = np.random.default_rng(5)
    rows = [np.unique(np.concatenate([rng.integers(0, 60, 12), rng.integers(60, 90, 6) if k else rng.integers(80, 110, 6)])) for k in rng.integers(0, 2, 60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    pos, neg = np.ones(op1_quality.SPACE), np.ones(op1_quality.SPACE)
    for f, k in zip(rows, y):
        (pos if k > 0 else neg)[f] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    x = np.zeros((60, 111))
    for i, f in enumerate(rows):
        x[i, f], x[i, 110] = ratio[f] / np.sqrt(len(f)), 1.0
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(50_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, 1.0)
    best = (alpha * y) @ x
    weight, bias = op1_quality._train(rows, y, 1.0, 2000, 7)
    margins = [weight[f].sum() / np.sqrt(len(f)) + bias for f in rows]
    assert np.abs(np.array(margins) - x @ best).max() < 0.01


def test_quality_repeated_labels(spark):
    """The most frequent label of a doc_id counts, 0 if both are as frequent; one text stands for repeated rows."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "zzz qqq ") * 5) for i in range(40)] * 3, "doc_id long, text string")
    votes = [(i, i % 2) for i in range(40)] * 2 + [(i, 1 - i % 2) for i in range(40)]
    labels = spark.createDataFrame(votes, "doc_id long, quality int").withColumn("toxic", F.lit(0))
    got = op1_quality.classify(docs, labels).collect()
    assert len(got) == 120 and all(r["predicted"] == r["doc_id"] % 2 for r in got)
