"""The classifier's indicators against plain Python, in blocks of any size, and which labelled documents it learns from."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lumenspark.llm import op1_quality as op


def plain(text):
    """Positions by lists and whole numbers."""
    data = list(text.encode("utf-8", "replace"))
    kind = lambda c: ord("A") if c < 128 and chr(c).isupper() else ord("a") if c > 127 or chr(c).islower() else ord("0") if chr(c).isdigit() else ord(" ") if chr(c).isspace() else c
    classes = [k for i, k in enumerate(map(kind, data)) if not i or k != kind(data[i - 1])]
    words = bytes(data).split()
    same = [int(x == y) for x, y in zip(words, words[1:])]
    out = set()
    for stream, orders, salt in ((data, (2, 3, 4), 0), (classes, (2, 3, 4, 5, 6), 16), (same if any(same) else [], (1, 2, 3, 4, 5), 32)):
        for n in orders:
            for i in range(len(stream) - n + 1):
                g = int.from_bytes(bytes(stream[i : i + n]), "big")
                out.add(((g + ((salt + n) << 56)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - op.BITS))
    return sorted(out)


def test_blocks_give_the_same_positions():
    rng = np.random.default_rng(0)
    letters = [*"abc AB  .,0\n", "é", "漢", " x x ", " a a a", "\t"]
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        want = plain(text)
        for block in (1, 2, 3, 7, 20, op.BLOCK):
            assert op.features(text, block).tolist() == want, (text, block)


def test_a_long_text_takes_little_memory():
    text = "Some words words of a text, " * 400_000
    tracemalloc.start()
    found = op.features(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 11_000_000 and peak < 40_000_000 and found.tolist() == op.features(text[:100_000]).tolist()


def test_labels_of_absent_documents(spark):
    """Labels of a whole corpus over a part of it: those of the part count, however many others there are."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "zzz qqq ") * 5) for i in range(60)], "doc_id long, text string")
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    got = op.classify(docs, labels, max_rows=40).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_positions_cut_by_whole_rows(spark):
    """With room for few positions a class keeps its first document; later ones that would fit don't come in."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "zzz qqq ") * (1 + i % 7) + f"x{i}" * (i % 5)) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    order = [r["doc_id"] for r in docs.filter(~op.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    whole = op.fit
    op.fit = lambda rows, y: seen.append(sorted((k, r.tolist()) for k, r in zip(y, rows))) or whole(rows, y)
    try:
        op.train(docs, labels, max_positions=150)
    finally:
        op.fit = whole
    want = []
    for k in (0, 1):
        held = 0
        for i in [i for i in order if i % 2 == k]:
            f = op.features(text[i]).tolist()
            if held and held + len(f) > 150:
                break
            held += len(f)
            want.append((k, f))
    assert seen == [sorted(want)] and len(want) < len(order)
