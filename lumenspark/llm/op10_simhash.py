"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprint: A-Z lower-cased, words are runs of characters other than ASCII white space, shingles are 3 words joined by
spaces (the whole sequence if there are fewer), repeats included; a bit is set if it is set in over half of the shingles'
XXH64 hashes (seed 42). No words: fingerprint 0, linked like any other.

Search: equal fingerprints are one class. Classes at 2 or fewer differing bits agree in two of four 16-bit blocks, so
each class goes to six buckets, one per pair of blocks; a bucket above SPLIT classes is dealt again by three parts of its
other 32 bits, one of which must agree, which leaves 2^22 fingerprints in a group at most. In a group, fingerprints are
sorted by Gray rank; runs of FANOUT neighbours become a node that holds the bits its members share, and so on upwards, so
that each bit of a fingerprint is held once on its path. A query walks down adding the differences on each node's own
bits, and drops a whole node when they exceed 2. Groups return a spanning forest, never all pairs.

Cases: a null text counts as empty; null doc_ids take part but name a component only if all its members lack an id;
repeated rows are copies of each other; an empty table gives no rows; other columns are kept by keep_one(), unread by
components().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.llm.batches import map_texts, runs, whole_groups
from lumenspark.operators.graph import connected_components
from lumenspark.plans.scratch import free_name, materialize, with_row_id

RADIUS = 2
SHINGLE = 3
SEED = 42
FANOUT = 8
SPLIT = 100_000
_BLOCKS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def shingles(text: str) -> list[bytes]:
    w = text.encode("utf-8", "replace").lower().split()
    if len(w) < SHINGLE:
        return [b" ".join(w)] if w else []
    return [*map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))]


def fingerprint(text: str) -> int:
    """Unsigned 64-bit fingerprint."""
    from xxhash import xxh64_intdigest

    s = shingles(text)
    if not s:
        return 0
    counts, n = np.zeros(64, np.int64), len(s)
    for i in range(0, n, 50_000):
        h = np.array([xxh64_intdigest(x, SEED) for x in s[i : i + 50_000]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and fp, the fingerprint as a signed long."""

    def run(texts: list[str]) -> list[list]:
        return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, keep, "text", [T.StructField("fp", T.LongType())], run)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchical index over distinct uint64 codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes))]
        mask, first = [np.full(len(codes), ~np.uint64(0))], [self.codes]
        while len(first[-1]) > FANOUT:
            at = np.arange(0, len(first[-1]), FANOUT)
            common = np.bitwise_and.reduceat(mask[-1], at)
            head = np.repeat(first[-1][at], np.diff(np.append(at, len(first[-1]))))
            common &= ~np.bitwise_or.reduceat(head ^ first[-1], at)
            mask.append(common)
            first.append(first[-1][at])
        # from the top down, a node keeps the shared bits that no node above it holds
        self.levels = []
        for level in range(len(mask)):
            above = np.repeat(mask[level + 1], FANOUT)[: len(mask[level])] if level + 1 < len(mask) else np.uint64(0)
            self.levels.append((first[level], mask[level] & ~above))

    def pairs(self, radius: int = RADIUS, chunk: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (a < b) in self.codes of codes at `radius` or fewer differing bits, by chunks of queries."""
        for begin in range(0, len(self.codes), chunk):
            asked = np.arange(begin, min(begin + chunk, len(self.codes)))
            top = len(self.levels[-1][0])
            q, node, acc = np.repeat(asked, top), np.tile(np.arange(top), len(asked)), np.zeros(len(asked) * top, np.uint8)
            for level in range(len(self.levels) - 1, -1, -1):
                code, own = self.levels[level]
                acc = acc + np.bitwise_count((self.codes[q] ^ code[node]) & own[node])
                near = acc <= radius
                q, node, acc = q[near], node[near], acc[near]
                if level:
                    size = len(self.levels[level - 1][0])
                    q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    # a child whose last code is before the query's place has been its partner's query
                    real = (node < size) & ((node + 1) * FANOUT ** (level - 1) > q)
                    q, node, acc = q[real], node[real], acc[real]
            yield q[q < node], node[q < node]


def forest(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, root) that connect what the index links."""
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for a, b in index.pairs():
        while True:  # merge the trees of both ends until all agree
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label != label[label]).any():
                label = label[label]
    moved = label != np.arange(len(codes))
    return index.codes[moved], index.codes[label[moved]]


def _native_gray(fp: F.Column) -> F.Column:
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _bits(fp: F.Column, shift: int, width: int) -> F.Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _buckets(classes: DataFrame, split: int) -> DataFrame:
    """(bucket, fp): six per class; those above `split` classes are dealt again by parts of their other bits."""
    fp = F.col("fp")
    keys = [F.struct(F.lit(i).alias("i"), F.shiftleft(_bits(fp, 16 * a, 16), 16).bitwiseOR(_bits(fp, 16 * b, 16)).alias("k")) for i, (a, b) in enumerate(_BLOCKS)]
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.i", "x.k")
    large = materialize(rows.groupBy("i", "k").count().filter(F.col("count") > split).select("i", "k"), "buckets")
    usual = rows.withColumn("s", F.lit(0).cast("long"))
    if not large.isEmpty():
        rest = F.lit(None).cast("long")
        for i, pair in enumerate(_BLOCKS):
            c, d = [x for x in range(4) if x not in pair]
            rest = F.when(F.col("i") == i, F.shiftleft(_bits(fp, 16 * c, 16), 16).bitwiseOR(_bits(fp, 16 * d, 16))).otherwise(rest)
        parts = F.array(*[F.shiftleft(F.lit(n + 1).cast("long"), 11).bitwiseOR(_bits(F.col("rest"), 11 * n, 11 if n < 2 else 10)) for n in range(3)])
        dealt = rows.join(large, ["i", "k"], "left_semi").withColumn("rest", rest).select("fp", "i", "k", F.explode(parts).alias("s"))
        usual = usual.join(large, ["i", "k"], "left_anti").unionByName(dealt)
    return usual.select(F.concat_ws("-", "i", "k", "s").alias("bucket"), "fp")


def links(classes: DataFrame, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, distinct) that connect all that differ in 2 or fewer bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "bucket"):
            keys = t.column("bucket").combine_chunks().dictionary_encode().indices.to_numpy()
            at, codes = runs(keys), t.column("fp").to_numpy().view(np.uint64)
            found = [forest(codes[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if j - i > 1]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _buckets(classes, split).repartition(n, "bucket").sortWithinPartitions("bucket", _native_gray(F.col("fp")))
    return dealt.select("bucket", "fp").mapInArrow(run, "a long, b long").distinct()


def class_components(prints: DataFrame, least: F.Column, split: int = SPLIT) -> DataFrame:
    """(fp, first): for each fingerprint the smallest `least` among its component's rows."""
    classes = materialize(prints.groupBy("fp").agg(least.alias("first")), "classes")
    comps = connected_components(links(classes.select("fp"), split)).toDF("fp", "root")
    rooted = materialize(classes.join(comps, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("best")), "root").select("fp", F.col("best").alias("first"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = materialize(fingerprints(docs, ["doc_id"]), "fingerprints")
    found = class_components(prints, F.min("doc_id"))
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id (nulls last), the first of equal rows."""
    row = free_name(docs, "row")
    numbered = with_row_id(docs, row)
    prints = materialize(fingerprints(numbered.select("doc_id", F.col(row).alias("row"), "text"), ["doc_id", "row"]), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    best = class_components(prints, F.min(order))
    kept = best.select(F.col("first.row").alias(row)).distinct()
    return numbered.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
