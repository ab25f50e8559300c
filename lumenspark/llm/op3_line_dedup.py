"""Line dedup with a suffix array over line-ID sequences, built by distributed prefix doubling.

A line's ID is the 128-bit hash of its text without outer white space. Lines that occur once can't be part of a repeated
run, so only repeated lines are ranked, and a sequence ends at a line that occurs once. Round k sorts the places by their
first 2^k lines: equal ranks are the intervals of the suffix array whose common prefix is 2^k lines long or longer, and
pairs of ranks (place, place + 2^k) give the next round's. Places whose prefix is unique leave the sort.

A run of l lines is named exactly by the ranks of its first and last 2^k lines (2^k <= l). Each place has two shortest
runs of MIN_WORDS words, one that begins there and one that ends there. The runs of one name are the interval of the suffix
array whose longest common prefix is as long as the run or longer: its first member by (doc_id, row, line) is the kept copy,
all others are later copies. A line goes if it stands in a later copy and in no kept copy of any run. So the kept copy of
every shortest run stays whole at its place, whatever overlaps it, and every passage of MIN_WORDS words that stood in several
places still stands in one. A longer repeated run loses its later copies through the shortest runs inside it; its own first copy
stays whole too, but for stretches whose shortest runs all stood somewhere before: those are kept there. A run that overlaps
its own first copy, as equal lines do, is cut behind that copy's end.

Doubling goes on to the longest shortest run, not to the longest repeat: whether a line goes depends on the intervals of
the shortest runs alone, and the members of an interval of a longer common prefix are among theirs. So the array ordered by
MIN_WORDS lines (a line counts as one word at least) decides as the whole one would, in log2(MIN_WORDS) rounds whatever the
length of the corpus or of its repeats.

Cases: a null text stays null and has no lines; an empty text is one empty line; null doc_ids come last in the order;
repeated rows are copies, so the later lose their runs; a document can lose all its lines and then has an empty text; an
empty table gives no rows; other columns are kept, names that clash with the ones used here included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.llm.batches import runs, slices, texts_of, whole_groups
from lumenspark.plans.ranking import with_position
from lumenspark.plans.scratch import free_name, materialize, with_row_id

MIN_WORDS = 20


def line_ids(numbered: DataFrame) -> DataFrame:
    """(row, doc_id, line, hi, lo, words): one row per line of the text."""
    from xxhash import xxh3_128_digest

    kind = numbered.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("line", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("hi", "lo")], T.StructField("words", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                cut = [t.split("\n") for t in texts_of(part.column("text"))]
                sizes = np.array([len(c) for c in cut])
                lines = [x for c in cut for x in c]
                ids = np.frombuffer(b"".join([xxh3_128_digest(x.strip().encode("utf-8", "replace")) for x in lines]), "<i8").reshape(-1, 2)
                owner = pa.array(np.repeat(np.arange(len(cut)), sizes))
                place = np.arange(len(lines)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                words = np.array([max(1, len(x.split())) for x in lines], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(owner), part.column("doc_id").take(owner), pa.array(place.astype(np.int32)), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(words)], names=schema.names
                )

    return numbered.filter(F.col("text").isNotNull()).select("row", "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _rank(places: DataFrame, keys: list[str], name: str, parts: int) -> DataFrame:
    """places whose `keys` occur at least twice, with `name`: the place of those keys in their sorted order."""
    repeated = places.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return places.join(with_position(repeated, keys, parts, name), keys)


def suffix_ranks(lines: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines with r0, r1 ...: rank of the place by its first 2^k lines, null where those are unique."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = ["row", "doc_id", "line", "words"]
    now = materialize(_rank(lines, ["hi", "lo"], "r0", parts).select(*base, "r0"), "ranks")
    k, span = 0, W.partitionBy("row").orderBy("line")
    while 2 ** (k + 1) <= min_words:
        step = 2**k
        ahead = now.withColumn("next", F.when(F.lead("line", step).over(span) == F.col("line") + step, F.lead(f"r{k}", step).over(span)))
        pairs = ahead.filter(f"r{k} is not null and next is not null")
        repeated = materialize(pairs.groupBy(f"r{k}", "next").agg(F.count("*").alias("n")).filter("n > 1").select(f"r{k}", "next"), "pairs")
        if repeated.isEmpty():
            break
        ranked = with_position(repeated, [f"r{k}", "next"], parts, f"r{k + 1}")
        now = materialize(ahead.join(ranked, [f"r{k}", "next"], "left").drop("next"), "ranks")
        k += 1
    return now


def shortest_runs(ranked: DataFrame, min_words: int) -> DataFrame:
    """(row, doc_id, line, size, a, b): the shortest runs of min_words words that may repeat, named by a, b and size."""
    levels = [f"r{k}" for k in range(len(ranked.columns)) if f"r{k}" in ranked.columns]
    kind = ranked.schema["doc_id"]
    schema = T.StructType([T.StructField("row", T.LongType()), kind, *[T.StructField(c, T.LongType()) for c in ("line", "size", "a", "b")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "row"):
            row, line, words = (t.column(c).to_numpy() for c in ("row", "line", "words"))
            rank = np.stack([t.column(c).fill_null(-1).to_numpy() for c in levels])
            n = len(row)
            breaks = np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1] + 1)])
            segment = np.cumsum(breaks)
            sums = np.concatenate([[0], np.cumsum(words)])
            begin = np.arange(n)
            end = np.searchsorted(sums, sums[:-1] + min_words)  # the run [begin, end) has the words
            back = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1  # [back, i] has them
            s = np.concatenate([begin[end <= n], back[back >= 0]])
            e = np.concatenate([end[end <= n], begin[back >= 0] + 1])
            fits = segment[s] == segment[e - 1]
            s, e = (x for x in np.unique(np.stack([s[fits], e[fits]]), axis=1))
            size = e - s
            level = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
            fits = level < len(levels)
            s, e, size, level = s[fits], e[fits], size[fits], level[fits]
            a, b = rank[level, s], rank[level, e - (1 << level)]
            fits = (a >= 0) & (b >= 0)
            at = pa.array(s[fits])
            yield pa.RecordBatch.from_arrays(
                [t.column("row").combine_chunks().take(at), t.column("doc_id").combine_chunks().take(at), *[pa.array(x[fits].astype(np.int64)) for x in (line[s], size, a, b)]], names=schema.names
            )

    dealt = ranked.select("row", "doc_id", "line", "words", *levels).repartition("row").sortWithinPartitions("row", "line")
    return dealt.mapInArrow(run, schema)


def copies(lines: DataFrame, min_words: int) -> DataFrame:
    """(row, line, size, kept): the members of every shortest run that repeats; `kept` marks the first by place."""
    found = materialize(shortest_runs(suffix_ranks(lines, min_words), min_words), "runs")
    # a line's place in the whole corpus is one number, so the first of a run is a plain minimum
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = lines.groupBy("row", "doc_id").agg(F.count("*").alias("n")).withColumn("none", F.col("doc_id").isNull())
    begins = with_position(sizes, ["none", "doc_id", "row"], parts, "begin", weight="n").select("row", "begin")
    found = found.join(begins, "row").select("row", "line", "size", "a", "b", (F.col("begin") + F.col("line")).alias("place"))
    firsts = materialize(found.groupBy("a", "b", "size").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    return found.join(firsts, ["a", "b", "size"]).select("row", "line", "size", (F.col("place") == F.col("first")).alias("kept"))


def _covered(begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n lines stand in one of the runs."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begin, 1)
    np.add.at(steps, begin + size, -1)
    return np.cumsum(steps[:-1]) > 0


def deletions(numbered: DataFrame, min_words: int) -> DataFrame:
    """(row, cuts): for each row that loses lines, the disjoint line ranges [first, last) that go."""
    found = copies(materialize(line_ids(numbered), "lines"), min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "row"):
            row, line, size = (t.column(c).to_numpy() for c in ("row", "line", "size"))
            kept = t.column("kept").to_numpy()
            at = runs(row)
            own, cuts = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                low, n = int(line[i:j].min()), int((line[i:j] + size[i:j]).max())
                first, later = kept[i:j], ~kept[i:j]
                gone = _covered(line[i:j][later] - low, size[i:j][later], n - low) & ~_covered(line[i:j][first] - low, size[i:j][first], n - low)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))) + low
                if len(edges):
                    own.append(row[i])
                    cuts.append(edges.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(cuts, pa.list_(pa.int64()))], names=["row", "cuts"])

    return found.repartition("row").sortWithinPartitions("row", "line").mapInArrow(run, "row long, cuts array<long>")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line, size, kept_doc_id, kept_line): the maximal repeated runs of lines and where their kept copies stand.

    A later copy of a shortest run lies a certain way behind its kept copy; overlapping ones that lie equally far behind
    theirs are one run, as long as it repeats what stands there. So each row is a whole stretch of lines that `size` lines
    from kept_line on repeat, and stretches that were first seen in different places are rows of their own.
    """
    row = free_name(docs, "row")
    numbered = with_row_id(docs, row).select(F.col(row).alias("row"), "doc_id", "text")
    lines = materialize(line_ids(numbered), "lines")
    found = materialize(shortest_runs(suffix_ranks(lines, min_words), min_words), "runs")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = lines.groupBy("row", "doc_id").agg(F.count("*").alias("n")).withColumn("none", F.col("doc_id").isNull())
    begins = materialize(with_position(sizes, ["none", "doc_id", "row"], parts, "begin", weight="n").select("row", "begin"), "begins")
    placed = found.join(begins, "row").withColumn("place", F.col("begin") + F.col("line"))
    firsts = placed.groupBy("a", "b", "size").agg(F.min("place").alias("first"), F.min_by(F.struct("row", "doc_id", "line"), "place").alias("kept"))
    later = placed.join(firsts, ["a", "b", "size"]).filter("place > first").withColumn("behind", F.col("place") - F.col("first"))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("line", T.LongType()), T.StructField("size", T.LongType()), T.StructField("kept_doc_id", kind), T.StructField("kept_line", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "row"):
            t = t.combine_chunks()
            row, behind, line, size = (t.column(c).to_numpy() for c in ("row", "behind", "line", "size"))
            picked, sizes, open_ = [], [], None
            for k in range(len(row)):
                if open_ == (row[k], behind[k]) and line[k] < line[picked[-1]] + sizes[-1]:
                    sizes[-1] = max(sizes[-1], int(line[k] + size[k] - line[picked[-1]]))
                else:
                    open_ = (row[k], behind[k])
                    picked.append(k)
                    sizes.append(int(size[k]))
            some = t.take(pa.array(picked, pa.int64()))
            arrays = [some.column(c).combine_chunks() for c in ("row", "doc_id", "line", "kept_doc_id", "kept_line")]
            yield pa.RecordBatch.from_arrays([*arrays[:3], pa.array(sizes, pa.int64()), *arrays[3:]], names=schema.names)

    dealt = later.select("row", "doc_id", "line", "size", "behind", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").cast("long").alias("kept_line"))
    dealt = dealt.repartition("row").sortWithinPartitions("row", "behind", "line")
    return dealt.mapInArrow(run, schema).drop("row")


def _gone(i: F.Column, cuts: str) -> F.Column:
    return F.exists(F.sequence(F.lit(0), F.size(cuts) - 2, F.lit(2)), lambda k: (i >= F.get(cuts, k)) & (i < F.get(cuts, k + 1)))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """docs without the lines of later copies that stand in no kept copy; with `counts` also n_lines and n_deleted."""
    row, cut = free_name(docs, "row"), free_name(docs, "cuts")
    numbered = with_row_id(docs, row)
    cuts = deletions(numbered.select(F.col(row).alias("row"), "doc_id", "text"), min_words).toDF(row, cut)
    both = numbered.join(cuts, row, "left")
    lines = F.split("text", "\n", -1)
    left = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~_gone(i, cut)), "\n"))
    own = [left.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        deleted = F.aggregate(F.coalesce(cut, F.array().cast("array<long>")), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda acc, x: F.struct((acc["n"] + x * acc["s"]).alias("n"), (-acc["s"]).alias("s")), lambda acc: acc["n"])
        own += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), deleted.alias("n_deleted")]
    return both.select(*own)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted and the SHA-256 of what stays of each document."""
    return dedup(docs.select("doc_id", "text"), min_words, counts=True).select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
