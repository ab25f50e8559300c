"""Source divergence audit: which sources of a language differ most, and by which terms.

Terms are counted per (language, source), first within a slice of texts, then by partial aggregation. Each language keeps
the terms of at least 10 of its documents. A kept term's column of counts, one number per source, is kept sparse: the
sources that have it and how often. Equal columns give equal values for every pair of sources, so columns are grouped by
(language, column) and counted; every pair is evaluated once per distinct column and multiplied by how many terms have it.
Of a column only pairs with a source that has the term are evaluated: all other pairs have the same value in every column,
which follows from their totals. Then the original terms of each group are ranked.

Sums of pairs are kept in a matrix per language and task for a block of at most BLOCK x BLOCK groups, 16 bytes a pair, so
what a task holds and what is broadcast (the blocks' names and totals) is bounded. More groups need a scan of the distinct
columns for each pair of blocks that share a language; the result has a row for every pair too. All arithmetic is in whole
numbers, exact to 9 * 10^15 terms a language.

Cases: null text, lang and source count as ''; a group without terms still has its pairs, and their value is 0 in a language
that keeps no term; documents are rows, so repeated rows count again and null or equal doc_ids make no difference; equal
values are ranked by item in the order of UTF-8 bytes; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspark.llm.batches import slices
from lumenspark.plans.ranking import with_position
from lumenspark.plans.scratch import materialize

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK = 2048
_CELLS = 2_000_000

# the bytes of a term, A to Z in lower case; all others become a space
_TERM = np.full(256, 32, np.uint8)
_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
_TERM[0x80:] = np.arange(0x80, 0x100)


def _pieces(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of some texts, and for each place of a term its number and that of its text."""
    text = pa.concat_arrays([text.fill_null("")])
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = pa.StringArray.from_buffers(len(text), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_TERM[data]))
    cut = pc.split_pattern(plain, " ")
    found = cut.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(text)), np.diff(cut.offsets.to_numpy()))
    codes = found.indices.to_numpy().astype(np.int64)
    real = codes != pc.index(found.dictionary, "").as_py()
    return found.dictionary, codes[real], owner[real]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text"), 4_000_000):
                part = b.slice(i, j - i)
                terms, codes, owner = _pieces(part.column("text"))
                if not len(codes):
                    continue
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                k = len(terms)
                pairs, times = np.unique(owner * k + codes, return_counts=True)  # document and term
                cells, at, n_docs = np.unique(group[pairs // k] * k + pairs % k, return_inverse=True, return_counts=True)
                n = np.zeros(len(cells), np.int64)
                np.add.at(n, at, times)
                g = cells // k
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), terms.take(pa.array(cells % k)), pa.array(n), pa.array(n_docs.astype(np.int64))],
                    names=["lang", "source", "term", "n", "docs"],
                )

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, column): each kept term's occurrences and its column, an array of (source, n) in order of source."""
    column = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column")
    return term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), column).filter(F.col("docs") >= least_docs).drop("docs")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / whole), exact."""
    product = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", product, whole.cast("decimal(19,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """share() for arrays: long division by three digits of base 1,000, so that no product leaves 64 bits."""
    out, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


class _Sums:
    """Sums over columns for the pairs of two blocks of groups: values, and the number of terms that they stand for.

    A block maps a language to its sources' names and totals. Pairs of a block with itself are summed up once, under the
    source that has the term, or under the first of both if both have it.
    """

    def __init__(self, a: dict, b: dict, same: bool):
        self.a, self.b, self.same = a, b, same
        self.place = [{(lang, s): i for lang, (names, _) in x.items() for i, s in enumerate(names)} for x in (a, b)]
        self.sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _counts(self, lang: str, side: int, row: np.ndarray, source: list, n: np.ndarray, rows: int) -> np.ndarray:
        """Counts as a rows x sources array; -1 where the source hasn't the term."""
        place, out = self.place[side], np.full((rows, len((self.a, self.b)[side][lang][0])), -1, np.int64)
        at = np.array([place.get((lang, s), -1) for s in source], np.int64)
        out[row[at >= 0], at[at >= 0]] = n[at >= 0]
        return out

    def add(self, lang: str, row: np.ndarray, source: list, n: np.ndarray, times: np.ndarray) -> None:
        if lang not in self.a or lang not in self.b:
            return
        a = self._counts(lang, 0, row, source, n, len(times))
        b = a if self.same else self._counts(lang, 1, row, source, n, len(times))
        pa_, pb = (shares(np.maximum(x, 0), whole[lang][1]) for x, whole in ((a, self.a), (b, self.b)))
        values, terms = self.sums.setdefault(lang, tuple(np.zeros((a.shape[1], b.shape[1]), np.int64) for _ in range(2)))

        def side(have: np.ndarray, p: np.ndarray, other: np.ndarray, q: np.ndarray, skip, into, count) -> None:
            for s in np.flatnonzero((have >= 0).any(axis=0)).tolist():
                rows = np.flatnonzero(have[:, s] >= 0)
                d = p[rows, s][:, None] - q[rows]
                f = d * d // (p[rows, s][:, None] + q[rows])
                use = ~((other[rows] >= 0) & skip(s))
                into[s] += times[rows] @ np.where(use, f, 0)
                count[s] += times[rows] @ use.astype(np.int64)

        every = np.arange(b.shape[1])
        if self.same:
            side(a, pa_, a, pa_, lambda s: every <= s, values, terms)
        else:
            side(a, pa_, b, pb, lambda s: np.zeros(len(every), bool), values, terms)
            side(b, pb, a, pa_, lambda s: np.ones(a.shape[1], bool), values.T, terms.T)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lang, (values, terms) in self.sums.items():
            s, t = np.nonzero(terms)
            for i in range(0, len(s), 100_000):
                x, y = s[i : i + 100_000], t[i : i + 100_000]
                if self.same:
                    x, y = x[x != y], y[x != y]
                names = [pa.array(block[lang][0], pa.string()).take(pa.array(z)) for block, z in ((self.a, x), (self.b, y))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), *names, pa.array(values[x, y]), pa.array(terms[x, y])], names=["lang", "source", "item", "value", "terms"])


def pair_sums(columns: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value, terms): for pairs in one order or both, partial sums over terms that one of both has.

    columns: lang, column, times; groups: lang, source, whole (the group's N + 2 V), a row for each group.
    """
    spark = columns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(with_position(groups.select("lang", "source", "whole"), ["lang", "source"], parts, "place").withColumn("block", F.floor(F.col("place") / block)), "groups")
    ends = placed.groupBy("block").agg(F.min("lang").alias("first"), F.max("lang").alias("last")).orderBy("block").collect()  # a row for 2,048 groups
    schema = "lang string, source string, item string, value long, terms long"
    columns = columns if len(ends) <= 1 else materialize(columns, "columns")

    def load(k: int) -> dict:
        out: dict[str, tuple[list, list]] = {}
        for r in placed.filter(F.col("block") == k).orderBy("place").collect():
            names, wholes = out.setdefault(r["lang"], ([], []))
            names.append(r["source"])
            wholes.append(r["whole"])
        return {lang: (names, np.array(wholes, np.int64)) for lang, (names, wholes) in out.items()}

    def one(x: int, y: int) -> DataFrame:
        shared = spark.sparkContext.broadcast((load(x), load(y) if x != y else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = shared.value
            sums = _Sums(a, a if b is None else b, b is None)
            widest = max(len(names) for block in (a, b or a) for names, _ in block.values())
            for batch in batches:
                for begin in range(0, batch.num_rows, step := max(1, _CELLS // widest)):
                    part = batch.slice(begin, step)
                    langs = part.column("lang").dictionary_encode()
                    code, times, column = langs.indices.to_numpy(), part.column("times").to_numpy(), part.column("column")
                    cells, sizes = column.flatten(), pc.list_value_length(column).to_numpy()
                    row, source, n = np.repeat(np.arange(len(times)), sizes), np.array(cells.field("source").to_pylist(), object), cells.field("n").to_numpy()
                    for k, lang in enumerate(langs.dictionary.to_pylist()):
                        own = np.flatnonzero(code == k)
                        back = np.full(len(times), -1, np.int64)
                        back[own] = np.arange(len(own))
                        use = back[row] >= 0
                        sums.add(lang, back[row[use]], source[use].tolist(), n[use], times[own])
            yield from sums.batches()

        out = columns.mapInArrow(run, schema)
        if len(ends) <= 1:
            return out
        stored = materialize(out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")), "pairs")
        shared.destroy()
        return stored

    found = [one(x["block"], y["block"]) for i, x in enumerate(ends) for y in ends[i:] if x is y or x["last"] == y["first"]]
    out = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows rank all other sources of the language by divergence, `term` rows
    the terms that a source has more of than its language, the first `top_terms` of them."""
    kept = materialize(kept_terms(docs, least_docs), "kept")
    cells = kept.select("lang", "term", F.col("n").alias("total"), F.inline("column"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    known = every.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0)
    groups = materialize(known.select("lang", "source", "v", (F.col("own_n") + 2 * F.col("v")).alias("whole"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_whole")), "groups")

    columns = kept.groupBy("lang", "column").agg(F.count("*").alias("times"))
    one_way = pair_sums(columns, groups.filter("v > 0"), block)
    both = one_way.select("lang", "value", "terms", F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))))
    summed = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("whole").alias("item_whole"))
    pairs = groups.join(other, "lang").filter("source <> item").join(summed, ["lang", "source", "item"], "left").fillna(0, ["value", "terms"])
    none = F.lit(0).cast("long")
    rest = (F.col("v") - F.col("terms")) * distance(share(none, F.col("whole")), share(none, F.col("item_whole")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, F.col("value") + rest).otherwise(0).alias("value"))

    with_p = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("whole")).alias("p"), share(F.col("total"), F.col("lang_whole")).alias("q"))
    terms = with_p.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top_terms))
