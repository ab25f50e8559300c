"""Similarity joins, duplicate rules and their calibration, contamination and survivors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.operators import nearest
from lumenspark.operators.graph import connected_components
from lumenspark.plans.ranking import running_sums, with_position
from lumenspark.plans.scratch import materialize

# Detector rules in order of strictness, and the threshold grid.
RULES = ["similarity", "similarity+same_answer", "similarity+same_answer+same_args"]
BLOCK = 8192
TILE = 1 << 20


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _closest(x: np.ndarray, ids: pa.Array, k: int, rows: Iterator[tuple[pa.Array, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the queries x (ids): place in the ids returned last, and similarity (-inf: none), of the k best of all rows (ids, v).

    Queries meet rows in tiles of about TILE numbers, so memory doesn't grow with either. A tile's product only picks the
    rows that may be among the best; these are compared again, number by number in one order, so that equal vectors have
    equal similarities wherever they stand.
    """
    sims, found, names = np.full((len(x), k), -np.inf), np.full((len(x), k), -1), ids.slice(0, 0)
    for own, v in rows:
        same = pc.fill_null(pc.index_in(own, ids.unique()), -1).to_numpy(), pc.index_in(ids, ids.unique()).to_numpy()
        base, names = len(names), pa.concat_arrays([names, own])
        wide = max(k, min(len(own), 2048))
        for c in range(0, len(own), wide):
            some = v[c : c + wide]
            for q in range(0, len(x), step := max(1, TILE // wide)):
                s = x[q : q + step] @ some.T
                a, b = same[0][c : c + wide], same[1][q : q + step]
                mine = np.flatnonzero((a >= b.min()) & (a <= b.max()))
                s[:, mine] = np.where(a[mine] == b[:, None], -np.inf, s[:, mine])
                least = sims[q : q + step, -1]
                if s.shape[1] > k and np.isinf(least).any():
                    s = np.where(np.isnan(s), -np.inf, s)
                    least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
                i, j = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
                if not len(i):
                    continue
                length = max(1, TILE // x.shape[1])
                exact = np.concatenate([(x[q + i[o : o + length]] * some[j[o : o + length]]).sum(axis=1) for o in range(0, len(i), length)])
                # what is kept and what is new, the best of each query first
                held = np.argwhere(found[q : q + step] >= 0)
                query = np.concatenate([held[:, 0], i])
                sim = np.concatenate([sims[q + held[:, 0], held[:, 1]], exact])
                at = np.concatenate([found[q + held[:, 0], held[:, 1]], base + c + j])
                touched = np.isin(query, i)
                query, sim, at = query[touched], sim[touched], at[touched]
                rank = np.empty(len(at), np.int64)
                rank[pc.sort_indices(names.take(pa.array(at))).to_numpy()] = np.arange(len(at))
                order = np.lexsort((rank, -sim, query))
                query, sim, at = query[order], sim[order], at[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                query, sim, at, place = (z[place < k] for z in (query, sim, at, place))
                sims[q + query, place], found[q + query, place] = sim, at
        used = np.unique(found[found >= 0])
        names, found = names.take(pa.array(used)), np.where(found < 0, -1, np.searchsorted(used, found))
    return found, sims, names


def neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, sim, rank): the k most similar other rows b of every query row a, ties by b.

    vectors: id, embedding, of unit length; queries: the rows to ask for, all of them if it isn't given. Exact, as a
    stated set of rows against all rows in blocks: `block` queries, a few MB, are broadcast at a time, every task keeps
    their k best among its own rows, and a window ranks what the tasks keep. Rows are dealt out to all cores once; the work
    is queries x rows, so ask for a part of very large tables. Each block's result is stored before the next one runs.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("v"))
    asked = (vectors if queries is None else queries).select("id", F.col("embedding").cast("array<double>").alias("v"))
    blocks = -(-asked.count() // block)
    asked = with_position(asked, ["id"], parts, "place") if blocks > 1 else asked.withColumn("place", F.lit(0))
    # stored as files of whole splits, for one after the other would be read by one task
    rows = materialize(rows.repartition(max(parts, spark.sparkContext.defaultParallelism), "id"), "rows") if blocks > 1 else rows.repartition(spark.sparkContext.defaultParallelism)
    kind = vectors.schema["id"].dataType.simpleString()
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))

    def one(number: int) -> DataFrame:
        got = asked.filter(F.floor(F.col("place") / block) == number).select("id", "v").toArrow()
        shared = spark.sparkContext.broadcast((got.column("id").combine_chunks(), got.column("v").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            filled = ((b.column("id"), b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows)
            found, sims, names = _closest(x, ids, k, filled)
            at, _ = np.nonzero(real := found >= 0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), names.take(pa.array(found[real])), pa.array(sims[real])], names=["a", "b", "sim"])

        near = rows.mapInArrow(best, f"a {kind}, b {kind}, sim double").withColumn("rank", rank).filter(F.col("rank") <= k)
        if blocks == 1:
            return near
        stored = materialize(near, "neighbours")
        shared.destroy()
        return stored

    if not blocks:
        return spark.createDataFrame([], f"a {kind}, b {kind}, sim double, rank int")
    return reduce(DataFrame.unionAll, [one(i) for i in range(blocks)])


def neighbour_pairs(vectors: DataFrame, k: int = 5, block: int = BLOCK, indexed: bool = False) -> DataFrame:
    """(a, b, sim) with a < b, once each, of every row's k neighbours.

    vectors: id, embedding, is_test. Test rows compete for places; pairs of two test rows go after the ranking. Small tables
    are compared in blocks; with `indexed`, an index rules out most pairs of large ones whose rows have near neighbours.
    """
    if indexed:
        rows = vectors.select("id", "embedding")
        near = nearest.search(nearest.build(rows), rows, k)
    else:
        near = neighbours(vectors.select("id", "embedding"), k, block=block)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    test = vectors.select(F.col("id"), "is_test")
    both = pairs.join(test.toDF("a", "a_test"), "a").join(test.toDF("b", "b_test"), "b")
    return both.filter(~(F.col("a_test") & F.col("b_test")))


def rule_fires(rule: Column, sim: Column, threshold: Column, same_answer: Column, same_args: Column) -> Column:
    enough = F.when(rule == RULES[0], F.lit(True)).when(rule == RULES[1], same_answer).otherwise(same_answer & same_args)
    return (sim >= threshold) & enough


def _rule_weights(labels: DataFrame) -> list[Column]:
    """For each rule, the weights of the duplicates (hit) and of the others (miss) that it may fire on."""
    same = [F.lit(True), F.coalesce("same_answer", F.lit(False)), F.coalesce("same_answer", F.lit(False)) & F.coalesce("same_args", F.lit(False))]
    return [F.sum(F.when(rule & (F.col("duplicate") == dup), F.col("weight")).otherwise(0.0)).alias(f"{name}{i}") for i, rule in enumerate(same) for name, dup in (("hit", True), ("miss", False))]


def _ratios(tp: Column, fp: Column, positives: Column, digits: int) -> list[Column]:
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, positives), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f1, digits).alias("f1")]


def _by_rule(sums: DataFrame, positives: DataFrame, digits: int) -> DataFrame:
    rules = F.array(*[F.struct(F.lit(i).alias("rule_index"), F.lit(r).alias("rule"), F.col(f"hit{i}").alias("tp"), F.col(f"miss{i}").alias("fp")) for i, r in enumerate(RULES)])
    rows = sums.select("threshold", F.inline(rules)).crossJoin(positives)  # one row
    return rows.select("rule_index", "rule", "threshold", *_ratios(F.col("tp"), F.col("fp"), F.col("positives"), digits))


def _positives(labels: DataFrame) -> DataFrame:
    return labels.agg(F.coalesce(F.sum(F.when(F.col("duplicate"), F.col("weight"))), F.lit(0.0)).alias("positives"))


def threshold_sweep(labels: DataFrame, digits: int = 6) -> DataFrame:
    """rule_index, rule, threshold, precision, recall, f1 of every rule at every similarity that occurs, as its threshold.

    labels: sim, same_answer, same_args, weight, duplicate. Labels are summed up by similarity, and running sums from the
    highest down give all thresholds at once: one sort of the distinct similarities, however many there are. Labels without
    a similarity are never hit, but count for recall; a null rule condition doesn't hold.
    """
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_sim = labels.filter("sim is not null").groupBy(F.col("sim").cast("double").alias("threshold")).agg(*_rule_weights(labels))
    names = [f"{n}{i}" for i in range(len(RULES)) for n in ("hit", "miss")]
    return _by_rule(running_sums(by_sim, [F.desc("threshold")], names, parts), _positives(labels), digits)


def detector_grid(labels: DataFrame, thresholds: list[float]) -> DataFrame:
    """Weighted precision, recall and F1 of every rule at each of a few thresholds.

    labels: sim, same_answer, same_args, weight, duplicate. Each label is summed up once, in the band between two
    thresholds; what lies at or above a threshold is then the sum of a few bands.
    """
    levels = sorted({float(t) for t in thresholds})
    reached = F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t <= F.col("sim").cast("double")))
    bands = labels.filter("sim is not null").groupBy(reached.alias("band")).agg(*_rule_weights(labels))
    grid = labels.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(levels)], "level int, threshold double")
    names = [f"{n}{i}" for i in range(len(RULES)) for n in ("hit", "miss")]
    met = grid.join(F.broadcast(bands), F.col("band") >= F.col("level"), "left")  # one row a threshold at most
    sums = met.groupBy("threshold").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
    return _by_rule(sums, _positives(labels), 3)


def best_detector(grid: DataFrame) -> DataFrame:
    """The highest rounded F1; among equals the stricter rule, then the higher threshold."""
    top = F.max(F.struct("f1", "rule_index", "threshold", "rule", "precision", "recall")).alias("x")
    return grid.agg(top).select("x.rule", "x.threshold", "x.precision", "x.recall", "x.f1")


def star_edges(rows: DataFrame, key: str, id: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """(a, b): the first row of every key to each other row of it. Groups are summed up first, so a hot key is no window."""
    firsts = rows.groupBy(key).agg(F.min(F.struct(ordinal, id)).alias("f"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(firsts.select(key, F.col(f"f.{id}").alias("a")), key).filter(F.col("a") != F.col(id)).select("a", F.col(id).alias("b"))


def extra_copies(rows: DataFrame, key: str, test: str | None = None) -> DataFrame:
    """n: rows beyond the first of each key; with `test`, of keys without a test row."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(F.col(test) if test else F.lit(False)).alias("t"))
    return groups.filter("n > 1 and not t").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))


def apply_edges(rows: DataFrame, edges: DataFrame, spread: bool = False) -> DataFrame:
    """status of every pool row: contaminated (an edge to a test row), duplicate (not the smallest id of what is left of
    its component) or kept.

    rows: id, is_test; edges: a, b. Components are built over the edges among pool rows before contaminated rows go, so
    those still connect others. With `spread`, a component with a contaminated row is contaminated as a whole.
    """
    test = rows.select("id", "is_test")
    sides = materialize(edges.join(test.toDF("a", "ta"), "a").join(test.toDF("b", "tb"), "b").select("a", "b", "ta", "tb"), "edges")
    cross = sides.filter("ta <> tb").select(F.when(F.col("ta"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct().withColumn("bad", F.lit(True))
    comps = connected_components(sides.filter("not ta and not tb").select("a", "b")).toDF("id", "component")
    pool = rows.filter("not is_test").join(comps, "id", "left").join(cross, "id", "left")
    pool = pool.withColumns({"component": F.coalesce("component", "id"), "bad": F.coalesce("bad", F.lit(False))})
    kept = pool.groupBy("component").agg(F.min(F.when(~F.col("bad"), F.col("id"))).alias("keeper"), F.max("bad").alias("any_bad"))
    bad = F.col("any_bad") if spread else F.col("bad")
    status = F.when(bad, "contaminated").when(F.col("id") == F.col("keeper"), "kept").otherwise("duplicate")
    return pool.join(kept, "component").select(*[c for c in rows.columns], "component", status.alias("status"))


def stale(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """ids that only one of rows and vectors has; empty if the vectors belong to the rows."""
    return rows.select("id").join(vectors.select("id"), "id", "left_anti").union(vectors.select("id").join(rows.select("id"), "id", "left_anti"))


#: The automaton of the block that this worker has searched last, by the block's name.
_automata: dict[str, object] = {}


def _automaton(name: str, items: list[str]):
    if name not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for x in items:
            made.add_word(x)
        made.make_automaton()
        _automata.clear()
        _automata[name] = made
    return _automata[name]


def _hits(texts: pa.Array, search, everything: bool) -> pa.Array:
    """Which texts hold an item; one text at a time, for as Python strings a batch takes up to four times its bytes again."""
    return pa.array([t is not None and (everything or next(search(t), None) is not None) for t in (x.as_py() for x in texts)], pa.bool_())


def holding(docs: DataFrame, items: DataFrame, max_bytes: int = 8_000_000) -> DataFrame:
    """doc_id of the documents (doc_id, text) that hold the text of an item (item) whole, once each.

    Items are cut into blocks by their measured sizes: at most `max_bytes` of text, or a single item above that. One block
    at a time is broadcast, made into an automaton once per worker, searched for in a scan of all documents, and dropped
    before the next; its hits are stored. An empty item is in every text; null items and texts match nothing.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = items.select("item").filter("item is not null").distinct().withColumn("bytes", F.octet_length("item").cast("long"))
    sized = materialize(sized, "items")
    small, large = sized.filter(F.col("bytes") <= max_bytes // 2), sized.filter(F.col("bytes") > max_bytes // 2)
    told = sized.agg(F.sum("bytes").alias("total"), F.count("*").alias("n"), F.max(F.when(F.col("bytes") <= max_bytes // 2, F.col("bytes"))).alias("longest")).first()
    if (told["total"] or 0) <= max_bytes:
        placed, blocks = sized.withColumn("block", F.lit(0)), [0] if told["n"] else []
    else:
        # what begins in a range of the running size reaches beyond it by less than the longest item; others go alone
        packed = with_position(small, ["item"], parts, "before", weight="bytes").select("item", F.floor(F.col("before") / max(1, max_bytes - (told["longest"] or 0))).alias("block"))
        alone = with_position(large, ["item"], parts, "at").select("item", (-1 - F.col("at")).alias("block"))
        placed = materialize(packed.unionByName(alone), "items")
        blocks = [r["block"] for r in placed.select("block").distinct().orderBy("block").collect()]  # two rows for max_bytes at most
    kind = docs.schema["doc_id"]

    def one(block: int) -> DataFrame:
        some = [r["item"] for r in placed.filter(F.col("block") == block).collect()]
        name = uuid.uuid4().hex
        shared = spark.sparkContext.broadcast([x for x in some if x])
        everything = "" in some

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _automaton(name, shared.value).iter if shared.value else lambda text: iter(())
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0).filter(_hits(b.column(1), search, everything))], names=["doc_id"])

        found = docs.select("doc_id", "text").mapInArrow(scan, T.StructType([kind]))
        if len(blocks) == 1:
            return found
        found = materialize(found.distinct(), "hits")
        shared.destroy()
        return found

    if not blocks:
        return docs.select("doc_id").limit(0)
    return reduce(DataFrame.unionAll, [one(b) for b in blocks]).distinct()


def embed(df: DataFrame, encoder, text: str = "text", dim: int = 64) -> DataFrame:
    """id and embedding from a pluggable encoder(list of texts) -> float array [n, dim], rows made unit vectors."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.asarray(encoder(b[text].fillna("").tolist()), np.float64).reshape(len(b), -1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": b["id"], "embedding": list(v.astype(np.float32))})

    return df.select("id", text).mapInPandas(run, f"id {kind}, embedding array<float>")
