"""Leakage-free splits, stratified samples and reproducible orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspark.plans.ranking import with_position


def shuffle_key(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys, the same in any engine that has MD5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def group_key(*parts: Column) -> Column:
    """Parts joined by /, a null as None, so that it is a group of its own."""
    return F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def greedy_split(rows: DataFrame, group: str, sizes: list[tuple[str, int]], rest: str, seed: int) -> DataFrame:
    """(group, n, split): shuffled groups fill the first split until it has its size, then the next one; never cut.

    A prefix sum over groups would be one task's sort. Only groups near the front can matter: a split is full after at
    most `size` groups, so the first sum(sizes) groups in shuffled order, a fixed number, decide all but `rest`.
    """
    groups = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("place", shuffle_key(F.col(group), seed))
    front = groups.orderBy("place", group).limit(sum(n for _, n in sizes))
    order = W.orderBy("place", group)
    placed = front.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("split", F.lit(None).cast("string"))
    offset = F.lit(0).cast("long")
    for name, size in sizes:
        here = F.col("split").isNull() & (F.col("before") - offset < size)
        placed = placed.withColumn("split", F.when(here, F.lit(name)).otherwise(F.col("split")))
        offset = offset + F.sum(F.when(F.col("split") == name, F.col("n")).otherwise(0)).over(W.partitionBy())
    return groups.join(F.broadcast(placed.select(group, "split")), group, "left").select(group, "n", F.coalesce("split", F.lit(rest)).alias("split"))


def split_overlap(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """(a, b, n): keys that two splits share, nulls being equal to nulls."""
    seen = rows.select(split, F.struct(*keys).alias("k")).distinct()
    pairs = seen.groupBy("k").agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)  # few splits
    both = pairs.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def stratified(rows: DataFrame, stratum: str, key: Column, n: int | Column, seed: int, most: int | None = None) -> DataFrame:
    """n rows of every stratum in shuffled order, with population and sampled.

    `most`: what n is at most, if it is a column. The literal limit lets Spark drop all but so many rows of a stratum in
    each partition before the shuffle, so that a hot stratum isn't sorted in one task.
    """
    most = n if isinstance(n, int) else most
    n = F.lit(n) if isinstance(n, int) else n
    order = W.partitionBy(stratum).orderBy(shuffle_key(key, seed), key)
    picked = rows.withColumn("place", F.row_number().over(order))
    picked = (picked.filter(F.col("place") <= most) if most is not None else picked).filter(F.col("place") <= n)
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("population"))
    return picked.join(sizes, stratum).withColumn("sampled", F.least(F.col("population"), n))


def proportional(rows: DataFrame, stratum: str, key: str, total: int, seed: int) -> DataFrame:
    """About `total` rows by each stratum's share, rounded half to even, then cut to `total` in stratum order."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("population"))
    every = sizes.agg(F.sum("population")).first()[0] or 0
    wanted = sizes.withColumn("wanted", F.bround(F.lit(float(total)) * F.col("population") / F.lit(float(max(1, every)))).cast("int"))
    order = W.partitionBy(stratum).orderBy(shuffle_key(F.col(key), seed), key)
    few = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= total)  # a literal, pushed below the shuffle
    picked = few.join(wanted.select(stratum, "wanted"), stratum).filter(F.col("place") <= F.col("wanted"))
    return picked.orderBy(stratum, "place").limit(total).drop("wanted")


def source_split(pairs: DataFrame, source: str, fraction: float, seed: int) -> DataFrame:
    """side of every pair: val for max(1, int(share)) shuffled sources, train for the others."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = pairs.select(source).distinct().withColumn("__key", shuffle_key(F.col(source), seed))
    placed = with_position(sources, ["__key", source], parts, "__place")
    n = max(1, int(placed.count() * fraction))
    chosen = placed.filter(F.col("__place") < n).select(source, F.lit("val").alias("side"))
    return pairs.join(chosen, source, "left").withColumn("side", F.coalesce("side", F.lit("train")))


def batch_seed(seed: int, ids: Column) -> Column:
    """Aggregate: seed + sum(crc32(id)) mod 2^31, so that a resumed run draws the same samples."""
    return F.lit(seed) + F.pmod(F.sum(F.crc32(ids.cast("string"))), F.lit(1 << 31))
