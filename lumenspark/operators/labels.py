"""Blind label sheets over candidate pairs, and what comes back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.operators.split import shuffle_key, stratified
from lumenspark.plans.ranking import with_position
from lumenspark.sources.files import SHEET

# Similarity from, below, pairs with the same answer, pairs with another one.
PLAN = [
    (0.80, 0.88, 6, 10),
    (0.88, 0.92, 10, 12),
    (0.92, 0.95, 16, 14),
    (0.95, 0.97, 17, 16),
    (0.97, 0.98, 17, 16),
    (0.98, 0.99, 17, 16),
    (0.99, 1.0001, 17, 16),
]


def stratum(sim: Column, same_answer: Column, plan: list[tuple]) -> tuple[Column, Column]:
    """Name of a pair's stratum and how many pairs it wants; null outside of the plan's similarities."""
    name, wanted = F.lit(None).cast("string"), F.lit(None).cast("int")
    for low, high, n_same, n_other in plan:
        here = (sim >= low) & (sim < high)
        bin_ = f"{low:.2f}-{min(high, 1.0):.2f}"
        name = F.when(here, F.when(same_answer, f"{bin_}|same").otherwise(f"{bin_}|diff")).otherwise(name)
        wanted = F.when(here, F.when(same_answer, n_same).otherwise(n_other)).otherwise(wanted)
    return name, wanted


def draw(pairs: DataFrame, seed: int, plan: list[tuple] = PLAN) -> DataFrame:
    """Pairs picked per stratum, numbered from 1 in an order that tells the labeller nothing: the key to a sheet.

    pairs: a, b, sim, same_answer, without exact copies. The plan bounds the rows that are drawn. The weight of a pair
    is the number of pairs of its stratum for each one drawn.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
    name, wanted = stratum(F.col("sim"), F.coalesce("same_answer", F.lit(False)), plan)
    inside = pairs.withColumns({"stratum": name, "wanted": wanted}).filter("stratum is not null")
    picked = stratified(inside, "stratum", key, F.col("wanted"), seed, max(max(p[2:]) for p in plan)).withColumn("order", shuffle_key(key, seed + 1))
    numbered = with_position(picked, ["order", "a", "b"], parts)
    weight = F.col("population") / F.col("sampled")
    return numbered.select((F.col("position") + 1).alias("pair_id"), "a", "b", "sim", "same_answer", "stratum", "population", "sampled", weight.alias("weight"))


def sheet(drawn: DataFrame, records: DataFrame) -> DataFrame:
    """The sheet's columns for drawn pairs; neither similarity nor stratum shows. records: id, question, answer_text,
    gold_evidence, report_id."""
    own = records.select("id", F.col("question").alias("question"), F.col("answer_text").alias("answer"), F.array_join(F.transform("gold_evidence", lambda e: e["value"]), " ").alias("evidence"), F.col("report_id").alias("report"))
    side = lambda s: own.toDF(s, *[f"{s}_{c}" for c in own.columns[1:]])
    both = drawn.select("pair_id", "a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.withColumn(SHEET[1], F.lit("")).select(*[F.col(f"`{c}`") for c in SHEET])


def labelled(labels: DataFrame, drawn: DataFrame, records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Labelled pairs whose records are still there, with the similarity of the vectors as they are now.

    labels: pair_id, duplicate; records: id, args (sorted distinct program literals); vectors: id, embedding (unit).
    The weights stay those of the drawing. Pairs that lost a record go; lost_pairs() counts them.
    """
    side = lambda s: records.select("id", "args").join(vectors.select("id", "embedding"), "id").toDF(s, f"{s}_args", f"{s}_v")
    both = labels.join(drawn.drop("sim"), "pair_id").join(side("a"), "a").join(side("b"), "b")
    dot = F.aggregate(F.zip_with("a_v", "b_v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.select("pair_id", "a", "b", dot.alias("sim"), "same_answer", F.col("a_args").eqNullSafe(F.col("b_args")).alias("same_args"), "stratum", "weight", "duplicate")


def lost_pairs(labels: DataFrame, drawn: DataFrame, records: DataFrame) -> DataFrame:
    """Labelled pairs that name a record which is gone."""
    ids = records.select("id").distinct()
    named = labels.join(drawn.select("pair_id", "a", "b"), "pair_id")
    whole = named.join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")
    return named.join(whole.select("pair_id"), "pair_id", "left_anti")
