"""Preference pairs from several sampled outputs per prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspark.functions.text import strip
from lumenspark.operators.split import shuffle_key
from lumenspark.plans.ranking import with_position
from lumenspark.plans.scratch import materialize


def distinct_outputs(samples: DataFrame) -> DataFrame:
    """One row per prompt and distinct stripped output, the first of each; blank ones go. samples: id, samples array."""
    rows = samples.select("id", F.posexplode("samples").alias("pos", "s")).select("id", "pos", "s.*").withColumn("text", strip(F.col("output")))
    first = W.partitionBy("id", "text").orderBy("pos")
    return rows.filter("text <> ''").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "text")


def outcomes(samples: DataFrame) -> DataFrame:
    """(label, n): prompts by how many of their samples are right."""
    c = F.size(F.filter("samples", lambda s: s["correct"]))
    return samples.groupBy(F.concat(F.lit("correct_"), c.cast("string"), F.lit("_of_"), F.size("samples").cast("string")).alias("label")).agg(F.count("*").alias("n"))


def build_pairs(samples: DataFrame, prompts: DataFrame, target: int, seed: int) -> DataFrame:
    """Up to two pairs a prompt: wrong outputs that commit to an answer line first, each against a right output, or the
    reference where there is none; second pairs only as far as first ones leave room below `target`.

    samples: id, samples; prompts: id, reference, answer. The target is the operator's own limit.
    """
    lined = F.lower("output").contains("answer:")
    key = shuffle_key(F.concat_ws("#", F.col("id").cast("string"), F.col("pos").cast("string")), seed)
    # both sides of a prompt in one go, so that the samples are read and shuffled once
    told = distinct_outputs(samples).select("id", "correct", (~lined).alias("late"), key.alias("k"), "pos", "output", "extracted")
    wrong, right = F.struct("late", "k", "pos", "output", "extracted"), F.struct("k", "pos", "output", "extracted")
    sides = told.groupBy("id").agg(F.array_sort(F.collect_list(F.when(~F.col("correct"), wrong))).alias("wrong"), F.array_sort(F.collect_list(F.when(F.col("correct"), right))).alias("right"))
    sides = sides.filter(F.size("wrong") > 0).select(
        "id",
        F.slice("wrong", 1, 2).alias("wrong"),
        F.when(F.size("right") > 0, F.transform("right", lambda x: F.struct(x["output"].alias("output"), x["extracted"].alias("extracted")))).alias("pool"),
    )
    pairs = sides.join(prompts.select("id", "reference", "answer"), "id").select("id", "reference", "answer", "pool", F.posexplode("wrong").alias("i", "w")).select("*", "w.output", "w.extracted")
    pool = F.coalesce("pool", F.array(F.struct(F.col("reference").alias("output"), F.col("answer").alias("extracted"))))
    chosen = F.element_at(pool, (F.col("i") % F.size(pool) + 1).cast("int"))
    pairs = pairs.select(
        F.concat_ws("#", F.col("id").cast("string"), F.col("i").cast("string")).alias("id"),
        F.col("id").alias("source_id"),
        "i",
        chosen["output"].alias("chosen"),
        chosen["extracted"].alias("chosen_extracted"),
        F.col("output").alias("rejected"),
        F.col("extracted").alias("rejected_extracted"),
        F.when(F.col("pool").isNull(), "reference").otherwise("sampled").alias("chosen_source"),
        F.col("answer").alias("gold"),
        lined.alias("rejected_has_answer_line"),
    )
    pairs = materialize(pairs, "pairs")  # counted before it is used
    n = {r["i"]: r["count"] for r in pairs.groupBy("i").count().collect()}
    room = max(0, target - n.get(0, 0))
    if n.get(1, 0) <= room:
        return pairs
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    second = with_position(pairs.filter("i = 1"), ["source_id"], parts, "__place").filter(F.col("__place") < room).drop("__place")
    return pairs.filter("i = 0").unionByName(second)


def unpaired(samples: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row, no_pair_all_correct: prompts whose distinct outputs are all right, or that have none.

    `pairs`, build_pairs() of the same samples with a prompt for each of them, tells which have a wrong one; no target
    drops a first pair.
    """
    wrong = distinct_outputs(samples).filter("not correct").select("id").distinct() if pairs is None else pairs.filter("i = 0").select(F.col("source_id").alias("id")).distinct()
    return samples.join(wrong, "id", "left_anti").agg(F.count("*").alias("no_pair_all_correct"))


def pair_report(pairs: DataFrame) -> DataFrame:
    """One row: pairs, prompts with pairs, second pairs, pairs by the source of the chosen side, rejected answer lines."""
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.count_distinct("source_id").alias("prompts_with_pairs"),
        F.count_if(F.col("i") > 0).alias("second_pairs_used"),
        F.count_if(F.col("chosen_source") == "sampled").alias("chosen_sampled"),
        F.count_if(F.col("chosen_source") == "reference").alias("chosen_reference"),
        F.count_if("rejected_has_answer_line").alias("rejected_has_answer_line"),
    )


def broken_pairs(pairs: DataFrame, chosen_right, rejected_right) -> DataFrame:
    """Pairs whose chosen side is scored wrong or whose rejected one is scored right; empty for a sound table."""
    return pairs.filter(~chosen_right | rejected_right)
