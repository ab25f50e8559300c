"""Accuracy, serving and throughput reports over predictions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspark.functions import scoring as S
from lumenspark.functions.scoring import mcnemar
from lumenspark.plans.ranking import with_position


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row per key, by partial aggregation instead of a window."""
    others = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("x"))
    return last.select(key, "x.*")


def todo(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return rows.join(log.select(key).distinct(), key, "left_anti")


def rate(c: Column) -> Column:
    return F.round(F.avg(c.cast("double")), 4)


def summary(scored: DataFrame) -> DataFrame:
    """One row over correct, output, hit_limit and output_tokens; an empty table gives nulls."""
    line = F.lower("output").contains("answer:")
    return scored.agg(
        F.count("*").alias("n"),
        rate(F.col("correct")).alias("accuracy"),
        rate(line).alias("answer_line_rate"),
        rate(F.col("hit_limit")).alias("hit_max_new_tokens_rate"),
        F.round(F.avg("output_tokens"), 1).alias("mean_output_tokens"),
    )


def accuracy_by(scored: DataFrame, bucket: Column) -> DataFrame:
    return scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), rate(F.col("correct")).alias("accuracy"))


def accuracy_report(rows: DataFrame) -> DataFrame:
    """One row: accuracy, with the strict sign, with the lenient tolerance, of yes/no questions and of label-consistent ones.

    rows: output, gold_num, gold_word, question and label_consistent. An empty selection gives null.
    """
    args = [F.col(c) for c in ("output", "gold_num", "gold_word", "question")]
    scored = rows.withColumns({"__x": S.is_correct(*args)["correct"], "__strict": S.is_correct(*args, strict_sign=True)["correct"], "__lenient": S.is_correct(*args, rel=S.REL_TOL_LENIENT)["correct"]})
    only = lambda c: rate(F.when(c, F.col("__x")))
    return scored.agg(
        F.count("*").alias("n"),
        rate(F.col("__x")).alias("accuracy"),
        rate(F.col("__strict")).alias("accuracy_strict_sign"),
        rate(F.col("__lenient")).alias("accuracy_lenient"),
        only(F.col("gold_word").isin("yes", "no")).alias("accuracy_yes_no"),
        only(F.col("label_consistent")).alias("accuracy_label_consistent"),
    )


def step_bucket(steps: Column) -> Column:
    return F.when(steps >= 3, "3+").otherwise(steps.cast("string"))


def rescore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """n, changed and accuracy after scoring again; both tables have key and correct."""
    both = old.select(key, F.col("correct").alias("was")).join(new.select(key, "correct"), key)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("was") != F.col("correct")).alias("changed"), rate(F.col("correct")).alias("accuracy"))


def paired_test(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """b_only, c_only and the exact two-sided p-value of two models on the same rows."""
    both = a.select(key, F.col("correct").alias("x")).join(b.select(key, F.col("correct").alias("y")), key)
    counts = both.agg(F.count_if(F.col("x") & ~F.col("y")).alias("a_only"), F.count_if(~F.col("x") & F.col("y")).alias("b_only"))
    return counts.select("a_only", "b_only", mcnemar(F.col("a_only"), F.col("b_only")).alias("p"))


def ranked_values(rows: DataFrame, value: str, groups: list[str], quantiles: dict[str, Column]) -> DataFrame:
    """The values at given places of each group's sorted values, without collecting or sorting a group in one task.

    quantiles maps a name to a place as an expression over n, from 0. Equal values are counted together first; the
    counts before each distinct value come from range partitions over all groups, so a hot group is spread over them.
    Null values don't count; groups may be null.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c"))
    placed = with_position(counts, [*groups, value], parts, "before", weight="c")
    named = [f"__g{i}" for i in range(len(groups))]
    sizes = placed.groupBy(*groups).agg(F.min("before").alias("begin"), F.sum("c").alias("n")).toDF(*named, "begin", "n")
    same = [F.col(g).eqNullSafe(F.col(m)) for g, m in zip(groups, named, strict=True)]
    both = placed.join(sizes, reduce(and_, same) if same else F.lit(True))  # ungrouped: one row
    both = both.withColumn("before", F.col("before") - F.col("begin"))
    pick = [F.min(F.when(F.col("before") + F.col("c") > place, F.col(value))).alias(name) for name, place in quantiles.items()]
    return both.groupBy(*groups).agg(*pick)


def pct_place(q: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))


def medians(rows: DataFrame, value: str, groups: list[str], name: str = "median") -> DataFrame:
    """The median of each group, the mean of the two middle values if there are two."""
    middle = ranked_values(rows, value, groups, {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    return middle.select(*groups, ((F.col("low") + F.col("high")) / 2).alias(name))


def serving(rows: DataFrame, wall_minutes: float) -> DataFrame:
    """Medians, p10 and p95 of time to first token, rate and latency; rates that are zero or null don't count."""
    rate_ = F.when(F.col("gen_tok_s") > 0, F.col("gen_tok_s"))
    measures = F.create_map(F.lit("ttft"), F.col("ttft_ms").cast("double"), F.lit("tok_s"), rate_.cast("double"), F.lit("wall"), F.col("wall_ms").cast("double"))
    long = rows.select(F.explode(measures).alias("measure", "x"))
    places = {"p10": pct_place(0.1), "p50": pct_place(0.5), "p95": pct_place(0.95), "low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}
    found = ranked_values(long, "x", ["measure"], places)
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    picked = found.agg(
        of("ttft", (F.col("low") + F.col("high")) / 2).alias("ttft_p50"),
        of("tok_s", F.col("p10")).alias("tok_s_p10"),
        of("tok_s", F.col("p50")).alias("tok_s_p50"),
        of("wall", F.col("p50")).alias("wall_p50"),
        of("wall", F.col("p95")).alias("wall_p95"),
    )
    counted = rows.agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(wall_minutes), 1).alias("per_minute"))
    return counted.join(picked, F.lit(True)).select("n", "ttft_p50", "per_minute", "tok_s_p10", "tok_s_p50", "wall_p50", "wall_p95")  # global aggregates: one row each


def histogram(rows: DataFrame, value: str, width: int, bins: int) -> DataFrame:
    """(bin, n) of fixed-width bins, empty ones included."""
    counts = rows.select((F.floor(F.col(value) / width) * width).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    frame = rows.sparkSession.range(bins).select((F.col("id") * width).alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def throughput(steps: DataFrame, warm_up: int) -> DataFrame:
    """Tokens per second and the median step after the warm-up steps, per run."""
    measured = steps.filter(F.col("step") >= warm_up)
    speed = measured.groupBy("run").agg((F.sum("tokens") / F.sum("seconds")).alias("tok_s"))
    return speed.join(medians(measured, "seconds", ["run"], "median_s"), "run", "left")


def compare_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Speed-up and memory reduction of b over a; an error unless each has one row, on the same hardware and types."""
    columns = ("gpu", "dtype", "tok_s", "memory")
    of = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c))).alias(f"{'a' if run == a else 'b'}_{c}")
    both = runs.agg(F.count_if(F.col("run") == a).alias("a_rows"), F.count_if(F.col("run") == b).alias("b_rows"), *[of(run, c) for run in (a, b) for c in columns])
    fits = (F.col("a_rows") == 1) & (F.col("b_rows") == 1) & (F.col("a_gpu") == F.col("b_gpu")) & (F.col("a_dtype") == F.col("b_dtype"))
    same = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("runs aren't comparable")).cast("boolean"))
    return both.select(same.alias("comparable"), F.round(F.col("b_tok_s") / F.col("a_tok_s"), 2).alias("speed_up"), F.round(100 * (1 - F.col("b_memory") / F.col("a_memory")), 1).alias("memory_reduction"))


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    """batch of rows with consecutive ordinals."""
    return rows.withColumn("batch", F.floor(F.col(order) / size))


def split_report(examples: DataFrame, max_tokens: int) -> DataFrame:
    """One row per split over split, company, year, seq_tokens and word (the result's text, null for a number).

    A null company or year counts as a value of its own; the median is the upper one. With a column label_consistent,
    its true rows are counted, too.
    """
    more = [F.count_if(F.col("label_consistent")).alias("label_consistent")] if "label_consistent" in examples.columns else []
    sums = examples.groupBy("split").agg(
        F.count("*").alias("examples"),
        F.count_distinct(F.struct("company", "year")).alias("filings"),
        F.count_distinct(F.struct("company")).alias("companies"),
        F.max("seq_tokens").alias("seq_tokens_max"),
        F.count_if(F.col("seq_tokens") > max_tokens).alias("over_max_seq_len"),
        F.count_if(F.col("word").isNotNull()).alias("yes_no"),
        *more,
    )
    return sums.join(ranked_values(examples, "seq_tokens", ["split"], {"seq_tokens_median": F.floor(F.col("n") / 2)}), "split", "left")


def roll_up(tiles: dict[str, DataFrame], funnels: dict[str, DataFrame], series: DataFrame, splits: DataFrame) -> DataFrame:
    """(section, name, key, value) of a dataset report: tiles (one-row counts n), funnel steps (step, n), detector series
    (rule, threshold, f1) and split reports (split and numeric columns)."""
    parts = [df.select(F.lit("tile").alias("section"), F.lit(n).alias("name"), F.lit("").alias("key"), F.col("n").cast("double").alias("value")) for n, df in tiles.items()]
    parts += [df.select(F.lit("funnel").alias("section"), F.lit(n).alias("name"), F.col("step").alias("key"), F.col("n").cast("double").alias("value")) for n, df in funnels.items()]
    parts.append(series.select(F.lit("series").alias("section"), F.col("rule").alias("name"), F.col("threshold").cast("string").alias("key"), F.col("f1").cast("double").alias("value")))
    numbers = [c for c in splits.columns if c != "split"]
    cells = splits.select("split", *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot("split", numbers, "key", "value")
    parts.append(cells.select(F.lit("split").alias("section"), F.col("split").alias("name"), "key", "value"))
    return reduce(DataFrame.unionByName, parts)


def step_histogram(examples: DataFrame) -> DataFrame:
    """(split, steps, n): programs by their opening parentheses."""
    return examples.groupBy("split", F.regexp_count("program", F.lit(r"\(")).alias("steps")).agg(F.count("*").alias("n"))


def interval_means(stats: DataFrame, step: str, every: int) -> DataFrame:
    """Mean of every other column over each logging interval of `every` steps."""
    return stats.groupBy(F.floor(F.col(step) / every).alias("interval")).agg(*[F.avg(c).alias(c) for c in stats.columns if c != step])


def running_accuracy(scored: DataFrame, batch: str) -> DataFrame:
    """(batch, n, accuracy) up to and including each batch. Batches are summed up before the prefix sum runs over them."""
    sums = scored.groupBy(batch).agg(F.count("*").alias("rows"), F.count_if("correct").alias("right"))
    upto = W.orderBy(batch)
    return sums.select(batch, F.sum("rows").over(upto).alias("n"), F.round(F.sum("right").over(upto) / F.sum("rows").over(upto), 4).alias("accuracy"))


def mixed_share(samples: DataFrame) -> DataFrame:
    """prompts, and the share of them with right and wrong samples. samples: id, samples."""
    c = F.size(F.filter("samples", lambda s: s["correct"]))
    return samples.agg(F.count("*").alias("prompts"), rate((c > 0) & (c < F.size("samples"))).alias("mixed"))


def token_totals(rows: DataFrame, ids: str, seconds: float | None = None) -> DataFrame:
    """Token total and longest row of an epoch, and tokens a second if its duration is given."""
    out = [F.count("*").alias("rows"), F.sum(F.size(ids)).alias("tokens"), F.max(F.size(ids)).alias("longest")]
    return rows.agg(*out, *([F.round(F.sum(F.size(ids)) / seconds, 1).alias("tokens_per_s")] if seconds else []))
