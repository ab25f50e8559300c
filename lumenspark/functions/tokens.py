"""Token arrays: label masks, padding and per-token log-probabilities, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.functions.numbers import let
from lumenspark.functions.render import chat

IGNORE = -100


def token_count(c: Column) -> Column:
    """Words and punctuation marks, plus one: a stand-in where no tokenizer file is at hand."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]")) + 1


def find_last(ids: Column, part: Column) -> Column:
    """0-based place of the last occurrence of `part`, -1 if there is none.

    A search of text in text: numbers are written one after the other from the end, each behind a comma, and the commas
    before the first hit are counted.
    """
    spelled = lambda x: F.concat(F.lit(","), F.array_join(F.reverse(x), ",", "null"), F.lit(","))

    def place(whole: Column) -> Column:
        before = F.left(whole, F.position(spelled(part), whole) - 1)
        return F.when(F.contains(whole, spelled(part)), F.size(ids) - F.size(part) - F.length(before) + F.length(F.replace(before, F.lit(","), F.lit(""))))

    return F.coalesce(F.when(F.size(part) == 0, F.size(ids)).otherwise(let(spelled(ids), place)), F.lit(-1))


def response_labels(ids: Column, header: Column) -> Column:
    """ids with all up to and including the last header masked; an error where there is no header."""
    missing = F.raise_error(F.lit("assistant header not found")).cast("int")
    masked = lambda at: let(F.when(at >= 0, at + F.size(header)).otherwise(missing), lambda cut: F.concat(F.array_repeat(F.lit(IGNORE), cut), F.slice(ids, cut + 1, F.size(ids))))
    return let(find_last(ids, header), masked)


def encoder(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """A Column function from texts to token ids by encode(list of texts), over Arrow batches; null texts are empty."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(encode(["" if t is None else t for t in texts.to_pylist()]), pa.list_(pa.int32()))

    return ids


def response_mask(header: list[int]) -> Callable[[Column], Column]:
    """response_labels() by one header for all rows, as a Column function over Arrow batches: a batch is searched at once."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def labels(ids: pa.Array) -> pa.Array:
        offsets, values = ids.offsets.to_numpy(), ids.values
        begin, end = int(offsets[0]), int(offsets[-1])
        values, offsets = values.slice(begin, end - begin), offsets - begin
        flat = pc.fill_null(values.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
        if header:
            at = np.arange(max(0, len(flat) - len(header) + 1))
            for j, h in enumerate(header):
                at = at[flat[at + j] == h]
            row = np.searchsorted(offsets, at, side="right") - 1
            whole = at + len(header) <= offsets[row + 1]
            cut = np.full(len(ids), -1)
            cut[row[whole]] = at[whole] + len(header)  # ascending, so the last one stays
        else:
            cut = offsets[1:]
        if ids.null_count or (cut < 0).any():
            raise ValueError("assistant header not found")
        masked = np.arange(len(flat)) < np.repeat(cut, np.diff(offsets))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.if_else(pa.array(masked), pa.scalar(IGNORE, pa.int32()), values))

    return labels


def tokenize_examples(df: DataFrame, text: str, ids: Callable[[Column], Column], header: list[int], response_only: bool = True) -> DataFrame:
    """df with input_ids, attention_mask and labels of chat texts; only the last response has labels, or all of the text."""
    out = df.withColumn("input_ids", ids(F.col(text)))
    labels = response_mask(header)(F.col("input_ids")) if response_only else F.col("input_ids")
    return out.withColumns({"attention_mask": F.array_repeat(F.lit(1), F.size("input_ids")), "labels": labels})


def tokenize_pairs(pairs: DataFrame, ids: Callable[[Column], Column], header: list[int]) -> DataFrame:
    """pairs with ids and labels of both sides, the prompt's turns and the response as one chat each.

    pairs: prompt, chosen, rejected, arrays of struct(role, content).
    """
    out, labels = pairs, response_mask(header)
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_input_ids", ids(chat(F.concat("prompt", side))))
        out = out.withColumn(f"{side}_labels", labels(F.col(f"{side}_input_ids")))
    return out


def pad(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(width - F.size(ids), F.lit(0))))


def collate_pairs(pairs: DataFrame, batch: int, pad_id: int, order: str = "ordinal") -> DataFrame:
    """Batches of `batch` pairs padded to their longest sequence: chosen rows, then rejected ones.

    pairs: ordinal, chosen_input_ids, chosen_labels, rejected_input_ids, rejected_labels. Ordinals must be consecutive,
    so that batches need no sort over all rows.
    """
    numbered = pairs.withColumn("batch", F.floor(F.col(order) / batch))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"{k}_input_ids").alias("ids"), F.col(f"{k}_labels").alias("labels")) for i, k in enumerate(("chosen", "rejected"))])
    rows = numbered.select("batch", order, F.explode(sides).alias("x")).select("batch", order, "x.*")
    width = F.max(F.size("ids")).over(W.partitionBy("batch"))
    rows = rows.withColumn("width", width)
    return rows.select(
        "batch",
        "side",
        order,
        pad(F.col("ids"), F.col("width"), pad_id).alias("input_ids"),
        pad(F.col("labels"), F.col("width"), IGNORE).alias("labels"),
        F.transform(F.sequence(F.lit(1), "width"), lambda i: (i <= F.size("ids")).cast("int")).alias("attention_mask"),
    )


def mean_logprob(logits: Column, labels: Column) -> Column:
    """struct(mean, count): mean log-probability of the labels that aren't masked, each predicted by the logits before it.

    logits: array per position of an array over the vocabulary.
    """
    pairs = F.filter(F.arrays_zip(F.slice(logits, 1, F.size(logits) - 1).alias("l"), F.slice(labels, 2, F.size(labels)).alias("y")), lambda p: p["y"] != IGNORE)

    def one(p: Column) -> Column:
        top = F.array_max(p["l"])
        return F.get(p["l"], p["y"]) - top - F.log(F.aggregate(p["l"], F.lit(0.0), lambda a, x: a + F.exp(x - top)))

    total = F.aggregate(F.transform(pairs, one), F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.try_divide(total, F.size(pairs)).alias("mean"), F.size(pairs).alias("count"))


def orpo_loss(chosen: Column, rejected: Column, beta: float) -> tuple[Column, Column, Column]:
    """Aggregates (loss, nll, ratio) over pairs of mean log-probabilities."""
    odds = (chosen - rejected) - (F.log(-F.expm1(chosen)) - F.log(-F.expm1(rejected)))
    ratio = -F.log1p(F.exp(-odds))
    nll = -F.avg(chosen)
    return nll - beta * F.avg(ratio), nll, F.avg(ratio)
