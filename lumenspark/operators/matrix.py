"""Matrices as tables of blocks: products, and the merge of a low-rank update into a weight matrix.

A block is (i, j, height, width, cells): the place of the block in the grid and its cells row by row. A product joins the
blocks of both sides by the inner index and multiplies block by block. Low-rank factors have a single inner block, so the
join's keys are spread: the right side, the smaller one, is repeated SPREAD times. Partial products are sorted by place and
summed up one after the other, so a task holds one block of the result at a time however long the inner dimension is; their
shuffle is the result's size for each inner block.

Cases: the last blocks of a row or column are smaller; a missing block counts as zeros and gives none in the result unless
another one does; an empty table gives an empty table; sides whose inner blocks don't fit are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
SPREAD = 8
SCHEMA = "i long, j long, height int, width int, cells array<double>"


def to_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the matrix whose rows are given as (row from 0, values, an array); rows that are missing are zeros."""
    cut = F.transform(F.sequence(F.lit(0), (F.size("values") - 1).cast("int"), F.lit(block)), lambda k: F.struct((k / block).cast("long").alias("j"), F.slice("values", k + 1, F.lit(block)).cast("array<double>").alias("part")))
    cells = rows.filter(F.size("values") > 0).select(F.floor(F.col("row") / block).alias("i"), F.pmod("row", F.lit(block)).cast("int").alias("r"), F.inline(cut))
    groups = cells.groupBy("i", "j").agg(F.max("r").alias("last"), F.max(F.size("part")).alias("width"), F.map_from_entries(F.collect_list(F.struct("r", "part"))).alias("held"))
    lines = F.transform(F.sequence(F.lit(0), F.col("last")), lambda r: F.coalesce(F.try_element_at("held", r), F.array_repeat(F.lit(0.0), F.col("width"))))
    return groups.select("i", "j", (F.col("last") + 1).alias("height"), "width", F.flatten(lines).alias("cells"))


def to_rows(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, values) of the rows that the blocks hold, all blocks of a row side by side."""
    lines = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda r: F.struct((F.col("i") * block + r).alias("row"), F.slice("cells", r * F.col("width") + 1, F.col("width")).alias("part")))
    parts = blocks.select("j", F.inline(lines))
    return parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "part"))), lambda x: x["part"])).alias("values"))


def _block(height: int, width: int, cells: pa.Scalar) -> np.ndarray:
    return cells.values.to_numpy(zero_copy_only=False).reshape(height, width)


def _record(i: int, j: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i]), pa.array([j]), pa.array([x.shape[0]], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.reshape(-1)], pa.list_(pa.float64()))], names=["i", "j", "height", "width", "cells"])


def _padded_sum(x: np.ndarray | None, y: np.ndarray) -> np.ndarray:
    """The sum of two blocks of one place, of which one may lack last rows or columns that are zeros."""
    if x is None:
        return y
    if x.shape == y.shape:
        return x + y
    out = np.zeros(np.maximum(x.shape, y.shape))
    out[: x.shape[0], : x.shape[1]] += x
    out[: y.shape[0], : y.shape[1]] += y
    return out


def _sum_runs(batches: Iterator[pa.RecordBatch], made) -> Iterator[pa.RecordBatch]:
    """Sums of consecutive blocks of one place; made(batch, k) is the k-th block of a batch."""
    place, held = None, None
    for b in batches:
        i, j = b.column("i").to_pylist(), b.column("j").to_pylist()
        for k in range(b.num_rows):
            if place != (i[k], j[k]):
                if place is not None:
                    yield _record(*place, held)
                place, held = (i[k], j[k]), None
            held = _padded_sum(held, made(b, k))
    if place is not None:
        yield _record(*place, held)


def _summed(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sum_runs(batches, lambda b, k: _block(b.column("height")[k].as_py(), b.column("width")[k].as_py(), b.column("cells")[k]))

    return blocks.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, SCHEMA)


def product(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """Blocks of factor * A B."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, k: int) -> np.ndarray:
            x = _block(batch.column("height")[k].as_py(), batch.column("inner")[k].as_py(), batch.column("cells")[k])
            y = _block(batch.column("depth")[k].as_py(), batch.column("width")[k].as_py(), batch.column("others")[k])
            n = min(x.shape[1], y.shape[0])  # rows of zeros at the end may be missing
            return factor * (x[:, :n] @ y[:n])

        return _sum_runs(batches, made)

    left = a.select("i", F.col("j").alias("k"), F.pmod("i", F.lit(SPREAD)).alias("part"), "height", F.col("width").alias("inner"), "cells")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part")
    right = b.select(F.col("i").alias("k"), "j", every, F.col("height").alias("depth"), "width", F.col("cells").alias("others"))
    pairs = left.join(right, ["k", "part"]).select("i", "j", "height", "inner", "cells", "depth", "width", "others")
    return _summed(pairs.mapInArrow(run, SCHEMA))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _summed(a.unionByName(b))


def merge_update(weight: DataFrame, b: DataFrame, a: DataFrame, alpha: float, rank: int) -> DataFrame:
    """Blocks of W + (alpha / rank) B A: a low-rank update merged into the weights that it was trained for."""
    if rank < 1:
        raise ValueError("the rank is below 1")
    return add(weight, product(b, a, alpha / rank))
