"""Global positions and running sums in a sorted order without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.plans.scratch import drop, materialize


def with_position(df: DataFrame, keys: list[str], partitions: int, name: str = "position", weight: str | None = None) -> DataFrame:
    """Add `name`: the 0-based place of each row when all rows are sorted by `keys`; with `weight`, a long column, the sum
    of the weights of all rows before it.

    Rows are range-partitioned and sorted, numbered within their partition and shifted by the number of rows of the
    earlier partitions. Only one sum per partition reaches the driver. Ties in `keys` get distinct places.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            own = np.ones(b.num_rows, np.int64) if weight is None else b.column(weight).to_numpy()
            upto = seen + np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(upto - own)], names=[*b.schema.names, "_part", "_place"])
            seen = int(upto[-1]) if len(upto) else seen

    ranged = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    numbered = materialize(ranged.mapInArrow(number, schema), "sorted")
    counts = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg((F.count("*") if weight is None else F.sum(weight)).alias("n")).collect()}
    before, offsets = 0, {}
    for part in sorted(counts):
        offsets[part] = before
        before += counts[part]
    if not offsets:
        return numbered.select(*df.columns, F.col("_place").alias(name))
    pairs = df.sparkSession.createDataFrame(list(offsets.items()), "_part int, _offset long")
    return numbered.join(F.broadcast(pairs), "_part").select(*df.columns, (F.col("_place") + F.col("_offset")).alias(name))


def running_sums(df: DataFrame, keys: list, values: list[str], partitions: int) -> DataFrame:
    """df with each of `values`, as a double, replaced by its sum over all rows up to and with this one in the order of `keys`.

    As with_position(): range partitions, sums within each, and the last sums of each partition shift those behind it. Rows
    with equal keys count one after the other: group them first where they shall count together. Nulls count as 0.
    """
    others = [c for c in df.columns if c not in values]
    source = df.select(*[df[f"`{c}`"] for c in others], *[F.coalesce(df[f"`{v}`"].cast("double"), F.lit(0.0)).alias(v) for v in values])
    schema = T.StructType([*source.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, upto, seen = TaskContext.get().partitionId(), np.zeros(len(values)), 0
        for b in batches:
            if b.num_rows:
                sums = upto + np.cumsum(np.stack([b.column(v).to_numpy() for v in values], axis=1), axis=0)
                rows = np.arange(seen, seen + b.num_rows)
                upto, seen = sums[-1], seen + b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *[pa.array(sums[:, i]) for i in range(len(values))], pa.array(np.full(b.num_rows, part, np.int32)), pa.array(rows)], names=schema.names)

    summed = materialize(source.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(add, schema), "sums")
    ends = summed.groupBy("_part").agg(F.max_by(F.struct(*values), "_row").alias("x")).orderBy("_part").collect()
    before, shift = [0.0] * len(values), []
    for r in ends:
        shift.append((r["_part"], *before))
        before = [x + y for x, y in zip(before, r["x"], strict=True)]
    if not shift:
        return summed.drop("_part", "_row")
    moved = df.sparkSession.createDataFrame(shift, "_part int, " + ", ".join(f"_before{i} double" for i in range(len(values))))
    return summed.join(F.broadcast(moved), "_part").select(*[F.col(f"`{c}`") for c in others], *[(F.col(f"`{v}`") + F.col(f"_before{i}")).alias(v) for i, v in enumerate(values)])


__all__ = ["with_position", "running_sums", "drop"]
