"""Vectors in NPZ archives as a Spark data source, and whether they stand in the order of their records.

An archive holds two arrays, `ids` and `embeddings` (one row an id). `register(spark)` makes the format `npz` known:

    spark.read.format("npz").load(path)      # file string, row long, id, embedding array<float>
    df.write.format("npz").mode("append").option("rowsPerFile", 100000).save(path)

Reading makes one task of each archive. Writing puts each task's archives into `path/_temporary` under names of its own; only
when all tasks are done, the driver moves them to `path` and writes `_SUCCESS`, so a lost executor or a failed job leaves
nothing that a reader sees. Archives are named by partition and number: a sorted table reads back in its order by (file,
row). Paths may be of any file system that Arrow opens.

Cases: ids are bigint, or string if the schema given says so; null ids aren't written (an error); a null embedding is an
error too, as are rows of different lengths in one archive; an empty table writes only `_SUCCESS`, and an empty or missing
folder reads as no rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumenspark.plans.ranking import with_position

SCHEMA = "file string, row long, id long, embedding array<float>"
ROWS_PER_FILE = 100_000
ROWS_PER_BATCH = 4096


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The archives of a folder by name; those that a task is still writing don't count."""
    from pyarrow import fs

    system, folder = _open(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == fs.FileType.File and x.base_name.endswith(".npz"))


@dataclass
class Archive(InputPartition):
    name: str


class NpzReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [Archive(name) for name in archives(self.path)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition when there is none
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        system, folder = _open(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as held:
            ids, vectors = held["ids"], held["embeddings"]
        if len(ids) != len(vectors):
            raise ValueError(f"{partition.name}: {len(ids)} ids and {len(vectors)} embeddings")
        for i in range(0, len(ids), ROWS_PER_BATCH):
            some = vectors[i : i + ROWS_PER_BATCH]
            flat = pa.array(some.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]), flat)
            columns = {"file": pa.array([partition.name] * len(some)), "row": pa.array(np.arange(i, i + len(some))), "id": pa.array(ids[i : i + ROWS_PER_BATCH].tolist()), "embedding": lists}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in wanted], schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool):
        self.path, self.rows, self.overwrite, self.job = path, rows, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = _open(self.path)
        names, ids, vectors, count = [], [], [], 0
        place = f"{folder}/_temporary/{self.job}"
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()

        def flush() -> None:
            nonlocal ids, vectors, count
            if not count:
                return
            name = f"part-{part:05d}-{len(names):05d}-{self.job}.npz"
            out = io.BytesIO()
            np.savez(out, ids=np.concatenate(ids), embeddings=np.concatenate(vectors))
            system.create_dir(f"{place}/{attempt}", recursive=True)
            with system.open_output_stream(f"{place}/{attempt}/{name}") as f:
                f.write(out.getbuffer())
            names.append(f"{attempt}/{name}")
            ids, vectors, count = [], [], 0

        for b in iterator:
            id_, v = b.column("id"), b.column("embedding")
            if id_.null_count or v.null_count or v.flatten().null_count:
                raise ValueError("an id or an embedding is null")
            text, i = not pa.types.is_integer(id_.type), 0
            while i < b.num_rows:
                n = min(self.rows - count, b.num_rows - i)
                ids.append(np.array(id_.slice(i, n).to_pylist()) if text else id_.slice(i, n).to_numpy())
                vectors.append(v.slice(i, n).flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
                count, i = count + n, i + n
                if count == self.rows:
                    flush()
        flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        before = archives(self.path) if self.overwrite else []
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{folder}/_temporary/{self.job}/{name}", f"{folder}/{name.rpartition('/')[2]}")
        for name in before:
            system.delete_file(f"{folder}/{name}")
        self._clear(system, folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{folder}/_temporary/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary/{self.job}")
            if not system.get_file_info(fs.FileSelector(f"{folder}/_temporary")):
                system.delete_dir(f"{folder}/_temporary")


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        missing = {"id", "embedding"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {' and '.join(sorted(missing))}")
        rows = int(self.options.get("rowsPerFile", ROWS_PER_FILE))
        if rows < 1:
            raise ValueError("rowsPerFile is below 1")
        return NpzWriter(self.options["path"], rows, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_position(df.select("id", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), [f"_o{i}" for i in range(len(order))], parts, "place").select("place", "id")


def order_digest(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: n and digest, a number that depends on all ids and on their places in `order`, whose values are unique.

    Each row adds a hash of its id and place, so the digest needs one sort by ranges and one sum.
    """
    return _placed(df, order).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("place", "id").cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def same_order(records: DataFrame, vectors: DataFrame, order: list[str], vector_order: list[str] = ("file", "row")) -> bool:
    """Whether vectors have the ids of the records, all of them, in the same order."""
    return order_digest(records, order).first() == order_digest(vectors, list(vector_order)).first()


def misplaced(records: DataFrame, vectors: DataFrame, order: list[str], vector_order: list[str] = ("file", "row")) -> DataFrame:
    """(place, record_id, vector_id): the places at which records and vectors differ; a null id where one of both ends."""
    a, b = _placed(records, order).toDF("place", "record_id"), _placed(vectors, list(vector_order)).toDF("place", "vector_id")
    return a.join(b, "place", "full").filter(~F.col("record_id").eqNullSafe(F.col("vector_id")))
