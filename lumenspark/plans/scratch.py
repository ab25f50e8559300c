"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may do without: executors elsewhere don't see its files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lumen-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: What this driver has written and not yet deleted.
_written: set[str] = set()


class Job:
    """The tables of one piece of work. release() deletes those that nothing which is still to run reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def release(self, keep: set[str] = frozenset()) -> int:
        gone = sorted(self.paths & _written - keep)
        for path in gone:
            _delete(self.spark, path)
        self.paths &= keep
        return len(gone)


_job: ContextVar[Job | None] = ContextVar("job", default=None)


@contextmanager
def job(spark: SparkSession) -> Iterator[Job]:
    """What this thread materializes inside belongs to the job, so its release() leaves other threads' tables alone."""
    own = Job(spark)
    before = _job.set(own)
    try:
        yield own
    finally:
        _job.reset(before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder, or to `path`, and read it back.

    checkpoint() would compute an uncached plan twice; a written table is computed once and survives lost executors.
    """
    path = path or new_path(df.sparkSession, name)
    _written.add(path)
    if own := _job.get():
        own.paths.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def drop(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; only call it when nothing that is still to run reads it."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def written() -> set[str]:
    """The tables that materialize() has written for this driver and that are still there."""
    return set(_written)


def release(spark: SparkSession, keep: set[str] = frozenset()) -> int:
    """Delete all that materialize() has written for this driver but `keep`, and say how many tables that were.

    For the end of a driver's work: results that read such tables, of any thread, must have been stored before. A piece of
    work beside others uses job().
    """
    paths = sorted(_written - keep)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as it takes not to be one of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Plan nodes whose rows come in the same partitions and order whichever columns are read.
_STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "View", "Relation"}


def _nodes(plan) -> set[str]:
    out, waiting = set(), [plan]
    while waiting:
        p = waiting.pop()
        out.add(p.nodeName().split(" ")[0].split("(")[0])
        children = p.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return out


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add a unique long per row that is the same in every use of the result, so that parts of rows can meet again by it.

    Over a scan the number follows from the place of the row in its files. Anything else (a shuffle deals its rows
    according to the columns that are read) is written first.
    """
    if not _nodes(df._jdf.queryExecution().optimizedPlan()) <= _STEADY:
        df = materialize(df, "rows")
    return df.withColumn(name, F.monotonically_increasing_id())
