"""Jobs made of steps that can be resumed."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions.text import strip


@dataclass
class Step:
    name: str
    done: Callable[[], bool]
    run: Callable[[], object]


def run_steps(steps: list[Step], report: Callable[[dict[str, str]], object] = lambda status: None) -> dict[str, str]:
    """Run what isn't done yet, in order; the first step that fails, or isn't done after its run, ends the job.

    The status of each step: `done (already)`, `done`, `failed: ...` or `pending`. report() gets it after each change.
    """
    status = {s.name: "done (already)" if s.done() else "pending" for s in steps}
    report(dict(status))
    for s in steps:
        if status[s.name] != "pending":
            continue
        try:
            s.run()
            status[s.name] = "done" if s.done() else "failed: not done after its run"
        except Exception as e:
            status[s.name] = f"failed: {e}"
        report(dict(status))
        if status[s.name] != "done":
            break
    return status


def has_lines(spark: SparkSession, path: str, n: int) -> bool:
    """Whether a text file or folder is there and holds n lines: a step's completeness test."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) and spark.read.text(path).limit(n).count() >= n


class Throttled:
    """A report() for run_steps that calls `send` once in `every` seconds at most, and always when no step is pending."""

    def __init__(self, send: Callable[[dict[str, str]], object], every: float = 300, clock: Callable[[], float] = time.monotonic):
        self.send, self.every, self.clock, self.last = send, every, clock, None

    def __call__(self, status: dict[str, str]) -> None:
        now = self.clock()
        if self.last is None or now - self.last >= self.every or "pending" not in status.values():
            self.send(status)
            self.last = now


def log_tail(lines: DataFrame, noise: list[str], n: int = 6, width: int = 200) -> DataFrame:
    """The last n lines (line, text) that are neither blank nor hold a noise word, their last `width` characters."""
    told = lines.filter(F.length(strip(F.col("text"))) > 0)
    for word in noise:
        told = told.filter(~F.contains("text", F.lit(word)))
    return told.orderBy(F.desc("line")).limit(n).select("line", F.right("text", F.lit(width)).alias("text"))


def last_match(lines: DataFrame, pattern: str) -> DataFrame:
    """One row, `found`: the first group of the pattern's last match in a log (line, text); null if it never occurs."""
    found = F.element_at(F.regexp_extract_all("text", F.lit(pattern), 1), -1)
    hits = lines.filter(F.col("text").rlike(pattern)).select("line", found.alias("found"))
    return hits.agg(F.max_by("found", "line").alias("found"))
