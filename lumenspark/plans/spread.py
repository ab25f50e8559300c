"""Even work for scans with fewer splits than cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a file scan dealt out to all cores if it has fewer splits than there are cores, else the scan itself.

    A small file often is one row group, which one task reads; costly expressions after it would keep the other cores
    idle. A scan with at least as many splits as cores gets no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
