"""Vectors in archives: round trips, partial failures, order."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark.sources import npz


@pytest.fixture
def vectors(spark):
    npz.register(spark)
    return spark.range(250).select((F.col("id") * 7 % 250).alias("id"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"), F.lit("x").alias("other"))


def test_round_trip_in_order(spark, vectors, tmp_path):
    path = str(tmp_path / "v")
    vectors.repartitionByRange(3, "id").sortWithinPartitions("id").write.format("npz").mode("append").option("rowsPerFile", 40).save(path)
    got = spark.read.format("npz").load(path)
    assert {(r["id"], tuple(r["embedding"])) for r in got.collect()} == {(r["id"], tuple(r["embedding"])) for r in vectors.collect()}
    assert [r["id"] for r in got.orderBy("file", "row").collect()] == list(range(250))
    assert sorted(os.listdir(path))[0] == "_SUCCESS" and len(os.listdir(path)) >= 8
    with np.load(f"{path}/{npz.archives(path)[0]}") as held:
        assert held["ids"].tolist() == list(range(40)) and held["embeddings"].dtype == np.float32
    assert got.rdd.getNumPartitions() == len(npz.archives(path))
    assert npz.same_order(vectors, got, ["id"]) and npz.misplaced(vectors, got, ["id"]).count() == 0


def test_overwrite_append_and_empty(spark, vectors, tmp_path):
    path = str(tmp_path / "v")
    for mode, n in (("append", 250), ("append", 500), ("overwrite", 250)):
        vectors.write.format("npz").mode(mode).save(path)
        assert spark.read.format("npz").load(path).count() == n
    empty = str(tmp_path / "e")
    vectors.limit(0).write.format("npz").mode("append").save(empty)
    assert os.listdir(empty) == ["_SUCCESS"] and spark.read.format("npz").load(empty).count() == 0
    assert spark.read.format("npz").load(str(tmp_path / "nothing")).count() == 0


def test_a_failed_job_leaves_nothing(spark, vectors, tmp_path):
    """One task fails after others have written: no archive shows, earlier ones stay as they were."""
    path = str(tmp_path / "v")
    vectors.write.format("npz").mode("append").save(path)
    before = sorted(os.listdir(path))
    bad = vectors.repartitionByRange(4, "id").withColumn("embedding", F.when(F.col("id") < 249, F.col("embedding")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="is null"):
            bad.write.format("npz").mode(mode).option("rowsPerFile", 10).save(path)
        assert sorted(os.listdir(path)) == before
    with pytest.raises(Exception, match="no column embedding"):
        vectors.select("id").write.format("npz").mode("append").save(path)


def test_string_ids(spark, vectors, tmp_path):
    path = str(tmp_path / "v")
    named = vectors.withColumn("id", F.concat(F.lit("é"), F.col("id").cast("string")))
    named.write.format("npz").mode("append").save(path)
    got = spark.read.format("npz").schema("id string, embedding array<double>").load(path)
    assert {(r["id"], tuple(r["embedding"])) for r in got.collect()} == {(r["id"], tuple(r["embedding"])) for r in named.collect()}


def test_order(spark, vectors, tmp_path):
    """The same ids in another order, or one id less, aren't the same; the places that differ are named."""
    path = str(tmp_path / "v")
    swapped = vectors.withColumn("at", F.when(F.col("id") == 10, 11).when(F.col("id") == 11, 10).otherwise(F.col("id")))
    swapped.repartitionByRange(2, "at").sortWithinPartitions("at").write.format("npz").mode("append").save(path)
    got = spark.read.format("npz").load(path)
    assert not npz.same_order(vectors, got, ["id"])
    assert sorted(tuple(r) for r in npz.misplaced(vectors, got, ["id"]).collect()) == [(10, 10, 11), (11, 11, 10)]
    short = vectors.filter("id < 249")
    assert not npz.same_order(short, vectors, ["id"], ["id"])
    assert [tuple(r) for r in npz.misplaced(short, vectors, ["id"], ["id"]).collect()] == [(249, None, 249)]
    assert npz.same_order(vectors.limit(0), vectors.limit(0), ["id"], ["id"])
