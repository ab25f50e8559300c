"""Tables in the shared folder."""

import pytest

from lumenspark.plans import scratch


def test_release_deletes_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_written", set())
    a, b = scratch.materialize(spark.range(5), "a"), scratch.materialize(spark.range(7), "b")
    assert (a.count(), b.count()) == (5, 7)
    scratch.drop(a)
    assert scratch.release(spark) == 1 and scratch.release(spark) == 0
    with pytest.raises(Exception, match="exist"):
        scratch.materialize(spark.read.schema("id long").parquet(b._scratch), "c")
