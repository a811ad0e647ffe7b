import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.llm import sharding as sh


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=20), st.integers(1, 5000))
def test_vectorised_equals_plain(keys, n):
    assert sh.jump(np.array(keys, dtype=np.uint64), n).tolist() == [plain_jump(k, n) for k in keys]


def test_appending_moves_only_the_necessary_fraction_to_new_shards():
    keys = np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64)
    old, new = sh.jump(keys, 64), sh.jump(keys, 80)
    moved = old != new
    assert abs(moved.mean() - 16 / 80) < 0.005 and (new[moved] >= 64).all()
    sizes = np.bincount(new, minlength=80)
    assert sizes.min() > 0.9 * sizes.mean() and sizes.max() < 1.1 * sizes.mean()


def test_assignment_and_edge_rows(spark):
    rows = [(i, f"t{i}", "x") for i in range(500)] + [(None, None, "x"), (None, "y", None), (3, "other", "x"), (3, "t3", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _shards string")
    with pytest.raises(ValueError):
        sh.assign(df, "doc_id", [4], ["text"])
    got = sh.assign(df, "doc_id", [7, 9]).collect()
    import hashlib

    for r in got:
        key = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:16], 16)
        assert (r["shard_7"], r["shard_9"]) == (plain_jump(key, 7), plain_jump(key, 9))
    assert len(got) == len(rows)
    assert sh.assign(df.limit(0), "doc_id", [7]).count() == 0


def test_each_shard_is_one_partition(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    parts = sh.sharded(df, "doc_id", 5).rdd.glom().collect()
    assert len(parts) == 5 and all({r["shard"] for r in p} == {i} for i, p in enumerate(parts))
    moved = sh.reshard(df, "doc_id", 5, 6).collect()
    assert all(r["new_shard"] == 5 for r in moved) and 100 < len(moved) < 240


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "x", 2), (None, "y", 3), (1, "x", 2)], "`doc.id` bigint, `a.b` string, _found int").withColumn("c`d", F.lit(1))
    got = sh.assign(df, "doc.id", [8, 12])
    assert got.columns == ["doc.id", "a.b", "_found", "c`d", "shard_8", "shard_12"] and got.count() == 3
    assert sh.sharded(df, "doc.id", 4).select("shard").distinct().count() <= 2
    moved = sh.reshard(df, "doc.id", 2, 9)
    assert moved.columns == ["doc.id", "shard", "new_shard"] and sh.reshard(df, "doc.id", 5, 5).count() == 0
