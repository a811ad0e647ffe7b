import bisect
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from loomstone.llm import mixing as mx


def brute(docs, schedule, knots, default, total=None, max_epochs=4, seed="mix"):
    """(doc_id, source, epoch, position) by numeric integration of the shares in fine steps, and bisection."""
    tokens = lambda t: max(1, math.ceil(len((t or "").encode()) / 4))
    sources = {}
    for doc, source, text in docs:
        sources.setdefault(source or "", []).append((hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest(), doc is not None, doc or 0, tokens(text), source))
    total = total or sum(d[3] for rows in sources.values() for d in rows)
    steps = 20_000
    weight = lambda s, i: schedule.get(s, default)[i]

    def share(s, t):
        i = min(bisect.bisect_right(knots, t) - 1, len(knots) - 2)
        u = (t - knots[i]) / (knots[i + 1] - knots[i])
        at = [weight(s, k) / max(1, sum(weight(x, k) for x in sources)) for k in (i, i + 1)]
        return at[0] * (1 - u) + at[1] * u

    out = []
    for s, rows in sources.items():
        demand = [0.0]
        for k in range(steps):
            demand.append(demand[-1] + total * share(s, (k + 0.5) / steps) / steps)
        supply = sum(d[3] for d in rows)
        for epoch in range(max_epochs):
            c = epoch * supply
            for _, has, doc, n, source in sorted(rows, key=lambda d: d[:4]):
                if c < demand[-1] - 1e-6:
                    k = bisect.bisect_right(demand, c) - 1
                    u = (c - demand[k]) / max(demand[k + 1] - demand[k], 1e-12)
                    out.append((doc if has else None, source, epoch, (k + u) / steps * total))
                c += n
    return sorted(out, key=str)


SCHEDULE, KNOTS, DEFAULT = {"a": [8, 4, 0], "b": [0, 1, 9], "z": [0, 0, 0]}, [0.0, 0.25, 1.0], [2, 2, 2]


def docs_of(n):
    return [(i, "abc?z"[i % 5] if i % 5 != 3 else None, "x" * (i * 7 % 400)) for i in range(n)]


def test_positions_equal_numeric_integration(spark):
    docs = docs_of(300)
    frame = spark.createDataFrame([(d, s, t, 1, "h") for d, s, t in docs], "doc_id bigint, source string, text string, total int, src string")
    got = mx.mix(frame, SCHEDULE, KNOTS, DEFAULT).collect()
    want = brute(docs, SCHEDULE, KNOTS, DEFAULT)
    have = sorted(((r["doc_id"], r["source"], r["_epoch"], r["_position"]) for r in got), key=str)
    assert [h[:3] for h in have] == [w[:3] for w in want] and len(have) > 200
    total = sum(max(1, math.ceil(len(t) / 4)) for _, _, t in docs)
    assert all(abs(h[3] - w[3]) <= 2 + total / 5000 for h, w in zip(have, want))
    assert not any(h[1] == "z" for h in have)


def test_windows_meet_the_schedule(spark):
    docs = [(i, "abc"[i % 3], "y" * 40) for i in range(6000)]
    got = mx.mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), {"a": [6, 0], "b": [0, 6]}, [0.0, 1.0], [3, 3]).collect()
    total = 60_000
    assert [r["_position"] for r in got] == sorted(r["_position"] for r in got)
    for k in range(10):
        window = [r for r in got if k * total / 10 <= r["_position"] < (k + 1) * total / 10]
        t = (k + 0.5) / 10
        for s, want in (("a", (1 - t) * 2 / 3), ("b", t * 2 / 3), ("c", 1 / 3)):
            have = sum(r["_tokens"] for r in window if r["source"] == s) / sum(r["_tokens"] for r in window)
            assert abs(have - want) < 0.04, (k, s, have, want)


def test_repeats_stop_at_max_epochs_and_total_bounds_the_run(spark):
    docs = spark.createDataFrame([(i, "a" if i < 3 else "b", "y" * 40) for i in range(100)], "doc_id bigint, source string, text string")
    got = mx.mix(docs, {"a": [50, 50], "b": [50, 50]}, [0.0, 1.0], [1, 1], max_epochs=2).collect()
    assert sorted(r["_epoch"] for r in got if r["source"] == "a") == [0, 0, 0, 1, 1, 1]
    short = mx.mix(docs, {}, [0.0, 1.0], [1, 1], total=200).collect()
    assert sum(r["_tokens"] for r in short) == 200 and max(r["_position"] for r in short) < 200


def test_edge_rows(spark):
    long = "é" * 300_000
    rows = [(1, "a", None, "x"), (2, "a", "", "x"), (None, "a", "abc", "x"), (3, None, long, "x"), (4, "a", "same", "x"), (4, "a", "same", "x"), (5, "b", "text", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, plan string")
    got = mx.mix(docs, {}, [0.0, 1.0], [1, 1])
    assert got.columns[:4] == docs.columns
    out = got.collect()
    assert {r["_tokens"] for r in out if r["doc_id"] in (1, 2)} == {1} and [r["_tokens"] for r in out if r["doc_id"] == 3] == [150_000]
    assert sum(r["doc_id"] == 4 and r["_epoch"] == 0 for r in out) == 2 and any(r["doc_id"] is None for r in out)
    assert mx.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mx.mix(docs, {"a": [1]}, [0.0, 1.0], [1, 1]).count()
    with pytest.raises(ValueError):
        mx.mix(docs, {}, [0.0, 0.5], [1, 1]).count()


def test_null_and_empty_sources_differ_and_unmet_demand_is_told(spark):
    """Thirty documents of no source get the default weight, not that of the empty name; what the passes don't give is
    reported by source, and without a limit on them nothing is missing."""
    rows = [(i, None, "y" * 40) for i in range(30)] + [(100 + i, "", "y" * 40) for i in range(30)] + [(200, "a", "y" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    args = {"": [9, 9]}, [0.0, 1.0], [1, 1]
    got = mx.mix(docs, *args).collect()
    total = 61 * 10
    have = {s: sum(r["_tokens"] for r in got if r["source"] == s) for s in (None, "", "a")}
    assert abs(have[None] - total / 11) <= 10 and have[""] == 500 and have["a"] == 40
    told = {r["source"]: r for r in mx.unmet_demand(docs, *args).collect()}
    assert told[None]["unmet"] == told[""]["unmet"] == 0 and abs(told["a"]["unmet"] - (total / 11 - 40)) < 1e-6 and told["a"]["supply"] == 10
    every = mx.mix(docs, *args, max_epochs=None).collect()
    assert sum(r["_tokens"] for r in every if r["source"] == "a") == 60 and max(r["_epoch"] for r in every) == 5
    assert all(r["unmet"] == 0 for r in mx.unmet_demand(docs, *args, max_epochs=None).collect()) and mx.unmet_demand(docs.limit(0), *args).count() == 0


def test_any_names_and_many_null_ids(spark):
    rows = [(None, "a", "y" * (i % 97 * 4), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, `a.b` int").withColumn("c`d", F.lit(1))
    got = mx.mix(docs, {}, [0.0, 1.0], [1, 1])
    assert got.columns[:5] == ["doc_id", "source", "text", "a.b", "c`d"] and sorted(r["a.b"] for r in got.collect()) == list(range(400))
    first = [r["a.b"] for r in got.collect()]
    assert len({x % 97 for x in first[:40]}) > 8  # not one bucket in the order of the ids


def test_sql_without_a_limit_on_passes(spark, data):
    from tests.oracle import duck_rows, spark_rows

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for passes in (4, 2, None):
        mixed = mx.mix(docs, max_epochs=passes).select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_position").alias("position"))
        assert spark_rows(mixed) == duck_rows(mx.duck_sql(max_epochs=passes), data)
