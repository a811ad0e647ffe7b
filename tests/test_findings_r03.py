"""What the third round's findings changed: the whole job in bounded memory or less time, with the same results."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.operators import bpe, linear_quality as lq, minhash as mh
from loomstone.plans import vector_plans


@pytest.mark.parametrize("seed", range(5))
def test_packed_merges_equal_learning_on_lists(seed):
    draw = random.Random(seed)
    counts = {"".join(draw.choice("aab") for _ in range(draw.randint(1, 9))): draw.randint(1, 5) for _ in range(40)}
    some = {c: n for c, n in counts.items() if len(c) > 1}
    ids, n = bpe._packed([c.encode() for c in some], np.uint16), np.array(list(some.values()))
    total, merges = bpe._Totals({}), []
    total.add(*bpe._summed(*bpe._weights(ids, n, np.arange(len(ids) - 1))))
    while len(merges) < 12 and (key := total.best()) is not None:
        merges.append((key >> 32, key & 0xFFFFFFFF))
        ids, *change = bpe.merge_packed(ids, n, merges[-1], 255 + len(merges))
        total.add(*change)
    assert merges == bpe.learn(counts, 256 + len(bpe.SPECIAL) + 12).merges


@pytest.mark.parametrize("sample", [400_000, 20])
def test_vocabulary_learned_in_the_cluster_equals_the_drivers(spark, data, sample):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    counts = bpe.pretoken_counts(docs).localCheckpoint()
    want = bpe.learn({r["chunk"]: r["cnt"] for r in counts.collect()}, 340)
    assert bpe.learn_spread(counts, 340, sample=sample, most=12).merges == want.merges


def test_many_pretokens_do_not_come_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(bpe, "learn", None)
    docs = spark.createDataFrame([(i, f"abab aaa {i}") for i in range(50)], "doc_id bigint, text string")
    assert bpe.train(docs, 256 + len(bpe.SPECIAL) + 2, max_local=20).merges[0] == (97, 97)
    assert bpe.train(docs.where("false"), 300, max_local=-1).merges == []  # no pair at all


def odd_texts():
    draw = random.Random(3)
    wild = ["".join(chr(draw.randint(0, 0x10FFFF)) for _ in range(n)) for n in (4, 5, 6, 5000)]
    return ["", "abcd", "abcde", "가나다라마바", "aaaaaaaaaa", *wild, "the same words " * 40, "the same words and others " * 30]


@pytest.mark.parametrize("limits", [{}, {"block": 7, "cells": 50}])
def test_grams_hashed_once_for_many_texts_give_each_texts_minima(monkeypatch, limits):
    whole, perms, hashed = mh._minima, mh.permutations(), []
    monkeypatch.setattr(mh, "_minima", lambda texts, hash_of, *rest: whole(texts, lambda t, at: (hashed.append(len(at)), hash_of(t, at))[1], *rest, **limits))
    texts = odd_texts()
    assert mh.exact_signatures(texts, perms).tolist() == [mh.exact_signature(t, perms) for t in texts]
    assert limits or sum(hashed) == len({t[i : i + 5] for t in texts for i in range(len(t) - 4)})
    draws = mh.permutations(mh.PERMUTATIONS, mh.MERSENNE31)
    want = [[min(((a * int(h) + b) % mh.MERSENNE31 for h in mh.gram_hashes28(t)), default=0) for a, b in draws] for t in texts]
    assert mh.signatures28(texts).tolist() == want


ODD_DOCS = [(1, "ab cd ab cd 가나 12"), (2, "x"), (2, "x y"), (3, ""), (4, None), (None, "ab cd"), (5, "! ? !")]


def test_word_features_are_summed_where_the_text_is(spark):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id bigint, text string")
    counts = lq.bucket_counts(docs).groupBy("doc_id").agg(F.count("*").alias("f"), F.sum("n").alias("t"))
    sizes = lq.feature_sizes(docs)
    got = sizes.groupBy("doc_id").agg(F.sum("n_features").alias("f"), F.sum("terms").alias("t"))
    assert set(map(tuple, got.collect())) == set(map(tuple, counts.collect())) and sizes.count() == 5
    totals = {r["idx"]: r["n"] for r in lq.bucket_totals(docs).collect()}
    assert totals == {r["idx"]: r["n"] for r in lq.bucket_counts(docs).groupBy("idx").agg(F.sum("n").alias("n")).collect()}
    weights = np.random.default_rng(0).normal(size=lq.BUCKETS).astype(np.float32)
    want = sorted((r["doc_id"] or 0, r["score"]) for r in lq.score(lq.features(docs), docs, weights, 0.25).collect())
    have = sorted((r["doc_id"] or 0, r["score"]) for r in lq.score_texts(docs, weights, 0.25).collect())
    assert [d for d, _ in have] == [d for d, _ in want] and np.allclose([s for _, s in have], [s for _, s in want])
    row, idx, n = lq._term_buckets(pa.array([["a", "b", "a", "b"], ["é"]]), lq.BUCKETS)
    h = (lq.word_hashes(["a", "b", "a\0b", "b\0a", "é"]) % np.uint64(lq.BUCKETS)).tolist()
    assert sorted(zip(row.tolist(), idx.tolist(), n.tolist())) == sorted(zip([0, 0, 0, 0, 1], h, [2, 2, 2, 1, 1]))
    parts = lq._parts(pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([["a"] * 5, ["b"], ["c"] * 9])], names=["d", "w"]), most=4)
    assert [r for p in parts for r in p.column(0).to_pylist()] == [1, 2, 3]


def test_words_are_not_shuffled_to_their_vectors(spark):
    docs = spark.createDataFrame([(1, "ab a abc ab"), (2, None), (3, ""), (None, "a")], "doc_id bigint, text string")
    rows = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5), (2, 2.75), (9, 9.5)], "vec_id bigint, first double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vector_plans._looked_up(docs, rows)
        assert "SortMergeJoin [length" not in found._jdf.queryExecution().toString()
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted(got, key=str) == sorted([(1, 0, 2.5), (1, 0, 2.75), (1, 1, 1.5), (1, 3, 2.5), (1, 3, 2.75), (3, 0, 0.5), (None, 0, 1.5)], key=str)
