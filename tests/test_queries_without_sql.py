"""The registered reference queries without a DuckDB statement, row by row against plain Python over their own tables."""

import math
from collections import Counter

import numpy as np
import pytest

from loomstone.functions import text as tx
from loomstone.operators import bpe, minhash as mh
from loomstone.plans import catalog
from tests.test_operators import slow_bpe


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def keys(docs):
    """Band keys of each document that has a text, from its signature."""
    perms, rows = mh.permutations(), mh.PERMUTATIONS // mh.BANDS
    out = {}
    for d, r in docs.items():
        if r["text"] is not None:
            s = mh.exact_signature(r["text"], perms)
            out[d] = {(b, tuple(s[b * rows : (b + 1) * rows])) for b in range(mh.BANDS)}
    return out


def rows_of(spark, data, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, data).collect())


def loop(order, keys):
    seen, kept = set(), []
    for d in order:
        if d in keys and not keys[d] & seen:
            seen |= keys[d]
            kept.append(d)
    return kept


def test_pretoken_counts(spark, data, docs):
    want = Counter(c for r in docs.values() for c in bpe.pretokenize(r["text"] or ""))
    assert rows_of(spark, data, "pretoken_counts", "chunk", "cnt") == sorted(want.items())


def test_bpe_token_counts(spark, data, docs):
    model = bpe.train(spark.read.parquet(f"{data}/documents.parquet"), 1024)
    few = 32
    assert model.merges[:few] == slow_bpe([r["text"] for r in docs.values() if r["text"]], 256 + len(bpe.SPECIAL) + few)
    chunks = Counter()
    for r in docs.values():
        for c in bpe.pretokenize(r["text"] or ""):
            chunks[c, r["source"]] += 1
    coded = {}
    for c in {c for c, _ in chunks}:  # every merge in turn, over the whole chunk
        ids = list(c.encode())
        for k, (a, b) in enumerate(model.merges):
            if a in ids and b in ids:
                ids = bpe.replace_pair(ids, (a, b), 256 + k)
        coded[c] = len(ids)
    tokens, chars = Counter(), Counter()
    for (c, source), n in chunks.items():
        tokens[source] += n * coded[c]
    for r in docs.values():
        chars[r["source"]] += len(r["text"] or "")
        tokens[r["source"]] += r["text"] is not None  # the end token
    got = {r["source"]: (r["tokens"], r["chars_per_token"]) for r in catalog.queries()["bpe_token_counts"](spark, data).collect()}
    assert {s: n for s, (n, _) in got.items()} == dict(tokens)
    assert all(math.isclose(share, chars[s] / tokens[s]) for s, (_, share) in got.items())


@pytest.mark.parametrize("name", ["near_dup_kept", "stream_duplicate_filter"])
def test_duplicate_filters(spark, data, docs, keys, name):
    want = loop(sorted(docs), keys)
    assert rows_of(spark, data, name, "doc_id") == [(d,) for d in want] and len(want) < len(docs)


def test_budgeted_unique(spark, data, docs, keys):
    turn, at = {}, Counter()
    for d in sorted(docs):
        at[docs[d]["source"]] += 1
        turn[d] = at[docs[d]["source"]]
    budget, got, seen, want = math.floor(1_000_000 * 0.05), Counter(), set(), []
    for d in sorted(docs, key=lambda d: (turn[d], docs[d]["source"])):
        source, mine = docs[d]["source"], keys.get(d, set())
        if got[source] < budget and not mine & seen:
            seen |= mine
            size = len(docs[d]["text"].encode())
            got[source] += size
            want.append((d, source, size))
    assert rows_of(spark, data, "budgeted_unique", "doc_id", "source", "n_tok") == sorted(want) and len(want) < len(docs)


def test_quality_scores(spark, data, docs):
    """Sequential SGD over dictionaries, a weight at a time."""

    def fnv(term):
        h = 2166136261
        for b in term.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h % 2**18

    split = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", tx.words("text").alias("w")).collect()  # tested by itself
    vectors, known = {}, {}
    for r in split:
        w = r["w"] or []
        terms = [*w, *(f"{a}\0{b}" for a, b in zip(w, w[1:]))]
        n = Counter(known[t] if t in known else known.setdefault(t, fnv(t)) for t in terms)
        vectors[r["doc_id"]] = {i: math.sqrt(c) / math.sqrt(len(terms)) for i, c in n.items()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = [d for d in sorted(labels) if vectors.get(d)]
    weight, bias, shuffle = Counter(), 0.0, np.random.default_rng(0)
    for _ in range(3):
        for k in shuffle.permutation(len(ids)):
            v = vectors[ids[k]]
            slope = 1 / (1 + math.exp(-(sum(weight[i] * x for i, x in v.items()) + bias))) - labels[ids[k]]
            for i, x in v.items():
                weight[i] -= 0.5 * (slope * x + 1e-6 * weight[i])
            bias -= 0.5 * slope
    got = {r["doc_id"]: r["score"] for r in catalog.queries()["quality_scores"](spark, data).collect()}
    assert set(got) == set(docs)
    for d, score in got.items():
        v = vectors.get(d)
        want = 1 / (1 + math.exp(-(sum(weight[i] * x for i, x in v.items()) + bias))) if v else 0.0
        assert math.isclose(score, want, abs_tol=1e-4), d
