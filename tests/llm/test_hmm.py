import itertools
import math
import random

import numpy as np

from loomstone.llm import hmm


def random_model(states, symbols, seed):
    rng = np.random.default_rng(seed)
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Hmm(share(rng.random(states)), share(rng.random((states, states))), share(rng.random((states, symbols))))


def all_paths(m, seq):
    """Likelihood and expected counts by summing over every state path."""
    k = len(m.start)
    total, start, move, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[path[0], seq[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[b, o]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for s, o in zip(path, seq):
            emit[s, o] += p
    return total, start / total, move / total, emit / total


def test_forward_and_counts_equal_all_paths():
    m, rng = random_model(3, 5, 1), random.Random(2)
    seqs = [np.array([rng.randrange(5) for _ in range(n)], dtype=np.uint16) for n in (1, 6, 0, 3, 6, 2, 7)]
    want = [all_paths(m, s) if len(s) else (1.0, 0, 0, 0) for s in seqs]
    assert np.allclose(hmm.log_likelihoods(m, seqs), [math.log(w[0]) for w in want])
    counts = hmm.Counts(3, 5)
    counts.collect(m, seqs, rows=3)
    for have, i in ((counts.start, 1), (counts.move, 2), (counts.emit, 3)):
        assert np.allclose(have, sum(w[i] for w in want))
    assert np.isclose(counts.log_likelihood, sum(math.log(w[0]) for w in want))


def test_blocks_of_long_texts_give_the_plain_likelihood():
    m, rng = random_model(4, 9, 3), np.random.default_rng(4)
    seqs = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 10, 11, 57, 200, 1000)]
    plain = []
    for s in seqs:
        a, ll = m.start, 0.0
        for t, o in enumerate(s):
            a = (a if t == 0 else a @ m.move) * m.emit[:, o]
            ll += math.log(a.sum())
            a = a / a.sum()
        plain.append(ll)
    for block in (1, 10, 64, 4096):
        assert np.allclose(hmm.log_likelihoods(m, seqs, rows=5, block=block), plain, rtol=1e-10)


def one_piece(m, seq):
    """Log likelihood and expected counts of a sequence by the plain forward-backward recursion, one word after the other."""
    a, b, scale = [], np.ones(len(m.start)), []
    for t, o in enumerate(seq):
        now = (m.start if t == 0 else a[-1] @ m.move) * m.emit[:, o]
        scale.append(now.sum())
        a.append(now / scale[-1])
    move, emit = np.zeros_like(m.move), np.zeros_like(m.emit)
    for t in range(len(seq) - 1, -1, -1):
        emit[:, seq[t]] += a[t] * b
        if t:
            ahead = m.emit[:, seq[t]] * b / scale[t]
            move += np.outer(a[t - 1], ahead) * m.move
            b = m.move @ ahead
    return np.log(scale).sum(), a[0] * b, move, emit


def test_counts_of_texts_longer_than_a_block_equal_the_plain_recursion():
    """Starts are counted once for each text, and transitions across the borders of blocks are there."""
    rng = np.random.default_rng(6)
    for k, symbols in ((3, 5), (8, 40)):
        m = random_model(k, symbols, k)
        seqs = [rng.integers(0, symbols, n).astype(np.uint16) for n in (0, 1, 2, 7, 8, 9, 23, 24, 100, 731)]
        want = [one_piece(m, s) for s in seqs if len(s)]
        small = [s for s in seqs if 0 < len(s) < 9 and k == 3]
        for s in small:
            total, *counts = all_paths(m, s)
            assert np.isclose(one_piece(m, s)[0], math.log(total)) and all(np.allclose(a, b) for a, b in zip(one_piece(m, s)[1:], counts))
        for stretch in (1, 2, 8, 50, 4096):
            got = hmm.Counts(k, symbols)
            got.collect(m, seqs, rows=6, stretch=stretch)
            assert np.isclose(got.log_likelihood, sum(w[0] for w in want), rtol=1e-11, atol=0)
            for have, i in ((got.start, 1), (got.move, 2), (got.emit, 3)):
                assert np.allclose(have, sum(w[i] for w in want), rtol=1e-9, atol=1e-9)
            assert np.isclose(got.start.sum(), len(want)) and np.isclose(got.move.sum(), sum(len(s) - 1 for s in seqs if len(s)))


def test_training_does_not_depend_on_the_block(spark):
    _, df = docs(spark)
    words, counts = hmm.learn_words(df, 40, 8)
    encoded = hmm.encode(df.repartition(3), words)
    short, path = hmm.train(encoded, words, counts, states=3, rounds=4, stretch=5, seed=3)
    whole, same = hmm.train(encoded, words, counts, states=3, rounds=4, stretch=4096, seed=3)
    assert np.allclose(short.emit, whole.emit) and np.allclose(short.move, whole.move) and np.allclose(short.start, whole.start)
    assert np.allclose(path, same) and all(b >= a - 1e-6 for a, b in zip(path, path[1:]))


def docs(spark, n=120, seed=5):
    rng = random.Random(seed)
    lex = {"a": [f"alpha{i}" for i in range(30)], "b": [f"beta{i}" for i in range(30)]}
    rows = [(i, " ".join(rng.choice(lex["ab"[i % 2]]) for _ in range(rng.randrange(1, 60))), i, "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, n int, word string")


def test_words_are_counted_over_all_documents(spark):
    rows, df = docs(spark)
    tally = {}
    for _, t, *_ in rows:
        for w in t.split():
            tally[w] = tally.get(w, 0) + 1
    assert {r["word"]: r["n"] for r in hmm.word_counts(df.repartition(5), held=7).collect()} == tally
    for v in (1, 7, 59, 60, 500):
        words, counts = hmm.learn_words(df, v, 4)
        want = sorted(tally.items(), key=lambda x: (-x[1], x[0]))[:v]
        assert list(words.known) == [w for w, _ in want] and counts.tolist() == [n for _, n in want]


def test_training_rises_and_equals_one_process(spark):
    rows, df = docs(spark)
    words, counts = hmm.learn_words(df, 40, 8)
    encoded = hmm.encode(df.repartition(6), words)
    model, path = hmm.train(encoded, words, counts, states=2, rounds=8, stretch=1000, seed=3)
    assert all(b >= a - 1e-6 for a, b in zip(path, path[1:])) and path[-1] > path[0] + 10
    alone = hmm.initial(words, counts, float(sum(len(t.split()) for _, t, *_ in rows)), 2, 3)
    for _ in range(8):
        c = hmm.Counts(2, words.size)
        c.collect(alone, [words.symbols(t) for _, t, *_ in rows])
        alone = c.model()
    assert np.allclose(model.emit, alone.emit) and np.allclose(model.move, alone.move) and np.allclose(model.start, alone.start)
    got = {r["doc_id"]: r["log_likelihood"] for r in hmm.score(encoded, model).collect()}
    want = hmm.log_likelihoods(alone, [words.symbols(t) for _, t, *_ in rows])
    assert np.allclose([got[i] for i in range(len(rows))], want)


def test_stretches_cover_every_word(spark):
    _, df = docs(spark, 20)
    words, counts = hmm.learn_words(df, 40, 8)
    encoded = hmm.encode(df, words)
    n = sum(r["n_words"] for r in encoded.collect())
    found = hmm.expect(encoded, hmm.initial(words, counts, n, 3, 1), stretch=7)
    assert np.isclose(found.emit.sum(), n)


def test_unlikely_documents_score_lower(spark):
    rng = random.Random(8)
    rows = [(i, "the cat sat on the mat and the dog ran to the door " * 8) for i in range(40)] + [(99, " ".join(f"zq{rng.randrange(10**6)}" for _ in range(100)))]
    got = {r["doc_id"]: r["per_word"] for r in hmm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), states=2, vocabulary=50, buckets=16, rounds=3).collect()}
    assert got[99] == min(got.values()) and got[99] < got[0] - 1


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n ", 1), (None, "one two", 1), (4, "w " * 50_000, 1), (5, "same", 1), (5, "same", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, log_likelihood int")
    got = hmm.score_documents(df, states=2, vocabulary=4, buckets=2, rounds=1).collect()
    assert len(got) == len(rows)
    none = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert all(r["n_words"] == 0 and r["log_likelihood"] == 0 and r["per_word"] is None and r["perplexity"] is None for r in none)
    assert len({r["log_likelihood"] for r in got if r["doc_id"] == 5}) == 1 and all(math.isfinite(r["log_likelihood"]) for r in got)
    assert hmm.score_documents(df.limit(0)).count() == 0


def test_words_in_buckets_have_emissions_of_their_own(spark):
    """The whole score against one process with an emission for every word of the corpus: they add up to 1 in a state."""
    rows, df = docs(spark)
    rows = [*rows, *((1000 + i, "beta3 " * i + f"rare{i % 7} alpha1 " * (i % 5) + f"once{i}", i, "x") for i in range(30))]
    df = spark.createDataFrame(rows, df.schema)
    got = {r["doc_id"]: r for r in hmm.score_documents(df.repartition(3), states=3, vocabulary=40, buckets=4, rounds=3, seed=2).collect()}
    words, counts = hmm.learn_words(df, 40, 4)
    model, _ = hmm.train(hmm.encode(df, words), words, counts, states=3, rounds=3, stretch=512, seed=2)
    tally = {}
    for _, t, *_ in rows:
        for w in t.split():
            tally[w] = tally.get(w, 0) + 1
    number = {w: i for i, w in enumerate(tally)}
    symbol = {w: int(words.symbols(w)[0]) for w in tally}
    in_symbol = {s: sum(n for w, n in tally.items() if symbol[w] == s) for s in set(symbol.values())}
    emit = np.stack([model.emit[:, symbol[w]] * n / in_symbol[symbol[w]] for w, n in tally.items()], axis=1)
    assert len(tally) > 80 and np.allclose(emit.sum(axis=1), 1)
    want = hmm.log_likelihoods(hmm.Hmm(model.start, model.move, emit), [np.array([number[w] for w in t.split()], dtype=np.uint16) for _, t, *_ in rows])
    assert np.allclose([got[r[0]]["log_likelihood"] for r in rows], want)
    assert np.allclose([got[r[0]]["per_word"] for r in rows], want / [len(r[1].split()) for r in rows])


def test_chunks_do_not_change_symbols_or_words(spark):
    rows, df = docs(spark)
    words, _ = hmm.learn_words(df, 20, 4)
    for size in (0, 500, 1 << 20):
        chunks = {}
        out = hmm.encode_words(df.coalesce(1), words, chunk_bytes=size).collect()
        for r in out:
            mine = chunks.setdefault(r["chunk"], [])
            assert r["base"] == len(mine)
            mine += r["fresh"]
        for r, (_, text, *_) in zip(out, rows):
            assert np.array_equal(np.frombuffer(r["symbols"], np.uint16), words.symbols(text))
            assert [chunks[r["chunk"]][i] for i in np.frombuffer(r["rare"], np.uint32)] == [w for w in text.split() if w not in words.known]
        assert (len(chunks) == 1) == (size > 1000)
