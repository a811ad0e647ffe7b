"""The registered queries over their whole tables: against their SQL, or against brute force on the same rows."""

from collections import Counter

import numpy as np
import pytest

from loomstone.llm import chat, gbdt, hmm, queries, simhash, tokens
from tests.oracle import duck_rows, spark_rows

RUN = queries.queries()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    assert spark_rows(RUN[name](spark, data)) == duck_rows(queries.oracle_sql()[name], data)


def test_ten_queries():
    assert sorted(int(n.split("_")[0][2:]) for n in RUN) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(RUN)


def test_op1_restores_every_row(spark, data, docs):
    got = RUN["op1_media_chunks"](spark, data).collect()
    size = {r.doc_id: len(r.text.encode()) for r in docs.itertuples() if r.text is not None}
    assert sorted(r["doc_id"] for r in got) == sorted(docs.doc_id) and all(r["restored"] for r in got if r["sha256"] is not None)
    assert all(r["n_bytes"] == sum(c["length"] for c in r["chunks"]) == size[r["doc_id"]] for r in got if r["sha256"] is not None)


def test_op2_scores_every_row(spark, data, docs):
    forest = gbdt.train(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    want = forest.probability(np.array([gbdt.document_stats(t) for t in docs.text]))
    got = {r["doc_id"]: r for r in RUN["op2_quality_classifier"](spark, data).collect()}
    assert all(np.isclose(got[d]["score"], p) and got[d]["keep"] == (p >= 0.5) for d, p in zip(docs.doc_id, want)) and len(got) == len(docs)


def test_op3_masks_are_the_trained_turns(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet").toPandas()
    got = {r["conv_id"]: r for r in RUN["op3_chat_masks"](spark, data).collect()}
    assert set(got) == set(turns.conv_id) and {c: r["n_turns"] for c, r in got.items()} == dict(Counter(turns.conv_id))
    roles = turns.groupby("conv_id").role.agg(set)
    for c, r in got.items():
        assert len(r["input_ids"]) == len(r["loss_mask"]) == r["n_tokens"] and sum(r["loss_mask"]) == r["n_trained"]
        assert (r["n_trained"] > 0) == ("assistant" in roles[c])
    assert chat.TOKENIZER


def test_op5_groups_hold_every_near_pair(spark, data, docs):
    got = {r["doc_id"]: r for r in RUN["op5_simhash_dedup"](spark, data).collect()}
    fp = simhash.fingerprints(docs.text.tolist())
    ids = docs.doc_id.tolist()
    near = [(a, b, int(simhash.distance(fp[a], fp[b]))) for a in range(len(ids)) for b in range(a)]
    assert all(got[ids[a]]["group_id"] == got[ids[b]]["group_id"] for a, b, d in near if d <= 23)
    accepted = {i: i for i in ids}
    for a, b, d in near:
        if d <= 40:
            x, y = accepted[ids[a]], accepted[ids[b]]
            accepted = {k: min(x, y) if v in (x, y) else v for k, v in accepted.items()}
    assert all(accepted[d] == accepted[r["group_id"]] and r["keep"] == (r["group_id"] == d) for d, r in got.items())


def test_op6_recall_over_the_whole_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x = np.stack(rows.embedding).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["vec_id"]: [n["id"] for n in r["neighbours"]] for r in RUN["op6_hnsw_neighbours"](spark, data).collect()}
    assert set(got) == {i for i in rows.vec_id if i % 20 == 0}
    hits, ids = 0, rows.vec_id.to_numpy()
    for i, row in enumerate(ids):
        if row % 20 == 0:
            d = 1 - x @ x[i]
            d[i] = np.inf
            hits += len(set(ids[np.argsort(d)[:10]]) & set(got[row]))
    assert hits >= 0.97 * 10 * len(got)


def test_op7_and_op8_hold_every_token(spark, data, docs):
    want = {d: len(ids) + 1 for d, ids in zip(docs.doc_id, tokens.encode(docs.text.tolist(), tokens.vocabulary_path()))}
    packed = Counter()
    for r in RUN["op7_sum_of_squares_packing"](spark, data).collect():
        assert r["n_tokens"] == sum(p["length"] for p in r["pieces"]) <= 4096
        for p in r["pieces"]:
            packed[p["doc_id"]] += p["length"]
    assert packed == want
    rows = RUN["op8_token_files"](spark, data).collect()
    files = tokens.TokenFiles(rows[0]["file"].rpartition("/")[0])
    enc = tokens.encoding(tokens.vocabulary_path())
    text = dict(zip(docs.doc_id, docs.text))
    assert len(rows) == len(docs) == len(files)
    for r in rows:
        assert files.read(r["start"], r["stop"]).tolist() == [*enc.encode_ordinary(text[r["doc_id"]]), tokens.END]


def test_op10_scores_every_word(spark, data, docs):
    got = {r["doc_id"]: r for r in RUN["op10_hmm_scores"](spark, data).collect()}
    assert {d: r["n_words"] for d, r in got.items()} == {d: len(t.split()) for d, t in zip(docs.doc_id, docs.text)}
    frame = spark.read.parquet(f"{data}/documents.parquet")
    words, counts = hmm.learn_words(frame, 8192, 256)
    model = hmm.initial(words, counts, float(sum(r["n_words"] for r in got.values())), 8, 11)
    seqs = [words.symbols(t) for t in docs.text]
    for _ in range(4):
        c = hmm.Counts(8, words.size)
        c.collect(model, seqs, stretch=10**9)  # whole texts, in one process
        model = c.model()
    tally = Counter(w for t in docs.text for w in t.split())
    bucket = Counter()
    for w, n in tally.items():
        if w not in words.known:
            bucket[words.bucket(w)] += n
    rare = [sum(np.log(tally[w] / bucket[words.bucket(w)]) for w in t.split() if w not in words.known) for t in docs.text]
    want = hmm.log_likelihoods(model, seqs) + np.array(rare)
    assert np.allclose([got[d]["log_likelihood"] for d in docs.doc_id], want, rtol=1e-6)
