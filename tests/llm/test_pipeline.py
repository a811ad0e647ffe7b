import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomstone.llm import gbdt, mixing, packing, simhash, tokens


@pytest.fixture(scope="module")
def staged(spark, data, tmp_path_factory):
    """The rows of every stage, each from the one before as run() feeds them."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    out["documents"] = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.toPandas()
    return out


def test_stages_are_the_dealt_ones(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixture", "packed"]
    for n in ("quality", "near_duplicates", "mixture"):
        assert list(staged[n].columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_clean_and_drops_rejected(spark, data, staged):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    forest = gbdt.train(docs, labels)
    p = {r.doc_id: forest.probability(np.array([gbdt.document_stats(r.text)]))[0] for r in staged["documents"].itertuples()}
    assert set(staged["quality"].doc_id) == {d for d, x in p.items() if x >= 0.5}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [d for d, q in truth.items() if q == 1]
    assert sum(d in set(staged["quality"].doc_id) for d in good) >= 0.98 * len(good)


def groups_of(ids, fp, accept):
    parent = {d: d for d in ids}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, j in itertools.combinations(range(len(ids)), 2):
        if simhash.distance(fp[i], fp[j]) <= accept:
            a, b = find(ids[i]), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def test_near_duplicates_against_all_pairs(staged):
    """Everything that pairs within the guaranteed 23 bits join is one document; nothing goes that pairs within the
    accepted 40 bits don't join; and of what those join, at least 0.9 is found."""
    rows = staged["quality"].sort_values("doc_id")
    fp, ids = simhash.fingerprints(rows.text.tolist()), rows.doc_id.tolist()
    sure, most = groups_of(ids, fp, 23), groups_of(ids, fp, 40)
    dropped = set(ids) - set(staged["near_duplicates"].doc_id)
    assert {d for d, g in sure.items() if d != g} <= dropped <= {d for d, g in most.items() if d != g}
    assert len(dropped) >= 0.9 * sum(d != g for d, g in most.items()) > 0


def test_mixture_is_the_operator_over_all_kept(spark, staged):
    rows = staged["near_duplicates"]
    want = Counter()
    supply, placed = Counter(), Counter()
    for r in rows.itertuples():
        supply[r.source] += -(-len(r.text.encode()) // 4) or 1
    frame = spark.createDataFrame(rows[["doc_id", "text", "source"]])
    for r in mixing.mix(frame).collect():
        want[r["doc_id"]] += 1
        placed[r["source"]] += r["_tokens"]
    assert Counter(staged["mixture"].doc_id) == want
    total = sum(supply.values())
    weights = {s: mixing.SCHEDULE.get(s, mixing.DEFAULT) for s in supply}
    for s, n in placed.items():
        at = [weights[s][k] / sum(w[k] for w in weights.values()) for k in range(3)]
        demand = min(total * (at[0] / 4 + at[1] / 2 + at[2] / 4), 4 * supply[s])
        longest = max(-(-len(r.text.encode()) // 4) for r in rows.itertuples() if r.source == s)
        assert demand - 1 <= n <= demand + longest + 1


def test_packing_holds_every_token_once(staged):
    enc = tokens.encoding(tokens.vocabulary_path())
    want = Counter()
    for r in staged["mixture"].itertuples():
        want[r.doc_id] += len(enc.encode_ordinary(r.text)) + 1
    got = Counter()
    for r in staged["packed"].itertuples():
        assert r.n_tokens == sum(p["length"] for p in r.pieces) <= 4096
        for p in r.pieces:
            got[p["doc_id"]] += p["length"]
    assert got == want


def test_run_gives_the_last_stage(spark, data, staged):
    rows = corpus_pipeline.run(spark, data).select("pack_group", "bin", "n_tokens", F.to_json("pieces").alias("p")).collect()
    assert len(rows) == len(staged["packed"]) and sum(r["n_tokens"] for r in rows) == int(staged["packed"].n_tokens.sum())


def test_stages_take_edge_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, and extra columns."""
    good = "Plain words make a quiet sentence here, and another one follows it in due course, number {}."
    rows = [(i, good.format(i) + f" word{i} term{i * i} item{i * 7} x{i * 31} y{i * 77} z{i * 13}" * 3, "en", f"src{i % 3}", 1, "a", 2) for i in range(30)]
    rows += [(50, None, None, None, None, None, None), (None, good.format(1), None, "src0", 1, "b", 2), (51, "", "en", None, 0, "c", 3), (52, "word " * 100_000, "en", "src1", 5, "d", 1), (3, *rows[3][1:]), rows[4], rows[4]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, position string, bucket int"
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for i, part in enumerate((rows, [])):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            if name != "packed":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert (docs.count() > 0) == bool(part)


def test_packing_follows_training_order(spark, tmp_path):
    """What the mixture writes in training order is packed in that order, whatever the sizes of its files."""
    rows = [(i * 7919 % 400, "en", f"src{i % 3}", 1, f"word{i} " * (2000 if i % 150 == 0 else 1 + i % 90)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, n_chars bigint, text string")
    parts = spark.createDataFrame([(p, *r) for p, r in zip((0 if i < 10 else 1 if i < 350 else 2 for i in range(400)), rows)], "p int, doc_id bigint, lang string, source string, n_chars bigint, text string")
    parts.repartitionById(3, F.col("p")).sortWithinPartitions(F.monotonically_increasing_id()).drop("p").write.parquet(str(tmp_path / "a"))
    mixing.mix(docs).write.parquet(str(tmp_path / "b"))
    places = {r["doc_id"]: [] for r in docs.collect()}
    for r in spark.read.parquet(str(tmp_path / "b")).collect():
        places[r["doc_id"]].append(r["_position"])
    ordered = {"a": {r[0]: i for i, r in enumerate(rows)}, "b": {d: p[0] for d, p in places.items() if len(p) == 1}}
    for name, at in ordered.items():
        read = spark.read.parquet(str(tmp_path / name))
        bins = sorted(corpus_pipeline.packed(spark, read, "").collect(), key=lambda r: (r["pack_group"], r["bin"]))
        first = [at[r["pieces"][0]["doc_id"]] for r in bins if r["pieces"][0]["doc_id"] in at]
        assert first == sorted(first) and len(first) >= 5
        ranges = {}
        for r in packing.pack_in_order(read, group_docs=30).collect():
            ranges.setdefault(r["pack_group"], []).extend(at[p["doc_id"]] for p in r["pieces"] if p["doc_id"] in at)
        ends = [(min(v), max(v)) for _, v in sorted(ranges.items()) if v]
        assert len(ends) > 5 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_stages_keep_columns_with_dots(spark, tmp_path):
    text = "Plain words make a quiet sentence here, and another one follows it in due course, number {} {} {}."
    docs = spark.createDataFrame([(i, text.format(i, i * 31, i * 77), "en", f"src{i % 3}", 1, i) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` int")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packed":
            assert docs.columns[-1] == "a.b" and all(r["a.b"] == r["doc_id"] for r in docs.collect())
    assert docs.count() > 0


def test_near_duplicates_drops_all_that_accepted_pairs_join(spark, monkeypatch):
    """The stage finds pairs at the last accepted bit, also those that share no key in tables of sampled bits."""
    from tests.llm.test_simhash import UNSEEN, unseen_pairs

    monkeypatch.setattr(simhash, "sign", lambda docs: docs)
    docs = spark.createDataFrame(unseen_pairs(), UNSEEN)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_near_duplicates_compares_texts_whatever_their_ids(spark):
    """Of all rows within 40 bits one stays, of the smallest id: also where rows share an id, repeat or have none."""
    rng = np.random.default_rng(6)
    word = lambda: f"w{rng.integers(10**9)}"
    rows = []
    for _ in range(40):
        words = [word() for _ in range(150)]
        for _ in range(rng.integers(1, 5)):
            copy = list(words)
            for k in rng.choice(150, rng.integers(0, 6), replace=False).tolist():
                copy[k] = word()
            doc = int(rng.integers(0, 25))
            rows += [(None if doc < 4 else doc, " ".join(copy))] * int(rng.integers(1, 3))
    rows += [(None, "word for word the same"), (None, "word for word the same"), (4, None), (None, None), (60, None)]
    frame = [(d, t, i, "x", 1, {"k": i % 2}) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(frame, "doc_id bigint, text string, row int, f0 string, `a.b` int, m map<string,int>").repartition(5)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.schema == docs.schema
    kept = sorted(r["row"] for r in got.collect())
    number = [i for i, (_, t) in enumerate(rows) if t is not None]
    group = groups_of(number, simhash.fingerprints([rows[i][1] for i in number]), 40)
    assert [i for i in kept if i not in group] == [len(rows) - 3, len(rows) - 2, len(rows) - 1]
    kept = {group[i]: rows[i][0] for i in kept if i in group}
    ids = {g: [rows[i][0] for i in number if group[i] == g] for g in group.values()}
    assert kept == {g: min((d for d in all_ids if d is not None), default=None) for g, all_ids in ids.items()}
    assert got.count() == len(ids) + 3 and None in kept.values()
    repeats = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f"), (2, "d e f"), (3, None)], "doc_id bigint, text string")
    assert sorted(corpus_pipeline.near_duplicates(spark, repeats, "").collect(), key=str) == [(1, "a b c"), (1, "d e f"), (3, None)]
