import math

import numpy as np
import zstandard

from loomstone.llm import gbdt


def naive_stats(text):
    """One character at a time, from the definitions."""
    text = text or ""
    raw = text.encode()
    if not raw:
        return dict.fromkeys(gbdt.STATS, 0.0)
    n, words = len(raw), text.split()
    lines = [x for x in text.split("\n") if x]
    share = lambda f: sum(map(f, raw)) / n
    inside = lambda s: lambda b: chr(b) in s if b < 128 else False
    plain = lambda b: b >= 128 or chr(b).isalnum() or chr(b) in " \t\r\n"
    named = {"mark": "*$&%#@^~_=+", "shout": "!?", "pipe": "|", "stop": ".,;:", "bracket": "()[]{}<>\"'", "slash": "/\\"}
    edges, i = 0, 0
    solid = lambda c: not (c.isalnum() or c == "_" or c.isspace())
    while i < len(text) - 1:
        if solid(text[i]) and solid(text[i + 1]):
            edges, i = edges + 1, i + 2
        else:
            i += 1
    w = max(1, len(words))
    return {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "bytes_per_word": n / w, "chars_per_byte": len(text) / n,
        "upper": share(lambda b: 65 <= b <= 90), "digit": share(lambda b: 48 <= b <= 57), "space": share(inside(" \t\r\n")), "newline": share(inside("\n")),
        **{k: share(inside(v)) for k, v in named.items()},
        "other": 1 - share(plain) - sum(share(inside(v)) for v in named.values()), "distinct_words": len(set(words)) / w,
        "top_word": max((words.count(x) for x in words), default=0) / w, "twin_words": sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w,
        "distinct_lines": len(set(lines)) / max(1, len(lines)), "log_line_words": math.log1p(len(words) / max(1, len(lines))),
        "compressed": len(zstandard.ZstdCompressor(level=1).compress(raw)) / n, "capital_words": sum(x.isupper() for x in words) / w, "marked_words": edges / w,
        "longest_word": math.log1p(max((len(x) for x in words), default=0)),
    }


def test_stats_match_definitions():
    for text in (None, "", " ", "\n\n", "a", "Été çà", "A!! B!! A!!\nA!! B!!", "x|y $$ (1/2) *** \"q\" ~`", "word " * 3000):
        want = naive_stats(text)
        assert np.allclose(gbdt.document_stats(text), [want[k] for k in gbdt.STATS]), text


def walk(forest, x):
    total = forest.base
    for node in forest.roots:
        while forest.left[node] != node:
            node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return total


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(gbdt.STATS))).round(1)  # many ties
    return x, ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)).astype(float)


def test_flat_traversal_equals_walk_and_generalises():
    x, y = sample(3000, 1)
    forest = gbdt.fit(x, y, trees=60, depth=4)
    held, truth = sample(1000, 2)
    assert np.allclose(forest.margin(held), [walk(forest, r) for r in held])
    assert ((forest.probability(held) > 0.5) == truth).mean() > 0.93
    assert np.allclose(forest.probability(held[:1]), 1 / (1 + np.exp(-walk(forest, held[0]))))


def test_first_split_is_the_best_of_all():
    x, y = sample(400, 3)
    forest = gbdt.fit(x, y, trees=1, depth=1, bins=64, l2=1.0)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = 0
    for j in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
            m = x[:, j] <= t
            if h[m].sum() >= 2 and h[~m].sum() >= 2:
                best = max(best, gain(m))
    assert math.isclose(gain(x[:, forest.feature[0]] <= forest.threshold[0]), best, rel_tol=1e-9)


def test_one_class_and_no_rows():
    x, _ = sample(20, 4)
    assert (gbdt.fit(x, np.ones(20)).probability(x) > 0.5).all()
    assert (gbdt.fit(x[:0], np.zeros(0)).probability(x) > 0.99).all()
    assert len(gbdt.fit(*sample(50, 5)).probability(x[:0])) == 0


def good(i):
    return f"Plain words of number {i} make a quiet sentence, and then another one follows it."


def bad(i):
    return f"BUY!! NOW!! {i}!! BUY!! NOW!! CHEAP!! CHEAP!! $$$ *** BUY!! NOW!!"


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score string, y int, quality string")
    return d, spark.createDataFrame(labels, "doc_id bigint, quality int, text string")


def test_pipeline_on_edge_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns named like those used inside."""
    docs = [(i, good(i) if i % 4 else bad(i), "s", i, "q") for i in range(200)]
    docs += [(200, None, None, None, None), (None, good(1), "x", 1, "x"), (201, "", "", 0, ""), (202, "word " * 200_000, "", 0, ""), (1, good(1), "s", 1, "q"), (1, good(1), "s", 1, "q")]
    labels = [(i, int(i % 4 > 0), "x") for i in range(0, 150)] + [(5, 1, "x"), (5, 1, "x"), (None, 1, None), (7, None, None), (999, 0, "")]
    d, lab = frames(spark, docs, labels)
    forest = gbdt.train(d, lab, trees=20)
    got = gbdt.score(d, forest).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    by = {r.doc_id: r.score for r in got.itertuples() if r.doc_id == r.doc_id}
    assert all((by[i] >= 0.5) == (i % 4 > 0) for i in range(150, 200))
    assert by[200] == by[201]
    kept = gbdt.keep_good(d, forest)
    assert kept.columns == d.columns
    want = sorted(map(str, (r for r, s in zip(docs, forest.probability(np.array([gbdt.document_stats(r[1]) for r in docs]))) if s >= 0.5)))
    assert sorted(str(tuple(r)) for r in kept.collect()) == want


def test_empty_tables(spark):
    d, lab = frames(spark, [], [])
    forest = gbdt.train(d, lab)
    assert gbdt.score(d, forest).count() == 0 and gbdt.keep_good(d, forest).count() == 0
    one, _ = frames(spark, [(1, "x", "", 0, "")], [])
    assert gbdt.keep_good(one, gbdt.train(one, lab)).count() == 1  # nothing is known, nothing is rejected


def test_training_sample_is_bounded_and_stable(spark):
    d, lab = frames(spark, [(i, good(i), "", 0, "") for i in range(50)], [(i, i % 2, "") for i in range(50)])
    ids = lambda n: {r["doc_id"] for r in gbdt.labelled_stats(d, lab, n, 17).collect()}
    assert len(ids(10)) == 10 and ids(10) < ids(20)
    d, lab = frames(spark, [(i, "text", "", 0, "") for i in range(3000)], [(i // 2, i % 2, "") for i in range(6000)])
    hashes = {r["doc_id"]: r["h"] for r in lab.select("doc_id", gbdt.F.xxhash64(gbdt.F.lit(17), "doc_id").alias("h")).collect()}
    assert ids(200) == set(sorted(hashes, key=hashes.get)[:200])  # by way of the bound on the hash


def test_columns_of_any_name_come_through(spark):
    docs = spark.createDataFrame([(i, "words and more words " * (i + 1), i, "x") for i in range(12)], "doc_id bigint, text string, `a.b` int, `c``d` string")
    forest = gbdt.train(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int"))
    assert gbdt.keep_good(docs, forest, 0.0).collect() == docs.collect()
