"""Order-dependent and fixture-driven behaviour of the reference operators, against plain Python."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.functions import hashing, text as tx
from loomstone.operators import bpe, conversations as cv, evaluation as ev, linear_quality as lq, minhash as mh, mixture as mx, schedule as sc, shards as sh, vectors as vx
from loomstone.operators.prefix import global_running_sum
from loomstone.sources import files, presets, sinks
from loomstone.streaming import incremental as inc


def texts(spark, rows, **columns):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")


KOREAN = "저는 오늘 학교에 갑니다. 학교에서 공부를 합니다. " * 10


def test_cleaning_on_korean_and_boundaries(spark):
    rows = [KOREAN, KOREAN[:199], "plain English words " * 20, "abcdefghij" * 60, None, "", " 　\x1c\t", KOREAN + "x" * 2000]

    def keep(t, korean):
        solid = "".join(c for c in t if not c.isspace())
        share = sum("가" <= c <= "힣" for c in solid) / len(solid) if solid else 0.0
        grams = [t[i : i + 20] for i in range(0, len(t) - 20, 20)]
        repeated = 1 - len(set(grams)) / len(grams) if len(t) >= 40 else 0.0
        return len(t) >= 200 and not (korean and share < 0.3) and repeated <= 0.5

    got = texts(spark, rows).select(tx.keep_document("text").alias("k"), tx.keep_document("text", None).alias("a")).collect()
    assert [(r["k"], r["a"]) for r in got] == [(keep(t or "", True), keep(t or "", False)) for t in rows]


@pytest.mark.parametrize("length", [0, 1, 39, 40, 41, 59, 60, 61, 80, 81, 200])
def test_repetition_boundaries(spark, length):
    t = "a" * length
    grams = [t[i : i + 20] for i in range(0, len(t) - 20, 20)]
    want = 1 - len(set(grams)) / len(grams) if len(t) >= 40 else 0.0
    assert texts(spark, [t]).select(tx.gram_repetition("text")).first()[0] == pytest.approx(want)


def test_words_hash_and_lossy_decoding(spark):
    rows = ["한글abc123 x!?", "", "é🎉 a　b"]
    kind = lambda c: "k" if "가" <= c <= "힣" else "d" if c in "0123456789" else "l" if c.isascii() and c.isalpha() else None

    def split(t):
        out, last = [], None
        for c in t:
            k = kind(c)
            if k and k == last:
                out[-1] += c
            elif not c.isspace():
                out.append(c)
            last = None if c.isspace() else k
        return out

    got = texts(spark, rows).select(tx.words("text").alias("w"), hashing.fnv1a("text").alias("h"), tx.code_points("text").alias("c")).collect()

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h % 2**18

    assert [r["w"] for r in got] == [split(t) for t in rows] and [r["h"] for r in got] == [fnv(t) for t in rows]
    assert got[1]["c"] == []
    raw = spark.createDataFrame([(bytearray(b"ok \xff \xea\xb0\x80"),)], "raw binary")
    assert raw.select(tx.decode_lossy("raw")).first()[0] == "ok � 가"


STRINGS = ["안녕하세요, 세상!", "BPE test 🎉 漢字 かな 123,456원 it's WE'LL", "  blanks   and\nlines\t tab \r\n\n end ", "", "<|eos|>", "don't 12345 　 x"]
CORPUS = ["안녕하세요. 저는 학생입니다.", "오늘 학교에 갑니다. 학교에서 공부합니다.", "The quick brown fox jumps. It's a test 12345."] * 20


def test_pretokens_in_the_jvm_equal_python_and_round_trip(spark):
    rows = STRINGS + CORPUS[:3]
    got = [r["p"] for r in texts(spark, rows).select(bpe.pretokens().alias("p")).collect()]
    assert got == [bpe.pretokenize(t) for t in rows] and ["".join(p) for p in got] == rows
    assert bpe.pretokenize("나는 집에 간다") == ["나는", " 집에", " 간다"]


def slow_bpe(corpus, vocab):
    """Recounts everything before each merge."""
    words = {}
    for t in corpus:
        for c in bpe.pretokenize(t):
            words[c] = words.get(c, 0) + 1
    parts = {w: list(w.encode()) for w in words}
    merges = []
    while len(merges) < vocab - 256 - len(bpe.SPECIAL):
        count = {}
        for w, ids in parts.items():
            for p in zip(ids, ids[1:]):
                count[p] = count.get(p, 0) + words[w]
        if not count:
            break
        best = min(count, key=lambda p: (-count[p], p))
        parts = {w: bpe.replace_pair(ids, best, 256 + len(merges)) for w, ids in parts.items()}
        merges.append(best)
    return merges


def test_bpe_training_encoding_decoding_and_files(spark, tmp_path):
    model = bpe.train(texts(spark, CORPUS), 420)
    assert model.merges == slow_bpe(CORPUS, 420) and 256 < model.size <= 420
    tiny = bpe.learn({"ab": 3}, 600)
    assert tiny.merges == [(97, 98)] and tiny.special_ids["<|bos|>"] == 257
    for t in STRINGS:
        assert model.decode(model.encode(t)) == t
    assert len(model.encode("안녕하세요")) < len("안녕하세요".encode())
    chat = f"{bpe.SPECIAL[3]}user\n반가워{bpe.SPECIAL[4]} 끝"
    assert model.special_ids["<|im_start|>"] in model.encode(chat, True) and model.decode(model.encode(chat, True)) == chat
    assert not set(model.encode(chat)) & set(model.special_ids.values()) and model.decode(model.encode(chat)) == chat
    assert model.encode("<|eos|>") != [model.special_ids["<|eos|>"]] == model.encode("<|eos|>", True)
    with pytest.raises(IndexError):
        model.decode([10**6])
    assert model.decode([0xFF, 97]) == "�a"
    model.save(str(tmp_path / "t.json"))
    again = bpe.Bpe.load(str(tmp_path / "t.json"))
    assert again.merges == model.merges and again.encode(chat, True) == model.encode(chat, True)
    docs = texts(spark, STRINGS[:3] + [None])
    ids = bpe.encode_documents(docs, model)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: model.encode(t) + [model.special_ids["<|eos|>"]] for i, t in enumerate(STRINGS[:3])}
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids, model).collect()} == {i: t + "<|eos|>" for i, t in enumerate(STRINGS[:3])}


def test_greedy_filter_keeps_the_ends_of_a_chain(spark):
    chain = [(1, 0, "x"), (2, 0, "x"), (2, 1, "y"), (3, 1, "y")]
    kept = mh.greedy_keep(spark.createDataFrame(chain, "doc_id bigint, band int, key string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def first_come(rows):
    seen, kept = set(), []
    for d, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        keys = {r[1:] for r in group}
        if not keys & seen:
            seen |= keys
            kept.append(d)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_greedy_filter_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(d, b, str(rng.randrange(12))) for d in range(40) for b in range(3)]
    kept = mh.greedy_keep(spark.createDataFrame(rows, "doc_id bigint, band int, key string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == first_come(rows)


def test_exact_signatures_and_filter_on_documents(spark, data):
    perms, p = mh.permutations(), 2**61 - 1
    for t in ("abcd", "abcde", "some longer text with grams, 한글 too"):
        hashes = [int(hashlib.blake2b(t[i : i + 5].encode(), digest_size=8).digest()[::-1].hex(), 16) for i in range(len(t) - 4)]
        assert mh.exact_signature(t, perms) == [min(((a * h + b) % p for h in hashes), default=0) for a, b in perms]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bands = mh.exact_band_keys(docs).cache()
    want = first_come([(r["doc_id"], r["band"], bytes(r["key"])) for r in bands.collect()])
    assert sorted(r["doc_id"] for r in mh.greedy_keep(bands).collect()) == want and len(want) < docs.count()
    assert mh.exact_band_keys(docs, prefix=2000).count() == bands.count()


EDGES = st.sampled_from([0, 1, 2**30, 2**31 - 1, 2**31, 2**60, 2**61 - 2]) | st.integers(0, 2**61 - 2)


@settings(max_examples=500, deadline=None)
@given(EDGES, EDGES, EDGES)
def test_modular_product(a, b, h):
    got = mh.affine61(a, b, np.array([h >> 31], np.uint64), np.array([h % 2**31], np.uint64))
    assert int(got[0]) == (a * h + b) % (2**61 - 1)


def test_mixture_equals_a_loop_of_turns(spark):
    rng = random.Random(3)
    ratio = {"a": 0.5, "b": 0.3, "c": 0.2}
    docs = [(i, rng.choice("abc"), rng.randrange(1, 40), rng.random() > 0.3) for i in range(120)]
    target, val = 900, 0.1
    streams = {s: [d for d in docs if d[1] == s] for s in "abc"}
    got, order, total = dict.fromkeys("abc", 0), [], 0
    active = list("abc")
    while active:
        for s in list(active):
            if got[s] >= int(target * ratio[s]) or not streams[s]:
                active.remove(s)
                continue
            i, _, n, ok = streams[s].pop(0)
            if ok:
                got[s] += n
                order.append((i, total, "val" if total < target * val else "train"))
                total += n
    frame = spark.createDataFrame([(i, s, n, ok, ratio[s], "abc".index(s)) for i, s, n, ok in docs], "doc_id bigint, source string, n_tok int, ok boolean, ratio double, source_idx int")
    plan = mx.validation_prefix(mx.within_budget(mx.turns(frame, ["doc_id"]).where("ok"), target, ["rn"]), target, val, ["rn", "source_idx"])
    assert [(r["doc_id"], r["before"], r["split"]) for r in plan.orderBy("before").collect()] == order


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_and_budgets_settle_like_the_loop(spark, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice("abc"), rng.randrange(1, 20), [(b, str(rng.randrange(9))) for b in range(2)] if rng.random() < 0.8 else []) for i in range(60)]
    budget, got, seen, kept = 90, dict.fromkeys("abc", 0), set(), []
    for i, s, n, keys in docs:
        if got[s] < budget and not set(keys) & seen:
            seen |= set(keys)
            got[s] += n
            kept.append(i)
    frame = spark.createDataFrame([(i, s, 0.3, n) for i, s, n, _ in docs], "ord bigint, source string, ratio double, n_tok int")
    bands = spark.createDataFrame([(i, b, k) for i, _, _, keys in docs for b, k in keys], "ord bigint, band int, key string")
    assert sorted(r["ord"] for r in mx.unique_within_budget(frame, bands, 301).collect()) == kept


def test_presets_and_generated_batches(spark):
    assert presets.presets(spark).count() == 5 and presets.prompts(spark).count() == 4
    a, b = (presets.random_batches(spark.newSession() if k else spark, 3, 4, 50, 1000, 7).orderBy("step", "row").collect() for k in (0, 1))
    assert a == b and len(a) == 12 and all(len(r["ids"]) == 50 and 0 <= min(r["ids"]) <= max(r["ids"]) < 1000 for r in a)
    assert spark.createDataFrame([("a<|eos|>b",)], "t string").select(cv.printable(F.col("t"))).first()[0] == "a[end of document]b"


def test_mix_table_is_validated(spark):
    with pytest.raises(ValueError):
        mx.mix_table(spark, [mx.Source("a", 1.0, repeat=2, dedup=True)])
    with pytest.raises(ValueError):
        mx.mix_table(spark, [mx.Source("a", 0.5), mx.Source("a", 0.5)])
    assert mx.mix_table(spark, [mx.Source("a", 0.5, threshold=0.3), mx.Source("b", 0.5, repeat=3, dedup=False)]).count() == 2


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_running_sum_over_partitions(spark, partitions):
    rng = random.Random(5)
    rows = [(i, rng.randrange(10)) for i in rng.sample(range(1000), 200)]
    got = {r["k"]: (r["s"], r["t"]) for r in global_running_sum(global_running_sum(spark.createDataFrame(rows, "k bigint, v int"), ["k"], "v", "s", partitions), ["k"], "v", "t", partitions, True).collect()}
    at = 0
    for k, v in sorted(rows):
        assert got[k] == (at, at + v)
        at += v


def test_shards_and_windows_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 65_536, n).tolist() for n in (5, 0, 130, 1, 64, 300)]
    stream = [t for d in docs for t in d]
    rows, at = [], 0
    for i, d in enumerate(docs):
        rows.append((i, d, len(d), at))
        at += len(d)
    cut = sh.pieces(spark.createDataFrame(rows, "doc_id int, t array<int>, n_tok bigint, start bigint"), 64).withColumn("tok", F.expr("slice(t, CAST(doc_off + 1 AS INT), CAST(length AS INT))"))
    chunks = sh.chunked(cut, ["shard_idx"])
    names = {r["file"]: r["n"] for r in sinks.write_raw_shards(chunks, str(tmp_path), "train").collect()}
    assert names == {f"train_{k:06d}.bin": min(64, 500 - 64 * k) for k in range(8)}
    back = files.raw_shards(spark, str(tmp_path), "train").orderBy("shard_idx").collect()
    assert [t for r in back for t in r["tok"]] == stream
    starts = sh.window_starts(spark, 7, 5, 4, len(stream), 100)
    for r in sh.gather(starts, chunks.withColumnRenamed("shard_idx", "chunk_idx"), 64, 100).collect():
        assert 0 <= r["start"] < len(stream) - 101
        assert r["x"] == stream[r["start"] : r["start"] + 100] and r["y"] == stream[r["start"] + 1 : r["start"] + 101]
    assert sorted(sh.window_starts(spark, 7, 5, 4, 500, 100).collect()) == sorted(starts.collect()) != sorted(sh.window_starts(spark, 8, 5, 4, 500, 100).collect())
    with pytest.raises(ValueError):
        sh.window_starts(spark, 7, 1, 1, 101, 100)
    with pytest.raises(FileNotFoundError):
        files.raw_shards(spark, str(tmp_path), "val")
    with pytest.raises(Exception, match="16 bits"):
        sinks.write_raw_shards(spark.createDataFrame([(0, [70_000])], "shard_idx bigint, tok array<int>"), str(tmp_path / "x"), "train").collect()


def test_linear_model_separates_and_survives_a_file(spark, tmp_path):
    good, bad = [f"the history of river {i} and its old towns" for i in range(40)], [f"buy cheap pills {i} click now sale" for i in range(40)]
    docs = texts(spark, good + bad + ["", "!"])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80) if i % 4], "doc_id bigint, quality int")
    weights, bias = lq.train(docs, labels)
    feats = lq.features(docs)
    norms = feats.groupBy("doc_id").agg(F.sum(F.col("val") * F.col("val")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)
    got = {r["doc_id"]: r["score"] for r in lq.score(feats, docs, weights, bias).collect()}
    assert all((got[i] > 0.5) == (i < 40) for i in range(80)) and got[80] == 0.0 and 0 < got[81] < 1
    lq.save(spark, weights, bias, str(tmp_path / "m"))
    w, b = lq.load(spark, str(tmp_path / "m"))
    assert (w == weights).all() and b == bias
    assert lq.bucket_counts(docs, max_words=2).groupBy("doc_id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] == 3


def test_examples_masks_and_batches(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello there"), (2, 0, "user", "x" * 90), (2, 1, "assistant", "cut off"), (3, 0, "user", ""), (3, 1, "assistant", "none"), (4, 0, "user", "<|im_end|>"), (4, 1, "assistant", "yes, fine")]
    pairs = cv.turn_pairs(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert sorted(r["conv_id"] for r in pairs.collect()) == [1, 2, 4]
    made = cv.examples(pairs, 110)
    rows = {r["conv_id"]: r for r in made.collect()}
    assert set(rows) == {1, 4}  # of the long one fewer than four answer ids are left
    ctx = [cv.IM_START, *map(ord, "user\nhi"), cv.IM_END, cv.IM_START, *map(ord, "assistant\n")]
    ans = [*map(ord, "hello there"), cv.IM_END]
    assert rows[1]["ids"] == ctx + ans and rows[1]["mask"] == [0] * len(ctx) + [1] * len(ans)
    assert rows[4]["ids"].count(cv.IM_END) == 2
    spaced = {r["conv_id"]: r["ids"] for r in cv.examples(pairs, 110, newline_between_turns=True).collect()}
    assert spaced[1][8] == cv.IM_END and spaced[1][9] == 10
    batch = cv.batches(made, 2, ["conv_id"]).orderBy("conv_id").collect()
    size = max(len(r["ids"]) for r in rows.values()) - 1
    for r in batch:
        ids, mask = rows[r["conv_id"]]["ids"], rows[r["conv_id"]]["mask"]
        assert r["x"] == ids[:-1] + [cv.PAD] * (size - len(ids) + 1)
        assert r["y"] == [i if m else cv.IGNORE for i, m in zip(ids[1:], mask[1:])] + [cv.IGNORE] * (size - len(ids) + 1)
    assert cv.batches(made, 3, ["conv_id"]).count() == 0


def test_examples_with_the_ids_of_a_vocabulary(spark):
    model = bpe.learn({c: 3 for t in CORPUS for c in bpe.pretokenize(t)}, 420)
    opening, closing = model.special_ids["<|im_start|>"], model.special_ids["<|im_end|>"]
    said = [(1, "hi <|im_end|>", "hello there"), (2, "x" * 90, "cut off"), (3, "quick", "ok"), (4, "한글", "학교에서 공부합니다")]
    pairs = spark.createDataFrame([(c, 0, u, a) for c, u, a in said], "conv_id bigint, turn bigint, user string, assistant string")
    want = {}
    for c, u, a in said:
        head = [opening] + model.encode("user\n" + u) + [closing, opening] + model.encode("assistant\n")
        ids = (head + model.encode(a) + [closing])[:80]
        if len(ids) - len(head) >= 4:
            want[c] = (ids, [int(k >= len(head)) for k in range(len(ids))])
    got = {r["conv_id"]: (r["ids"], r["mask"]) for r in cv.token_examples(pairs, model, 80).collect()}
    assert got == want and set(want) == {1, 4} and got[1][0].count(closing) == 2
    assert cv.token_examples(pairs.limit(0), model, 80).count() == 0


def test_evaluation_ties_masks_and_formats(spark):
    logp = [(1, 0, -1.0), (1, 1, -0.5), (1, 1, -0.5), (2, 0, -3.0), (2, 1, -2.0)]
    chosen = ev.choose(spark.createDataFrame(logp, "item int, choice int, logp double"))
    assert sorted((r["item"], r["choice"]) for r in chosen.collect()) == [(1, 0), (2, 1)]
    got = ev.accuracy(chosen, spark.createDataFrame([(1, 0), (2, 0)], "item int, label int")).first()
    assert (got["accuracy"], got["total"]) == (0.5, 2)
    loss = spark.createDataFrame([(1.0, 3), (5.0, -100), (2.0, 4)], "l double, t int")
    assert loss.agg(ev.masked_mean(F.col("l"), F.col("t"))).first()[0] == 1.5
    assert loss.where("t = -100").agg(ev.masked_mean(F.col("l"), F.col("t"))).first()[0] == 0.0
    items = spark.createDataFrame([(0, "비가 왔다", "원인", "구름", "해", 0), (1, "문이 열렸다", "결과", "들어갔다", "잤다", 0)], "id int, premise string, question string, alternative_1 string, alternative_2 string, label int")
    made = ev.formatted(items, "copa")
    assert [r["ctx"] for r in made.orderBy("id").collect()] == ["비가 왔다 왜냐하면 ", "문이 열렸다 그래서 "]
    prefix = ev.few_shot(made, 1)
    assert prefix.first()["prefix"] == "비가 왔다 왜냐하면 구름\n\n" and ev.few_shot(made, 0).first()["prefix"] == ""
    rows = ev.prompts(prefix, made).orderBy("id", "choice").collect()
    assert len(rows) == 4 and all(r["start"] == len(r["context"]) for r in rows)
    boolq = ev.formatted(spark.createDataFrame([(0, "글", "맞나", 1)], "id int, paragraph string, question string, label int"), "boolq").first()
    assert boolq["ctx"] == "글\n질문: 맞나\n답: " and boolq["choices"] == ["아니오", "예"]
    with pytest.raises(ValueError):
        ev.formatted(items, "other")


def test_schedules(spark):
    lr = {r["step"]: r["lr"] for r in sc.steps(spark, 100).select("step", sc.warmup_stable_decay(F.col("step"), 1.0, 0.1, 10, 100).alias("lr")).collect()}
    assert lr[0] == 0.1 and lr[9] == lr[79] == 1.0 and lr[80] == 1.0 and abs(lr[90] - 0.55) < 1e-12
    cos = {r["step"]: r["lr"] for r in sc.steps(spark, 21).select("step", sc.warmup_cosine(F.col("step"), 1.0, 0.0, 0, 20).alias("lr")).collect()}
    assert cos[0] == 1.0 and abs(cos[10] - 0.5) < 1e-12 and abs(cos[20]) < 1e-12
    hits = [r["step"] for r in sc.steps(spark, 31).where(sc.periodic(F.col("step"), 10, 25)).collect()]
    assert hits == [10, 20, 25, 30]


def test_vectors_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=8)
    row = spark.createDataFrame([(x.tolist(), 3, 5)], "v array<double>, t int, p int").select(
        vx.softmax(F.col("v")).alias("s"), vx.cross_entropy(F.col("v"), F.col("t")).alias("c"), vx.rms_norm(F.col("v")).alias("n"), vx.rotate_pairs(F.col("v"), F.col("p")).alias("r")
    ).first()
    soft = np.exp(x) / np.exp(x).sum()
    assert np.allclose(row["s"], soft) and np.isclose(row["c"], -np.log(soft[3])) and np.allclose(row["n"], x / np.sqrt((x**2).mean() + 1e-5))
    turned = (x[0::2] + 1j * x[1::2]) * np.exp(1j * 5 * 10000.0 ** (-np.arange(0, 8, 2) / 8))
    assert np.allclose(row["r"], np.stack([turned.real, turned.imag], axis=1).ravel())


def test_files_listings_and_sinks(spark, data, tmp_path):
    assert files.list_tables(spark, data)[:3] == ["benchmark", "conversations", "customer"]
    assert files.row_count(f"{data}/documents.parquet") == spark.read.parquet(f"{data}/documents.parquet").count()
    part = files.read_parts(spark, [f"{data}/region.parquet", f"{data}/missing.parquet", f"{data}/region.parquet"])
    assert part.groupBy("part").count().count() == 2
    with pytest.raises(FileNotFoundError):
        files.read_parts(spark, [f"{data}/missing.parquet"])
    rows = spark.createDataFrame([(4000, 1.5), (None, 2.0)], "step int, ppl double")
    sinks.append_metrics(rows, str(tmp_path / "m"))
    sinks.append_metrics(spark.createDataFrame([(8000, None)], "step int, ppl double"), str(tmp_path / "m"))
    done = files.finished_steps(spark, str(tmp_path / "m"))
    assert sorted(r["step"] for r in done.collect()) == [4000, 8000]
    for step in (4000, 8000, 12_000):
        (tmp_path / f"step_{step:06d}.pt").write_bytes(b"x")
    listed = files.step_files(spark, str(tmp_path), "step_*.pt")
    assert [r["step"] for r in listed.collect()] == [4000, 8000, 12_000]
    assert [r["step"] for r in ev.pending(listed, done).collect()] == [12_000]
    sinks.write_summary(spark.createDataFrame([("a", 5, 3, 2), ("b", 7, 4, 4)], "source string, got int, seen int, kept int"), str(tmp_path / "s"), shard_tokens=64)
    held = json.loads(next((tmp_path / "s").glob("part*.json")).read_text())
    assert held["tokens"] == 12 and held["shard_tokens"] == 64 and [s["source"] for s in held["sources"]] == ["a", "b"]
    path = sinks.save_snapshot(rows, str(tmp_path / "snap"), 4000)
    sinks.save_snapshot(rows.limit(0), str(tmp_path / "snap"), 4000)
    assert path.endswith("step_004000") and spark.read.parquet(path).count() == 2
    watched, seen = sinks.observed(spark.createDataFrame([(3,), (4,)], "n int"), "run", "n")
    watched.collect()
    assert seen.get == {"docs": 2, "tokens": 7}


def test_streams_equal_batches(spark, tmp_path):
    docs = [(i, (KOREAN if i % 3 else "short") + ("x" * (i // 4) if i % 2 else "")) for i in range(24)]
    for k in range(3):
        spark.createDataFrame(docs[k * 8 : k * 8 + 8], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    inc.run_once(inc.clean_stream(inc.file_stream(spark, str(tmp_path / "in")), tx.HANGUL), str(tmp_path / "out"))
    want = {r["doc_id"] for r in whole.where(tx.keep_document("text")).collect()}
    assert {r["doc_id"] for r in spark.read.schema("doc_id bigint, text string").parquet(str(tmp_path / "out")).collect()} == want
    filt = inc.DuplicateFilter(spark, str(tmp_path / "dup"))
    kept = {r["doc_id"] for r in filt.run(inc.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "dup-state")).collect()}
    bands = [(r["doc_id"], r["band"], bytes(r["key"])) for r in mh.exact_band_keys(whole).collect()]
    assert kept == set(first_come(bands))
    assert filt.run(inc.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "dup-state")).count() == len(kept)
    (tmp_path / "snaps").mkdir()
    (tmp_path / "snaps" / "step_000100.pt").write_bytes(b"x")
    q = inc.new_files(spark, str(tmp_path / "snaps"), "step_*.pt").writeStream.format("memory").queryName("snaps").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["step"] for r in spark.table("snaps").collect()] == [100]
