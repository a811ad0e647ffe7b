import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import media as md

SMALL = (32, 64, 256)


def rolled(payload):
    """The gear hash one byte at a time."""
    h, out = 0, []
    for b in payload:
        h = ((h << 1) + int(md.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def brute_lengths(payload, sizes):
    low, mean, high = sizes
    bits, hashes, out, size = round(np.log2(mean)), rolled(payload), [], 0
    for h in hashes:
        size += 1
        if size >= low and (h >> (32 - bits) == 0) or size == high:
            out.append(size)
            size = 0
    return out + ([size] if size else [])


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000))
def test_cuts_equal_rolling_byte_by_byte(payload):
    assert md.gear_hashes(np.frombuffer(payload, np.uint8)).tolist() == rolled(payload)
    assert md.chunk_lengths(payload, SMALL) == brute_lengths(payload, SMALL)


def test_windows_do_not_matter():
    payload = random.Random(1).randbytes(50_000)
    bits = 6
    whole = [i + 1 for i, h in enumerate(rolled(payload)) if h >> (32 - bits) == 0]
    for window in (64, 1000, 1 << 20):
        assert md.candidates(payload, bits, window) == whole


def test_an_insertion_changes_few_chunks():
    payload = random.Random(2).randbytes(400_000)
    edited = payload[:200_000] + b"inserted" + payload[200_000:]
    a, b = ({hashlib.sha256(c).digest() for c in md.chunk_bytes(x)} for x in (payload, edited))
    assert len(a) > 50 and len(b - a) <= 3
    sizes = md.chunk_lengths(payload)
    assert max(sizes) <= 32_768 and min(sizes[:-1]) >= 1024 and 3000 < np.mean(sizes) < 7000


def test_round_trip_and_edge_rows(spark):
    rng = random.Random(3)
    base = rng.randbytes(300_000)
    rows = [
        (1, base), (2, base), (3, base[:150_000] + b"x" + base[150_000:]), (4, b""), (5, None), (None, b"tiny"), (6, b"a" * 200_000), (6, b"other"), (1, base), (7, base * 5),
    ]
    df = spark.createDataFrame([(i, p and bytearray(p) if p is not None else None, "x", 1) for i, p in rows], "doc_id bigint, payload binary, digest string, chunks int")
    out = md.deduplicate(df, "doc_id", "payload").collect()
    assert len(out) == len(rows)
    by = {p: hashlib.sha256(p).digest() for _, p in rows if p is not None}
    for r in out:
        if r["sha256"] is None:
            assert (r["doc_id"], r["n_bytes"], r["chunks"], r["restored"]) == (5, None, None, None)
        else:
            payload = next(p for p, d in by.items() if d == bytes(r["sha256"]))
            assert r["restored"] and r["n_bytes"] == len(payload)
            chunks = md.chunk_bytes(payload)
            assert [(bytes(c["digest"]), c["length"]) for c in r["chunks"]] == [(hashlib.sha256(c).digest(), len(c)) for c in chunks]
    lists, store = md.manifests(df, "doc_id", "payload"), md.chunk_store(df, "payload")
    assert store.count() == store.select("digest").distinct().count() == len({c for p in by for c in md.chunk_bytes(p)})
    back = {bytes(r["sha256"]): bytes(r["payload"]) for r in md.restore(lists, store).collect()}
    assert back == {d: p for p, d in by.items()}


def test_a_missing_or_damaged_chunk_is_found(spark):
    rng = random.Random(4)
    payloads = {1: rng.randbytes(60_000), 2: rng.randbytes(500)}
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in payloads.items()], "doc_id bigint, payload binary")
    lists, store = md.manifests(df, "doc_id", "payload"), md.chunk_store(df, "payload")
    import zstandard

    for victim in payloads.values():
        digest = hashlib.sha256(md.chunk_bytes(victim)[0]).digest()
        rows = [(bytearray(r["digest"]), bytearray(r["packed"])) for r in store.collect()]
        missing = [r for r in rows if bytes(r[0]) != digest]
        damaged = [(d, bytearray(zstandard.compress(b"wrong")) if bytes(d) == digest else p) for d, p in rows]
        for bad in (missing, damaged):
            for whole in (True, False):
                got = md.restore(lists, spark.createDataFrame(bad, "digest binary, packed binary"), with_payload=whole).collect()
                state = {bytes(r["sha256"]): r["restored"] for r in got}
                assert state == {hashlib.sha256(p).digest(): p is not victim for p in payloads.values()}


def test_incremental_store_and_texts(spark):
    a = spark.createDataFrame([(1, "word " * 5000), (2, "é")], "doc_id bigint, text string")
    b = spark.createDataFrame([(3, "word " * 5000 + "tail"), (4, "new")], "doc_id bigint, text string")
    old = md.chunk_store(a, "text")
    fresh = {bytes(r["digest"]) for r in md.new_chunks(md.chunk_store(b, "text"), old).collect()}
    have = {bytes(r["digest"]) for r in old.collect()}
    assert fresh and not fresh & have
    assert fresh | have >= {hashlib.sha256(c).digest() for t in ("word " * 5000 + "tail", "new") for c in md.chunk_bytes(t.encode())}
    assert all(r["restored"] for r in md.deduplicate(a, "doc_id", "text").collect())
    assert md.deduplicate(a.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        md.chunk_lengths(b"x", (8, 64, 256))


def test_every_payload_is_put_together(spark):
    """One chunk or many: of all distinct payloads, restore() gives the bytes, and a damaged frame of any is found."""
    rng = random.Random(6)
    payloads = [rng.randbytes(n) for n in (0, 1, 31, 900, 1024, 5000, 33_000, 250_000)]
    df = spark.createDataFrame([(i % 8, bytearray(payloads[i % 8])) for i in range(16)], "doc_id bigint, payload binary")
    lists, store = md.manifests(df, "doc_id", "payload"), md.chunk_store(df, "payload")
    back = [bytes(r["payload"]) for r in md.restore(lists, store).collect() if r["restored"]]
    assert sorted(back) == sorted(payloads) and {len(md.chunk_bytes(p)) for p in payloads} > {0, 1}
    rows = [(bytearray(r["digest"]), bytearray(r["packed"][:-3])) for r in store.collect()]  # frames cut short
    bad = md.restore(lists, spark.createDataFrame(rows, "digest binary, packed binary")).collect()
    assert len(bad) == 8 and [r["payload"] for r in bad if r["restored"]] == [b""]


def test_a_dictionary_changes_the_store_only_in_size(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    book = md.dictionary(docs, "text", samples=100, size=8 << 10)
    assert book and book == md.dictionary(docs.repartition(5), "text", samples=100, size=8 << 10)
    plain, small = md.chunk_store(docs, "text"), md.chunk_store(docs, "text", book=book)
    size = lambda s: {bytes(r["digest"]): len(r["packed"]) for r in s.collect()}
    a, b = size(plain), size(small)
    assert set(a) == set(b) and sum(b.values()) < 0.95 * sum(a.values())
    got = {r["sha256"]: r["payload"] for r in md.restore(md.manifests(docs, "doc_id", "text"), small, book=book).collect()}
    want = {hashlib.sha256(r["text"].encode()).digest(): r["text"].encode() for r in docs.where("text IS NOT NULL").collect()}
    assert {bytes(k): bytes(v) for k, v in got.items()} == want
    assert md.dictionary(docs.limit(0), "text") is None and md.dictionary(docs.limit(2), "text") is None
