import numpy as np
import pytest

from loomstone.llm import tokens as tk


def test_files_read_back_exactly(spark, tmp_path):
    texts = ["plain words", "", None, "Été — 漢字 🎉", "<|endoftext|> isn't special", "x" * 200_000, "plain words", "\n\n \t"] * 5
    rows = [(None if i == 3 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part int, file string").repartition(3)
    index = tk.write_tokens(docs, str(tmp_path / "t")).orderBy("start").collect()
    enc = tk.encoding(tk.vocabulary_path())
    want = sorted((-1 if r[0] is None else r[0], tuple(enc.encode_ordinary(r[1] or "")) + (tk.END,)) for r in rows)
    files = tk.TokenFiles(str(tmp_path / "t"))
    assert len(files) == len(rows) == len(index) and files.dtype == np.dtype("<u2")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(files.read(r["start"], r["stop"]).tolist())) for r in index)
    assert got == want
    at = 0
    for i, r in enumerate(index):
        assert r["start"] == at and r["stop"] - r["start"] == r["n_tokens"]
        assert files.document(i).tolist() == files.read(r["start"], r["stop"]).tolist()
        at = r["stop"]
    assert files.total == at and files.read(0, at).tolist() == [x for i in range(len(files)) for x in files.document(i).tolist()]
    decoded = [enc.decode(files.document(i).tolist()[:-1]) for i in range(len(files))]
    assert sorted(decoded) == sorted(t or "" for t in texts)
    with pytest.raises(IndexError):
        files.document(len(files))


def test_empty_table_and_default_folder(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tk.write_tokens(docs, str(tmp_path / "e")).count() == 0
    files = tk.TokenFiles(str(tmp_path / "e"))
    assert len(files) == 0 and files.total == 0 and files.read(0, 5).tolist() == []
    row = tk.write_tokens(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")).first()
    assert row["n_tokens"] == 3 and row["file"].endswith(".bin")


def test_ids_that_do_not_fit_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="outside a vocabulary"):
        tk.write_tokens(spark.createDataFrame([(1, "words of some kind")], "doc_id bigint, text string"), str(tmp_path / "x"), end=99, vocabulary=100)
