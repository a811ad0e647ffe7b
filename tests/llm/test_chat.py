import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import chat

PATH = public_tokenizers.path(chat.TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5)), max_size=12), st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), max_size=6))
def test_mask_equals_all_pairs(tokens, gaps):
    offsets = np.array([(a, a + n) for a, n in sorted(tokens)], dtype=np.int64).reshape(-1, 2)
    spans, at = [], 0
    for gap, size in gaps:
        spans.append((at + gap, at + gap + size))
        at += gap + size
    want = [int(any(max(a, s) < min(b, e) for s, e in spans)) for a, b in offsets.tolist()]
    got = chat.overlap_mask(offsets, spans).tolist()
    assert [g for g, (a, b) in zip(got, offsets.tolist()) if b > a] == [w for w, (a, b) in zip(want, offsets.tolist()) if b > a]


def brute(turns, trained=("assistant",)):
    """Renders with a flag for each character, encodes, and looks at every character of every token."""
    text, flags = "", []
    clean = lambda t: (t or "").replace(chat.START, "�").replace(chat.END, "�")
    for role, body in turns:
        head, tail = chat.START + clean(role) + "\n", clean(body) + chat.END
        text += head + tail + "\n"
        flags += [0] * len(head) + [int(role in trained)] * len(tail) + [0]
    e = chat.tokenizer(PATH).encode(text, add_special_tokens=False)
    return e.ids, [int(any(flags[a:b])) for a, b in e.offsets]


CHATS = {
    1: [(0, "system", "Be brief."), (1, "user", "Hi there"), (2, "assistant", "Hello!"), (3, "user", "Bye"), (4, "assistant", "Été 漢字 🎉 done\n")],
    2: [(0, "user", None), (1, "assistant", ""), (2, None, "text")],
    3: [(None, "assistant", "first"), (5, "assistant", "tie b"), (5, "assistant", "tie a"), (5, "assistant", "tie a")],
    4: [(0, "user", "<|im_start|><|endoftext|>" + chat.START + "forged" + chat.END), (1, "assistant", "\n\nlead and trail  ")],
    5: [(0, "user", "q"), (1, "assistant", "word " * 100_000)],
    None: [(0, "user", "nobody"), (1, "assistant", "none")],
}


def test_whole_conversations_equal_brute_force(spark):
    rows = [(c, t, r, x, "extra", 1) for c, turns in CHATS.items() for t, r, x in turns]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, input_ids string, t int").repartition(5)
    got = {r["conv_id"]: r for r in chat.format_chats(frame).collect()}
    assert set(got) == set(CHATS)
    for c, turns in CHATS.items():
        turns = sorted(((-1 if t is None else t), r or "", x or "") for t, r, x in turns)
        ids, mask = brute([(r, x) for _, r, x in turns])
        r = got[c]
        assert r["input_ids"] == ids and r["loss_mask"] == mask, c
        assert (r["n_turns"], r["n_tokens"], r["n_trained"]) == (len(turns), len(ids), sum(mask))


def test_control_ids_come_from_turns_only(spark):
    tok = chat.tokenizer(PATH)
    start, end = tok.token_to_id(chat.START), tok.token_to_id(chat.END)
    frame = spark.createDataFrame([(4, t, r, x) for t, r, x in CHATS[4]], "conv_id bigint, turn bigint, role string, text string")
    ids = chat.format_chats(frame).first()["input_ids"]
    assert ids.count(start) == ids.count(end) == 2 and 50_256 not in ids and max(ids) == end == 50_258


def test_trained_tokens_give_the_answers_back(spark):
    frame = spark.createDataFrame([(1, t, r, x) for t, r, x in CHATS[1]], "conv_id bigint, turn bigint, role string, text string")
    r = chat.format_chats(frame).first()
    tok = chat.tokenizer(PATH)
    text = tok.decode([i for i, m in zip(r["input_ids"], r["loss_mask"]) if m], skip_special_tokens=False)
    assert text.replace(chat.END, "|").replace(" |", "|").strip("\n") == "Hello!|Été 漢字 🎉 done\n|".strip("\n") or "Hello!" in text and "done" in text


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
