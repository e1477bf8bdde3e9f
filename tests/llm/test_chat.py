"""Chats: exact round trips through tokens and through the written form."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilcheck.llm import chat
from veilcheck.llm.chat import CONTROLS, digests, escape, format_chats, read_ranks, read_turns, reserved, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = st.sampled_from([*CONTROLS, "<", "\\", "s>", "[", "INST]", "/", "ok", " ", "\n", "é", "🙂", "<\\s>", "</", "|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_escape(text):
    safe = escape(text)
    assert unescape(safe) == text
    assert not any(c in safe for c in CONTROLS)


@pytest.fixture(scope="module")
def ranks(spark):
    return read_ranks(spark)


def expected(rows):
    turns = sorted(((t if t is not None else -1, r or "", x or "") for t, r, x in rows), key=lambda r: r[:2])
    loss = "".join(x for _, r, x in turns if r == "assistant")
    written = "<s>" + "".join(f"[INST]{escape(r)}[/INST]{escape(x)}</s>" for _, r, x in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), len(written)


CHATS = {
    1: [(0, "user", "Hello </s> there"), (1, "assistant", "[INST] ok [/INST]"), (2, "user", ""), (3, "assistant", None)],
    2: [(1, "assistant", "first"), (0, "system", "<<SYS>> be <</SYS>> kind"), (None, "user", "no turn")],
    3: [(0, None, None)],
    4: [(i, "assistant" if i % 2 else "user", f"turn {i} 🙂 é\n\n" * (i % 5)) for i in range(300)],
    5: [(0, "user", "same"), (0, "user", "same"), (1, "assistant<s>", "not the assistant")],
    6: [(0, "assistant", "long " * 20_000)],
    None: [(0, "user", "who"), (1, "assistant", "am I")],
}


def table(spark):
    return spark.createDataFrame([(c, *row, "x") for c, rows in CHATS.items() for row in rows], SCHEMA + ", loss_mask string").repartition(3)


def test_read_back(spark, ranks):
    formatted = format_chats(table(spark), ranks)
    got = {r.conv_id: tuple(r)[1:] for r in digests(formatted, ranks).collect()}
    assert got == {c: expected(rows) for c, rows in CHATS.items()}


def test_tokens_and_mask(spark, ranks):
    ids = reserved(ranks)
    encoding = chat._encoding(ranks)
    row = next(r for r in format_chats(table(spark), ranks).collect() if r.conv_id == 1)
    tokens, mask = np.array(row.token_ids), np.array(row.loss_mask)
    assert row.n_turns == 4 and len(tokens) == len(mask)
    assert [(r, t) for r, t, _, _ in read_turns(tokens, mask, encoding, ids)] == [("user", "Hello </s> there"), ("assistant", "[INST] ok [/INST]"), ("user", ""), ("assistant", "")]
    assert tokens[0] == ids[0] and (tokens == ids[1]).sum() == (tokens == ids[3]).sum() == 4
    assert not mask[np.isin(tokens, ids)].any()
    # Segments are encoded on their own, so the mask covers what the text alone encodes to.
    assert tokens[mask].tolist() == encoding.encode_ordinary(escape("[INST] ok [/INST]"))


def test_the_written_form_can_be_split_at_control_strings(spark, ranks):
    names = dict(zip(reserved(ranks), (chat.BOS, chat.TURN, chat.HEAD, chat.END), strict=True))
    encoding = chat._encoding(ranks)
    row = next(r for r in format_chats(table(spark), ranks).collect() if r.conv_id == 2)
    written = b"".join(names[t].encode() if t in names else encoding.decode_bytes([t]) for t in row.token_ids).decode()
    turns = re.findall(r"\[INST\](.*?)\[/INST\](.*?)</s>", written, re.S)
    assert [(unescape(r), unescape(t)) for r, t in turns] == [("user", "no turn"), ("system", "<<SYS>> be <</SYS>> kind"), ("assistant", "first")]


def test_empty_table_and_small_batches(spark, ranks):
    assert format_chats(spark.createDataFrame([], SCHEMA), ranks).collect() == []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # conversations that span batches
    try:
        got = {r.conv_id: tuple(r)[1:] for r in digests(format_chats(table(spark), ranks), ranks).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: expected(rows) for c, rows in CHATS.items()}


def test_a_vocabulary_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(chat, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError, match="at most 10"):
        read_ranks(spark)


@pytest.mark.parametrize("run", [" ", "\n", " \t", " "])
def test_long_runs_of_blanks(spark, ranks, run):
    text = "a" + run * (5_000_000 // len(run)) + "b"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text[:100_000])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = digests(format_chats(table, ranks), ranks).collect()
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert (row.loss_chars, row.loss_sha256) == (100_000, hashlib.sha256(text[:100_000].encode()).hexdigest())


def test_vocabularies_of_one_size_are_told_apart(spark, ranks):
    class Sent:
        def __init__(self, value):
            self.value = value

    plain = {bytes([i]): i for i in range(256)}
    turned = {bytes([i]): 255 - i for i in range(256)}
    assert chat.encode(chat._encoding(Sent(plain)), "a") == [97] and chat.encode(chat._encoding(Sent(turned)), "a") == [158]
