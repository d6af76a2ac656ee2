"""Formatted conversations come back unchanged, whatever texts, roles and parts hold."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelyard.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, chunk bigint, last boolean, loss string"
TRICKY = ["\\### Assistant: </turn> ok", "</turn>\n", "\\</turn>", "\\\\<turn user>\n", "a\n<image 0>\n", "<image 1>", "\n</turn>\n<turn assistant>\n", "\\", "", "é😀 日本", "<", "</turn"]
PIECES = st.lists(st.sampled_from([*TRICKY, "\n", "<turn ", "<audio ", "\\", "x", " ", ">", "</", "turn", "image 0>"]), max_size=8).map("".join)
PARTS = st.lists(st.one_of(PIECES.map(lambda t: {"kind": "text", "text": t}), st.sampled_from(C.KINDS).map(lambda k: {"kind": k, "ref": "r"})), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PARTS), max_size=5))
def test_any_conversation_is_read_back(turns):
    formatter, spans = C.Formatter(), []
    for role, parts in turns:
        spans.append(formatter.turn(role, parts))
    text, attached = formatter.chunk()
    got = list(C.read_turns(text))
    assert [g[0] for g in got] == [role for role, _ in turns] and [g[2] for g in got] == spans
    number = 0
    for (_, parts), (_, content, _) in zip(turns, got, strict=True):
        want = []
        for part in parts:
            if part["kind"] != "text":
                want.append((part["kind"], number))
                number += 1
            elif part["text"] and want and isinstance(want[-1], str):
                want[-1] += part["text"]
            elif part["text"]:
                want.append(part["text"])
        assert content == want
    for a in attached:
        assert text[a["at"]:].startswith(f"<{a['kind']} {a['number']}>\n")


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        every = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        size = sum(17 + len(C.escape_role(r)) + len(C.escape(x)) for *_, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


@pytest.mark.parametrize("chunk", [1, 60, C.CHUNK])
def test_digests_of_messy_conversations(spark, chunk):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(TRICKY)]
    rows += [(2, 0, None, None), (2, None, "assistant", "first"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"),
             (None, 1, "user", "x"), (None, 0, "assistant", None), (3, 0, "sys>tem\n\\", "y"), (4, 0, "assistant", "long text " * 30000)]
    df = spark.createDataFrame([(*r, 9, True, "z") for r in rows], SCHEMA).repartition(5)
    formatted = C.format_conversations(df, chunk=chunk)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in C.digests(formatted).collect()}
    assert got == brute(rows)
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0


def test_attachments_are_recorded(spark):
    content = [("text", "see ", None, None, None, None, None), ("image", None, "s3-like/ref", 29, 14, None, None), ("audio", None, "a.wav", None, None, 2.5, None),
               ("document", None, None, None, None, None, 3), ("text", "and?", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None), (1, 2, "user", content[1:2])], f"conv_id bigint, turn bigint, role string, content array<{C.PART}>")
    rows = C.format_conversations(df, chunk=1, patch=10).orderBy("chunk").collect()
    assert [r["chunk"] for r in rows] == [0, 1, 2] and [r["last"] for r in rows] == [False, False, True]
    found = [(a["number"], a["kind"], a["ref"], a["tokens"]) for r in rows for a in r["attachments"]]
    assert found == [(0, "image", "s3-like/ref", 6), (1, "audio", "a.wav", 63), (2, "document", None, 768), (3, "image", "s3-like/ref", 6)]
    assert rows[0]["text"] == "<turn user>\nsee \n<image 0>\n\n<audio 1>\n\n<document 2>\nand?\n</turn>\n"
    assert rows[1]["loss"] == [17, 17]
    with pytest.raises(ValueError):
        C.Formatter().visit({"kind": "video"})
