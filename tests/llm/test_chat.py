"""Chat formatting: whole turns come back, and the loss mask covers exactly the assistant texts."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from countloom.llm import chat

ROWS = "conv_id long, turn long, role string, text string, ids string, part string"
NASTY = ["", "\\", "<|", "<\\|", "<|end|>", "\\<|turn|>assistant<|text|>", "\\### Assistant: </turn> ok", "é中🙂<|́", "<|text|>" * 3, "a" * 400_000, " \n\t"]


@given(st.text(alphabet="\\<|>turnd é🙂", max_size=40))
def test_escape_is_reversible(text):
    marked = chat.escape(text)
    assert chat.unescape(marked) == text
    assert not any(m in marked for m in (chat.TURN, chat.TEXT, chat.END))


@settings(max_examples=60)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|end|>"]), st.text(alphabet="\\<|>end é🙂", max_size=30)), max_size=8))
def test_parse(turns):
    assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns


def test_mask_is_an_intersection():
    offsets = np.array([[0, 2], [2, 2], [2, 5], [5, 9], [9, 10]])
    assert chat.loss_mask(offsets, np.array([[3, 5], [9, 12]])).tolist() == [False, False, True, False, True]
    assert not chat.loss_mask(offsets, np.zeros((0, 2), int)).any()


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    none = lambda x: tuple((v is not None, v) for v in x)
    out = {}
    for conv, turns in by.items():
        turns = [(r or "", t or "") for _, r, t in sorted(turns, key=none)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r, t)[0]) for r, t in turns))
    return out


def test_read_back(spark):
    rows = [(k, t, r, x) for k, x in enumerate(NASTY) for t, r in enumerate(["system", "assistant", "user", "assistant"])]
    rows += [(99, 0, "user", None), (99, 1, "assistant", None), (100, 1, None, "x"), (None, 0, "assistant", "y"), (101, None, "assistant", "z"), (101, 3, "assistant", "w"), (102, 0, "assistant", "same"), (102, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "i", "p") for r in rows], ROWS).repartition(5)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted).collect()}
    assert got == expected(rows)


def test_long_conversations_go_in_parts_with_the_ids_of_the_whole(spark, monkeypatch):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <| é " * 3000) for t in range(24)]
    parts = chat.format_conversations(spark.createDataFrame([(*r, "i", "p") for r in rows], ROWS)).orderBy("part").collect()
    assert len(parts) > 1 and sum(p.n_turns for p in parts) == 24
    whole = "".join(p.formatted for p in parts)
    ids, _, mask = chat.encode(whole, [], f"{chat.TOKENIZERS}/byte_bpe_50k.json")
    assert ids.tolist() == [i for p in parts for i in p.ids]


def test_a_hot_conversation_takes_several_tasks(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(4000)]
    formatted = chat.format_conversations(spark.createDataFrame([(*r, "i", "p") for r in rows], ROWS).repartition(4))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert len({p.part >> 32 for p in formatted.collect()}) == 4
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted).collect()}
    assert got == expected(rows)


def test_empty(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], ROWS))).count() == 0
