r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once, encoded once with offsets, and the token spans are laid
against the sorted spans of assistant texts by binary search. The template of a turn is

    <|turn|>role<|text|>text<|end|>

All three marks are added tokens, so no token reaches across the border of a text. Inside roles
and texts a backslash becomes ``\\`` and ``<|`` becomes ``<\|``; so a mark cannot arise in a text,
and :func:`unescape` gives back every text unchanged.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, lean

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
FLUSH = 1 << 18


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(part.replace("<\\|", "<|") for part in text.split("\\\\"))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text starts and ends in it."""
    head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from whole rendered turns."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, rest = piece.partition(TEXT)
        turns.append((unescape(role), unescape(rest[: -len(END)])))
    return turns


@functools.lru_cache(2)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
    return t


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for each token [start, end) that meets one of the sorted, disjoint ``spans``."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    k = np.searchsorted(spans[:, 1], offsets[:, 0], "right")
    inside = np.minimum(k, len(spans) - 1)
    return (k < len(spans)) & (spans[inside, 0] < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])


def encode(formatted: str, spans: list[tuple[int, int]], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, offsets (code points) and loss mask of a rendered text."""
    got = tokenizer(path).encode(formatted, add_special_tokens=False)
    ids = np.array(got.ids, np.int32)
    offsets = np.fromiter(chain.from_iterable(got.offsets), np.int32, 2 * len(ids)).reshape(-1, 2)
    return ids, offsets, loss_mask(offsets, np.array(spans, np.int64).reshape(-1, 2))


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The characters under the mask, in order, each once; tokens of one character overlap."""
    keep = offsets[mask]
    if not len(keep):
        return ""
    ends = np.maximum.accumulate(keep[:, 1])
    new = np.concatenate(([True], keep[1:, 0] > ends[:-1]))
    starts, stops = keep[new, 0], np.concatenate((ends[:-1][new[1:]], ends[-1:]))
    return "".join(formatted[s:e] for s, e in zip(starts.tolist(), stops.tolist()))


SCHEMA = "conv_id long, part long, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>, spans array<struct<start:int,end:int>>"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts), kind))


def format_conversations(rows: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rendered and encoded conversations of ``rows`` (conv_id, turn, role, text), parts in order.

    Turns go by turn, then role, then text (nulls first); repeated rows stay. A null text or
    role counts as empty; rows with a null conv_id form a conversation of their own. One row
    has a whole conversation or a part of whole turns, in the order of ``part``: a very long one is cut after 2^18 characters
    or more, and where a range of turns ends. Marks are added tokens, so the parts have the ids of the whole.
    Rows are dealt by ranges of (conv_id, turn) and read as a stream: a hot conversation takes several tasks, and none is
    held whole. Only turns of one number stay together.
    An empty table gives no rows; further columns are not read.
    Returns conv_id, part, n_turns, formatted, ids, starts and ends (the tokens' offsets in the part), mask, spans (of
    trained texts, in the part).
    """

    def run(batches):
        state: dict = {"conv": None, "open": False, "part": 0}
        out: list[tuple] = []

        def flush(last: bool):
            formatted = "".join(state["texts"])
            ids, offsets, mask = encode(formatted, state["spans"], vocabulary)
            out.append((state["conv"], (state["range"] << 32) + state["part"], len(state["texts"]), formatted, ids, offsets[:, 0], offsets[:, 1], mask, np.array(state["spans"], np.int32).reshape(-1, 2)))
            state.update(texts=[], spans=[], size=0, part=0 if last else state["part"] + 1)

        def batch():
            conv, part, n, formatted, ids, starts, ends, mask, spans = zip(*out)
            out.clear()
            flat = np.concatenate(spans)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]).astype(np.int32)), pairs)
            columns = [pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(n, pa.int64()), pa.array(formatted, pa.string()), *(_lists(x, pa.int32()) for x in (ids, starts, ends)), _lists(mask, pa.bool_()), spans]
            return pa.record_batch(columns, names=["conv_id", "part", "n_turns", "formatted", "ids", "starts", "ends", "mask", "spans"])

        held = 0
        for b in batches:
            for conv, where, role, text in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3))):
                if not state["open"] or conv != state["conv"]:
                    if state["open"] and state["texts"]:
                        flush(True)
                    state.update(conv=conv, open=True, texts=[], spans=[], size=0, part=0, range=where)
                turn, s, e = render(role or "", text or "")
                if (role or "") in trained and e > s:
                    state["spans"].append((state["size"] + s, state["size"] + e))
                state["texts"].append(turn)
                state["size"] += len(turn)
                held += len(turn)
                if state["size"] >= FLUSH:
                    flush(False)
                if out and held >= 4 * FLUSH:
                    held = 0
                    yield batch()
        if state["open"] and state["texts"]:
            flush(True)
        if out:
            yield batch()

    lean(rows.sparkSession)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", F.spark_partition_id().cast("long").alias("range"), "role", "text").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, all of it read from the output of :func:`format_conversations`.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each parsed turn),
    loss_chars and loss_sha256 (unescaped text under the token mask), formatted_chars. The
    loss text comes from the tokens' mask and offsets; nothing is encoded again. Parts are parsed where they lie; a digest reads
    the parts of its conversation one after another. An empty table gives no rows.
    """

    def parsed(batches):
        for b in batches:
            out = {"conv_id": b.column(0), "part": b.column(1), "n_turns": [], "turns": [], "loss": [], "chars": []}
            columns = [b.column(k) for k in range(2, 6)]
            for k in range(len(b)):
                text = columns[0][k].as_py()
                starts, ends, mask = (np.asarray(c[k].values) if c is not columns[3] else c[k].values.to_numpy(zero_copy_only=False) for c in columns[1:])
                turns = parse(text)
                out["n_turns"].append(len(turns))
                out["turns"].append("".join(f"{role}\n{said}\n" for role, said in turns))
                out["loss"].append(unescape(masked_text(text, np.stack((starts, ends), axis=1), mask)))
                out["chars"].append(len(text))
            yield pa.RecordBatch.from_pydict(out, schema=middle)

    middle = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])

    def digested(batches):
        now: dict = {}

        def row():
            return {"conv_id": now["conv"], "n_turns": now["n"], "turns_sha256": now["turns"].hexdigest(), "loss_chars": now["loss"], "loss_sha256": now["text"].hexdigest(), "formatted_chars": now["size"]}

        for b in batches:
            out = []
            for conv, n, turns, loss, chars in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if not now or conv != now["conv"]:
                    if now:
                        out.append(row())
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "text": hashlib.sha256(), "size": 0}
                now["n"] += n
                now["turns"].update(turns.encode("utf-8", "surrogatepass"))
                now["loss"] += len(loss)
                now["text"].update(loss.encode("utf-8", "surrogatepass"))
                now["size"] += chars
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if now:
            yield pa.RecordBatch.from_pylist([row()], schema=target)

    target = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    parts = formatted.select("conv_id", "part", "formatted", "starts", "ends", "mask").mapInArrow(parsed, "conv_id long, part long, n_turns long, turns string, loss string, chars long")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
