"""Secret scans: three base patterns plus a token-efficiency test.

Natural words merge into long tokens of a public byte-pair vocabulary; random strings do not.
A run of base64-like characters whose characters per token stay under ``max_ratio`` is reported
as kind ``random``, unless it is a plain number, a digest of a known length, a UUID or an identifier
(snake_case, camelCase or a path) whose parts are words of the vocabulary: few, long tokens.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TOKENIZERS, lean

ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
#: Letters per token, at least, of the lower-cased parts of an identifier; random letters have about 1.7.
WORDY = 3.0
#: The pre-tokenisation pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str, enc) -> bool:
    """A digest, a UUID, a plain number, or an identifier made of words."""
    if run.isdigit() or UUID.fullmatch(run):
        return True
    if len(run) in DIGESTS and not set(run.lower()) - set("0123456789abcdef"):
        return True
    parts = PART.findall(run)
    letters = sum(map(len, parts))
    return 2 * letters >= len(run) and letters >= WORDY * sum(len(enc.encode_ordinary(f" {p.lower()}")) for p in parts)


def scan(text: str, enc, max_ratio: float) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all spans, by start and then kind; code points, end exclusive."""
    low = text.lower()
    found = []
    if any(m in low for m in MARKS) or not text.isascii() and ("K" in text or "ſ" in text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) < max_ratio * len(enc.encode_ordinary(run)) and not is_known(run, enc):
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def find_secrets(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", max_ratio: float = 2.0) -> DataFrame:
    """(doc_id, spans array<struct<start,end,kind>>) for every row of ``docs`` (doc_id, text).

    A null or empty text has no spans. Base kinds are ``assign``, ``access`` and ``hex``; the
    token test adds ``random``. Rows that repeat keep a row each; very long texts are read whole. An empty table gives no rows;
    further columns are not read.
    """
    lean(docs.sparkSession)
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        enc = encoding(vocabulary)
        for b in batches:
            spans = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in scan(t, enc, max_ratio)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "spans": pa.array(spans, struct)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def redact(docs: DataFrame, mark: str = "[REDACTED]", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", max_ratio: float = 2.0) -> DataFrame:
    """``docs`` with every span of :func:`find_secrets` replaced by ``mark``; overlapping spans become one.

    The keyword of an ``assign`` span goes with its value. Null texts stay null, empty ones empty. Where there is
    a column n_chars it is set to the new length. Repeated rows and all other columns stay; an empty table stays empty.
    """
    lean(docs.sparkSession)
    columns = docs.columns
    at = columns.index("text")
    count = columns.index("n_chars") if "n_chars" in columns else None

    def clean(text, enc):
        if not text or not (spans := scan(text, enc, max_ratio)):
            return text
        out, end = [], 0
        for s, e, _ in spans:
            if s >= end:
                out += [text[end:s], mark]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches):
        enc = encoding(vocabulary)
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [clean(t, enc) for t in texts]
            arrays = list(b.columns)
            arrays[at] = pa.array(new, b.column(at).type)
            if count is not None:
                lengths = [n if a is t else len(a) for a, t, n in zip(new, texts, b.column(count).to_pylist())]
                arrays[count] = pa.array(lengths, b.column(count).type)
            yield pa.record_batch(arrays, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
