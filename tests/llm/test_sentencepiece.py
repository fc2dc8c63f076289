"""SentencePiece: ids equal the library's, also by the scan over chunks; decoding gives the texts back."""

import random

import pytest
import sentencepiece

from countloom.llm import sentencepiece_scan as sp

DOCS = "doc_id long, text string, row string, ids string, part string, __row string, doc string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def texts(seed, n, most):
    rng = random.Random(seed)
    parts = ["the", "ing", "ation", " ", "  ", "\n", "\t", "é", "中文", "🙂", "▁", "0123", "<s>", "</s>", "<0x41>", "x" * 9, ".", "Ünïcode", "́", "\r", "aaaa"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize(("giant", "chunk", "most"), [(1 << 16, 1 << 14, 60), (100, 40, 400), (200, 150, 900)])
def test_ids_and_round_trip(spark, library, giant, chunk, most):
    rows = [(k, t) for k, t in enumerate([*texts(giant, 25, most), "", "a", " ", "▁", "aaaa" * 300, " " * 500, "x" * 700])] + [(3, "same"), (3, "same"), (None, "null id"), (99, None)]
    df = spark.createDataFrame([(*r, "r", "i", "p", "w", "d") for r in rows], DOCS).repartition(3)
    got = sp.decode(sp.encode(df, giant=giant, chunk=chunk)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    both = sp.encode(df, giant=giant, chunk=chunk, decoded=True)
    assert sorted(map(str, got)) == sorted(map(str, both.select(*got[0].asDict()).collect()))
    for r in got:
        assert r.ids == (library.encode(r.text) if r.text else []), repr(r.text)[:80]
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_products_are_associative(library):
    p = sp.pieces(sp.MODEL)
    s = sp.SPACE + texts(7, 1, 300)[0].replace(" ", sp.SPACE)
    parts = sp.cuts(len(s), 60)
    m = []
    for k, (lo, hi) in enumerate(parts):
        low, high = max(0, lo - p.longest), min(len(s), hi + p.longest)
        m.append(sp.Chunk(p, s[low:high], lo - low, hi - low, k == len(parts) - 1).transfer(k == 0))
    assert len(m) > 3
    assert sp.product(sp.product(m[0], m[1]), m[2]) == sp.product(m[0], sp.product(m[1], m[2]))


def test_empty(spark):
    assert sp.decode(sp.encode(spark.createDataFrame([], DOCS))).count() == 0
