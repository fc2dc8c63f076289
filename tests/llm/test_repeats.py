"""Exact repeats of bytes and words against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from countloom.llm import cover_dedup, queries, rlbwt_dedup

DOCS = "doc_id long, text string, lang string, chunk string, payload string"
BIG = "/root/testdata/sf0.001"


def brute_bytes(rows, length):
    first = {}
    texts = [(i if i is not None else float("inf"), (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, float("inf")), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i if i != float("inf") else None, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_words(rows, window):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def planted(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde é中") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(8, 80)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 60)) for _ in range(rng.randint(1, 3))]
        parts += rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((rng.randint(0, n), rng.choice([" ", "\n", "\t\x0b "]).join(parts)))
    rows += [(7, rows[3][1]), (7, rows[3][1]), (900, "ab" * 400), (901, "xx" + "ab" * 300), (902, "ab" * 30), (-5, "a" * 49), (-4, "a" * 50), (-3, "a" * 200)]
    rows += [(None, rows[5][1]), (None, rows[5][1]), (1000, None), (1001, ""), (1002, " \n"), (1003, "  x")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", "b") for i, t in rows], DOCS).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, monkeypatch):
    rows = planted(seed)
    got = rlbwt_dedup.dedup_bytes(frame(spark, rows)).collect()
    mine = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert mine == brute_bytes(rows, 50)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_bytes_of_hot_minimizers(spark, monkeypatch):
    """Every key counts as hot: segments go window by window."""
    rows = planted(3)
    import countloom.llm.repeats as repeats

    real = repeats.shared_keys

    def hot(*a):
        found, _ = real(*a)
        import numpy as np

        keys = np.unique(np.concatenate([np.frombuffer(r.payload, np.uint64) for r in found.collect()]))[::2]
        slot = repeats.Slots.of(keys)
        words, at = np.unique(slot >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << (slot & np.uint64(63)))
        slots = repeats.Slots(words.astype(np.int64), bits)
        assert slots.has(keys).all()
        return found, slots

    monkeypatch.setattr(rlbwt_dedup, "shared_keys", hot)
    got = rlbwt_dedup.dedup_bytes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_bytes(rows, 50)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    import itertools

    blocks = rlbwt_dedup.blocks_of([b"a" * 10, b"b" * 1000, b"", b"c" * 70], 50, 100)
    flat = list(itertools.chain.from_iterable(blocks))
    starts = Counter(k for k, base, t in flat for _ in range(max(0, len(t) - 49)))
    assert starts == {1: 951, 3: 21}
    assert all(len(t) <= 149 for _, _, t in flat)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = planted(seed)
    got = cover_dedup.dedup_windows(frame(spark, rows)).collect()
    mine = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)
    assert mine == brute_words(rows, 35)


def test_other_window(spark):
    rows = planted(4, 40)
    got = cover_dedup.dedup_windows(frame(spark, rows), window=8).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == brute_words(rows, 8)


def test_words_that_power_sums_confuse(spark):
    """A word in the Thue-Morse pattern and its counterpart have one power sum modulo 2^64; nothing repeats here."""
    for size in (1024, 2048):
        a = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
        b = a.translate(str.maketrans("ab", "ba"))
        rest = " ".join(f"w{k}" for k in range(34))
        got = cover_dedup.dedup_windows(frame(spark, [(1, f"{a} {rest}"), (2, f"{b} {rest}")])).collect()
        assert [r.n_removed for r in got] == [0, 0]
        again = cover_dedup.dedup_windows(frame(spark, [(1, f"{a} {rest}"), (2, f"{a} {rest}")])).collect()
        assert [r.n_removed for r in again] == [35, 35]
        got = rlbwt_dedup.dedup_bytes(frame(spark, [(1, a), (2, b)])).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_bytes([(1, a), (2, b)], 50)


def test_a_chunk_that_sends_in_parts(spark):
    """The first document of a content can come in a later part than a second one of the same chunk."""
    import numpy as np

    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    key = np.array([9, 9, 9], np.uint64)
    x = np.frombuffer((line[:60] + line[:60] + line[30:90]).encode(), np.uint8)
    start, size = np.array([0, 60, 120]), np.array([60, 60, 60])
    order, head, sure = rlbwt_dedup._merged(key, np.array([4, 2, 1]), start, size, x)
    assert not sure.any() and len(head) >= 2  # one key, two contents: told apart by their bytes

    rows = [(k, line + "".join(rng.choice("ijklm ") for _ in range(40))) for k in (5, 1, 3, 1000, 7)]
    held = rlbwt_dedup.HELD
    try:
        rlbwt_dedup.HELD = 0  # every piece is sent by itself
        got = rlbwt_dedup.dedup_bytes(frame(spark, rows)).collect()
    finally:
        rlbwt_dedup.HELD = held
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == brute_bytes(rows, 50)


def test_covers():
    for m, cover in cover_dedup.COVERS.items():
        assert {(a - b) % m for a in cover for b in cover} == set(range(m))


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert rlbwt_dedup.dedup_bytes(none).count() == 0
    assert cover_dedup.dedup_windows(none).count() == 0


def test_queries_over_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op1_suffix_dedup(spark, BIG).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_bytes(rows, 50)
    got = queries.op9_substring_dedup(spark, BIG).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_words(rows, 35)


def test_hot_keys_are_found(spark, monkeypatch):
    """A common line makes its minimizers hot; workers read the limit when they are told it."""
    import numpy as np

    from countloom.llm import repeats

    line = " this line of sixty and more characters is in every document of all "
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(60)) + line + "".join(rng.choice("abcdefgh ") for _ in range(60))) for k in range(5000)]
    docs = repeats.with_chunk(frame(spark, rows), 8)

    def anchors(texts):
        for blocks in rlbwt_dedup.blocks_of(texts, 50):
            w = rlbwt_dedup.Windows(blocks, 50, 24)
            yield w.key, w.text

    shared, hot = repeats.shared_keys(docs, anchors, 16)
    assert 0 < int(np.bitwise_count(hot.bits).sum()) < 20
    got = rlbwt_dedup.dedup_bytes(frame(spark, rows)).select("doc_id", "n_removed").collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == Counter((i, n) for i, _, n, _, _ in brute_bytes(rows, 50))


def test_a_large_shard_is_indexed_in_shares(monkeypatch):
    """However much comes to a shard, what is sorted together is bounded, and the answers are those of one index."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(11)
    known = [rng.integers(97, 123, 400).astype(np.uint8).tobytes() for _ in range(60)]
    texts = [b"".join(known[k][a : a + 120] for k, a in zip(rng.integers(0, 60, 4), rng.integers(0, 280, 4))) for _ in range(400)]
    w = rlbwt_dedup.Windows(next(rlbwt_dedup.blocks_of(texts, 50, 1 << 20)), 50, 24)
    size = w.last - w.first + 50
    records = np.zeros(len(size), rlbwt_dedup._RECORD)
    records["key"], records["least"], records["length"], records["chunk"] = w.content(w.first, w.last), w.text, size, w.text % 7 - 3
    (batch,) = rlbwt_dedup._packed(np.arange(len(size)) % 9, records, w.first, w.x)
    sizes, real = [], rlbwt_dedup.RunLengthIndex

    def index(segments, *a):
        sizes.append(len(segments))
        return real(segments, *a)

    def answers(most):
        monkeypatch.setattr(rlbwt_dedup, "INDEXED", most)
        out = set()
        for chunk, payload, kind in zip(*(c.to_pylist() for c in rlbwt_dedup._shard(pa.table(batch), 50, 24, 5).columns)):
            types = [np.dtype(t) for t in (np.uint64, np.uint32, np.uint8, np.uint8, np.int64)[: 4 + kind]]
            n = len(payload) // sum(t.itemsize for t in types)
            out |= {(chunk, kind, *(int(v) for v in row)) for row in zip(*rlbwt_dedup.unpacked([n], [payload], types))}
        return out

    monkeypatch.setattr(rlbwt_dedup, "RunLengthIndex", index)
    whole = answers(1 << 40)
    assert len(sizes) == 1 and len(whole) > 1000
    assert answers(1 << 15) == whole
    assert max(sizes[1:]) <= 1 << 17 < int(size.sum())


def test_order_beyond_21_bits():
    """Three numbers of more than 21 bits don't fit a value: the two sorts give the same order."""
    import numpy as np

    rng = np.random.default_rng(12)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    sizes = np.full(40, 99)
    ends = np.cumsum(sizes + 1) - 1
    rest = (np.repeat(ends, sizes + 1) - np.arange(4000)).astype(np.int32)
    s = np.where(rest == 0, 0, text)
    orders = []
    for bits in (12, 31):
        order, new = rlbwt_dedup.RunLengthIndex._sorted(s.astype(np.int64), 12, np.arange(4000, dtype=np.int32))
        width = 1
        while width < 99:
            rank = np.empty(4000, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32)
            rlbwt_dedup.RunLengthIndex._doubled(order, new, rank, rest, width, bits)
            width *= 2
        orders.append((order, new))
    assert (orders[0][0] == orders[1][0]).all() and (orders[0][1] == orders[1][1]).all()
    keys = [(bytes(text[i : i + rest[i]]), i) for i in range(4000)]
    assert orders[0][0].tolist() == sorted(range(4000), key=lambda i: keys[i])
