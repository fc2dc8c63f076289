"""Spelling variants against brute force over all pairs."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from countloom.llm import spelling
from countloom.llm.spelling import Automaton, count_words, near_pairs, slipped, variants


def plain_counts(rows, length=6, least=5, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= least}


def plain_near(words):
    near = defaultdict(set)
    gone = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            gone[w[:k], w[k + 1 :]].add(w)
    for (a, b), same in gone.items():
        for x in same:
            near[x] |= same - {x}
            if a + b in words:
                near[x].add(a + b)
                near[a + b].add(x)
    return near


def plain_variants(n, ratio=5):
    near = plain_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_automaton():
    words = sorted({"anchor", "anchors", "archer", "archers", "été", "étés", "tes", "es", "a"})
    own = Automaton(words)
    assert [own.number(w) for w in words] == list(range(len(words)))
    assert own.number("anch") is None and own.number("zebra") is None
    assert len(own.edges) < sum(map(len, words))
    assert {words[k] for k in own.one_error("ancher", 3)} == {"anchor"}
    assert {words[k] for k in own.one_error("ancher", 0)} == {"anchor", "archer"}
    assert Automaton([]).number("") is None and Automaton([""]).number("") == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    words = count_words(docs, change=slipped())
    assert {(r.word, r.n) for r in words.collect()} == set(n.items())
    got = [tuple(r) for r in variants(words).collect()]
    assert len(got) == len(set(got)) == len(n) and set(got) == plain_variants(n)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("block", [3, 20_000])
def test_dense_words(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    import itertools

    n = {"".join(w): 1 + sum(map(ord, w)) ** 3 % 997 for size in (3, 4, 5) for w in itertools.product("abé", repeat=size)}
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(7)
    pairs = [(r.word, r.near, r.near_n) for r in near_pairs(words).collect()]
    near = plain_near(n)
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(w, x, n[x]) for w in n for x in near[w]}
    assert {tuple(r) for r in variants(words, 2).collect()} == plain_variants(n, 2)


def test_long_chain(spark):
    word, n = "a" * 20, {}
    for k in range(12):
        n[word[: 20 - k] + "b" * k] = 6**k
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: r.root for r in variants(words).collect()}
    assert set(got.values()) == {word[:9] + "b" * 11}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 64)
    monkeypatch.setattr(spelling, "HELD", 3)
    long = "Überfähre, streets " * 300 + "x" * 500
    rows = [(1, None, "a"), (2, "", "b"), (None, "straße Straße STRASSE " * 9, "c"), (3, long, "d"), (3, long, "d"), (4, "12 中文 ×÷×÷×÷ " * 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {(r.word, r.n) for r in count_words(docs, change=slipped()).collect()}
    assert got == set(plain_counts([r[:2] for r in rows]).items()) and any(w.startswith("Ü") for w, _ in got)
    assert variants(count_words(docs.where(F.lit(False)))).count() == 0
    with pytest.raises(ValueError):
        variants(count_words(docs), 1)
