"""Benchmark decontamination against brute force over all windows, and odd inputs."""

import random
import re
from collections import Counter

import numpy as np

from countloom.llm import decontaminate, queries

DOCS = "doc_id long, text string, item_id string, similarity string"
ITEMS = "item_id long, text string, doc_id string"


def bag(words, width):
    return Counter(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute(docs, items, width=5, least=0.8):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = Counter()
    for d, text in docs:
        words = split(text)
        for i, item in items:
            own = split(item)
            if not own:
                continue
            w = min(width, len(own))
            want = bag(own, w)
            best = 0.0
            for k in range(-len(own) + 1, len(words)):
                got = bag(words[max(0, k) : k + len(own)], w)
                both = sum((got & want).values())
                total = sum((got | want).values())
                best = max(best, both / total if total else 0.0)
            if best >= least:
                found[d, i, round(best, 9)] += 1
    return found


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 8, 20, 45, 60])))) for k in range(25)]
    docs = []
    for d in range(80):
        words = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = own
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).title() if d % 2 else " ".join(words)))
    docs += [(3, docs[3][1]), (200, None), (201, ""), (None, items[2][1]), (202, items[4][1] + " " + items[4][1])]
    items += [(40, None), (41, ""), (42, " . "), (43, items[1][1])]
    return docs, items


def test_brute_force(spark):
    docs, items = planted(9)
    got = decontaminate.find_leaks(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS)).collect()
    assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == brute(docs, items)


def test_moved_sentences(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for k, n in enumerate([60, 100, 48, 61, 60])]
    items.append((9, " ".join([*["la"] * 9, *items[0][1].split()[:51]])))
    docs = []
    for k, text in items:
        own = text.split()
        for cut in (15, len(own) // 2, len(own) // 3):
            around = [f"x{rng.randrange(10**6)}" for _ in range(40)]
            docs.append((len(docs), " ".join([*around, *own[cut:], *own[:cut], *around])))
            docs.append((len(docs), " ".join([*own[cut:], *own[:cut]])))
    docs += [(100, "la " * 300), (101, "la " * 200 + items[5][1])]
    want = brute(docs, items)
    assert {(d, i) for d, i, _ in want} >= {(2 * j, j // 3) for j in range(15)}
    got = decontaminate.find_leaks(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS)).collect()
    assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == want


def test_running_sums():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 90, np.uint64)
    lo = np.arange(60)
    hi = np.minimum(lo + 1 + rng.integers(0, 40, 60), 90)
    assert decontaminate.simhashes(h, lo, hi).tolist() == [decontaminate.simhash(h[a:b]) for a, b in zip(lo, hi)]


def test_clean_rows_stay(spark):
    docs, items = planted(10)
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    kept = decontaminate.without_leaks(frame, spark.createDataFrame([(*i, "z") for i in items], ITEMS))
    bad = {d for d, _, _ in brute(docs, items)}
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in docs if d not in bad)


def test_empty(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c", "x", "y")], DOCS)
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(some, items).count() == 0
    assert decontaminate.without_leaks(some, items).count() == 1


def test_query_over_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 3000]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    ids = {d for d, _ in docs}
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in queries.op7_benchmark_decontamination(spark, sf).collect() if r.doc_id in ids)
    assert got == brute(docs, items)
