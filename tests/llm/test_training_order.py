"""The permutation is one; shards hold every id once, at the place its slot names; reading resumes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.llm import queries, training_order
from countloom.llm.secrets import encoding

DOCS = "doc_id long, text string, shard string, ids string, part string"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    order = training_order.Order(n, 7)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.sequences(slots) == np.arange(n)).all()
    if n > 100:
        assert (slots != training_order.Order(n, 8).slots(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training_order, "PER_FOLDER", 2)
    monkeypatch.setattr(training_order, "PER_FILE", 1)
    texts = ["hello world " * k for k in (1, 40, 3, 900, 7)] + [None, "", "x", "x", "né 中文 🙂 " * 50]
    docs = spark.createDataFrame([(k, t, "s", "i", "p") for k, t in enumerate(texts)], DOCS).repartition(3).cache()
    path = f"file://{tmp_path}/order"
    training_order.materialise(docs, path, length=32, per_shard=10)
    rows = {r.slot: r for r in training_order.read(spark, path).collect()}
    assert sorted(rows) == list(range(len(rows)))
    stream = [i for r in sorted(rows.values(), key=lambda r: r.sequence) for i in r.ids]
    assert all(r.n_tokens == len(r.ids) for r in rows.values())
    assert all(len(r.ids) == 32 for r in rows.values() if r.sequence < len(rows) - 1)
    enc = encoding(training_order.VOCABULARY)
    docs_in_stream = []
    while stream:
        cut = stream.index(50256)
        docs_in_stream.append(enc.decode(stream[:cut]))
        stream = stream[cut + 1 :]
    assert sorted(docs_in_stream) == sorted(t for t in texts if t)
    shards = spark.read.parquet(f"{path}/shards").orderBy("shard").collect()
    assert [s.first_slot for s in shards] == [10 * k for k in range(len(shards))]
    assert all(len(s.payload) == s.n * 32 * 2 for s in shards)
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    every, later = spark.read.parquet(f"{path}/shards"), training_order.read(spark, path, 23)
    assert "PartitionFilters: [isnotnull(range" in later._jdf.queryExecution().toString()
    assert files(every) == len(shards) > files(every.where("range >= 1")) == len(shards) - 2
    later = training_order.read(spark, path, 23).collect()
    assert sorted(r.slot for r in later) == list(range(23, len(rows)))
    assert all(r.ids == rows[r.slot].ids for r in later)
    slot = 17
    raw = np.frombuffer(shards[1].payload, "<u2")[(slot - 10) * 32 : (slot - 9) * 32]
    assert raw[: rows[slot].n_tokens].tolist() == rows[slot].ids


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    training_order.materialise(spark.createDataFrame([(1, None, "s", "i", "p")], DOCS), path)
    assert training_order.read(spark, path).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op8_training_order(spark, sf).collect()
    enc = encoding(training_order.VOCABULARY)
    total = sum(len(enc.encode_ordinary(r.text)) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text)
    assert sum(r.n_tokens for r in got) == total
    assert len(got) == -(-total // 2048) == len({r.slot for r in got})


def test_query_against_one_stream(spark):
    """Every slot of the table holds the ids that a single pass over the documents by id puts there."""
    sf = "/root/testdata/sf0.001"
    enc, stream = encoding(training_order.VOCABULARY), []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        stream += [*enc.encode_ordinary(r.text), 50256] if r.text else []
    n = -(-len(stream) // 2048)
    slots = training_order.Order(n, 20).slots(np.arange(n)).tolist()
    want = {(slots[k], k, hashlib.sha256(",".join(map(str, stream[k * 2048 : (k + 1) * 2048])).encode()).hexdigest()) for k in range(n)}
    assert {(r.slot, r.sequence, r.ids_sha256) for r in queries.op8_training_order(spark, sf).collect()} == want


def test_order_does_not_depend_on_partitions(spark, tmp_path):
    rows = [(k % 40 if k % 9 else None, f"text {k} " * (k % 17), "s", "i", "p") for k in range(300)]
    seen = []
    for parts in (2, 5, 50):
        path = f"file://{tmp_path}/by{parts}"
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        training_order.materialise(spark.createDataFrame(rows, DOCS).repartition(parts), path, length=16, per_shard=8)
        seen.append({(r.slot, r.sequence, tuple(r.ids)) for r in training_order.read(spark, path).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 100
