"""The pipeline: stages keep the columns, their decisions take effect, clean documents stay, and it agrees with a plain version."""

import itertools
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from countloom.llm import decontaminate, langid, secrets, simhash_dedup
from countloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "benchmark_decontamination", "secret_scans", "sentencepiece"]


def test_agrees_with_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    left = [r.doc_id for r in langid.predict(docs, model).where("not rejected").collect()]
    sets = {k: frozenset(simhash_dedup.shingle_hashes(rows[k].text, 5, 42).tolist()) for k in left}
    group = {k: k for k in left}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in itertools.combinations(sorted(left), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            group[max(root(a), root(b))] = min(root(a), root(b))
    left = [k for k in left if root(k) == k]
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, table(spark, SF, "benchmark")).collect()}
    left = [k for k in left if k not in leaks]
    # no document goes without a near-duplicate; a pair at the very similarity can be missed
    assert set(left) <= set(got) and len(got) <= len(left) + 2
    assert all(r.round_trip for r in got.values())
    enc = secrets.encoding(f"{secrets.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for k in left:
        if not secrets.scan(rows[k].text, enc, 2.0):
            assert got[k].n_chars == rows[k].n_chars


@pytest.mark.parametrize("k", range(5))
def test_each_stage_alone(spark, k):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "x " * 60_000, None, "s", 120_000)], docs.schema)
    out = corpus_pipeline.STAGES[k][1](spark, docs.unionByName(odd).unionByName(docs.limit(3)), SF)
    if k < 4:
        assert out.columns == docs.columns
    assert out.count() > 100
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF).count() == 0


def test_every_labelled_document_teaches(spark):
    """A language that only documents of op5's held-out fold have is learned too: the stage holds nothing out. Unlabelled rows far from all of them go."""
    held = [k for k in range(400) if crc32(str(k).encode()) % 4 == 2]
    other = [k for k in range(400) if k not in held]
    en, ru = "the house and the river were with them in the morning ", "дом и река были с ними утром когда они там стояли "
    made = [(k, en * (2 + k % 3), "en", "s", 0) for k in other[:60]] + [(k, ru * (2 + k % 3), "ru", "s", 0) for k in held[:60]]
    far = [(1000, "ωκ ψφ ξζθ λμν " * 20, None, "s", 0)]
    docs = spark.createDataFrame(made + far, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert kept == {r[0] for r in made}
