"""Language ID: smoothing sums to one, held-out accuracy, rejection, and no look at anything but the text."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.llm import langid, queries

DOCS = "doc_id long, text string, lang string, source string, score string, rejected string"


def brute(counts, order):
    """Interpolated Kneser-Ney by the book: (lang, gram) -> n; gives p(lang, context, symbol)."""
    floor = 1 / (len({g[-1] for _, g in counts}) + 1)
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter((lang, g[1:]) for lang, g in levels[k + 1])
    discount = {}
    for k, level in levels.items():
        for lang in {x for x, _ in level}:
            n1, n2 = (sum(1 for (x, _), n in level.items() if x == lang and n == m) for m in (1, 2))
            discount[k, lang] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

    def p(lang, gram):
        k = len(gram)
        if not k:
            return floor
        own = {g: n for (x, g), n in levels[k].items() if x == lang and g[:-1] == gram[:-1]}
        low = p(lang, gram[1:])
        if not own:
            return low
        d, total = discount[k, lang], sum(own.values())
        return (max(own.get(gram, 0) - d, 0) + d * len(own) * low) / total

    return p


def counted(texts, order=langid.ORDER):
    out = Counter()
    for lang, t in texts:
        s = " " * (order - 2) + "".join(chr(c) for c in langid.symbols(t))
        out.update((lang, s[k : k + order]) for k in range(len(s) - order + 1))
    return out


TEXTS = [("x", "the cat sat on the mat and the dog"), ("y", "der hund sass auf der matte und die katze"), ("y", "éé zz"), ("z", "q")]


def test_entropies_are_those_of_the_book(spark):
    counts = counted(TEXTS)
    model = langid.fit(spark.createDataFrame([(a, g, n) for (a, g), n in counts.items()], "lang string, gram string, n long"))
    p = brute(counts, langid.ORDER)
    assert model.langs == ["x", "y", "z"]
    letters = sorted({g[-1] for _, g in counts})
    for context in (" th", "e c", "zqz", "   ", "~~~"):
        for k, lang in enumerate(model.langs):
            own = [float(np.exp(langid.log_probs(np.array([ord(x) for x in context + c], np.uint32), model)[0, k])) for c in [*letters, "~"]]
            assert own == pytest.approx([p(lang, context + c) for c in [*letters, "~"]], rel=1e-4)
            assert sum(own) == pytest.approx(1.0, abs=1e-4)
    for text in ("the dog and die katze", "Zebra!", "q"):
        s = "  " + "".join(chr(c) for c in langid.symbols(text))
        want = [-np.mean([np.log(p(lang, s[k - 3 : k + 1])) for k in range(3, len(s))]) for lang in model.langs]
        assert langid.entropies([text], model)[0] == pytest.approx(want, rel=1e-4)


def test_counts_cover_all_rows(spark):
    got = {(r.lang, r.gram): r.n for r in langid.count_grams(spark.createDataFrame(TEXTS * 3, "lang string, text string").repartition(5)).collect()}
    assert got == counted(TEXTS * 3)


def test_limits_come_from_all_rows(spark):
    """More rows of a language than any sample was of: means and deviations are those of every text; a language without letters counts nowhere."""
    texts = [("x", f"{'ab' * (k % 7)}{'cde' * (k % 5)} {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}") for k in range(6000)] + [("y", "der hund")] * 3 + [("z", "12 !")] * 2
    model = langid.train(spark.createDataFrame(texts, "lang string, text string"))
    assert model.langs == ["x", "y"]
    for k, lang in enumerate(model.langs):
        e, n, squares = langid.measured([t for x, t in texts if x == lang], model, spread=True)
        v, q = e[:, k], squares[:, k]
        want = (v.mean(), v.var(), q.sum() / n.sum() - ((v * n).sum() / n.sum()) ** 2)
        assert model.limit[0][k] == pytest.approx(want, rel=1e-5, abs=1e-9)


def test_a_model_that_is_too_large_to_broadcast(spark):
    """Joined to the documents' own n-grams it gives what the broadcast one gives, rejection included; other columns travel along."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("key", F.lit("k")).withColumn("chunk", F.array("doc_id"))
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    small, large = langid.train(docs), langid.train(docs, broadcast_rows=0)
    assert small.grams is not None and large.grams is None and large.limit[0] == pytest.approx(small.limit[0])
    a, b = (sorted(map(str, langid.predict(docs, m).withColumn("score", F.round("score", 6)).collect())) for m in (small, large))
    assert a == b and len(a) == docs.count()
    a, b = (sorted(map(str, langid.without_rejected(docs, m).collect())) for m in (small, large))
    assert a == b and 0 < len(a) < docs.count()


def test_seventy_languages(spark):
    """No language is too many, and the one with the fewest rows counts as well."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = []
    for k in range(70):
        own = "".join(letters[(k * 7 + j * (k % 5 + 1)) % 26] for j in range(9)) + chr(0x400 + k)
        made += [(k, f"{own} {own[::-1]} {own[2:]}{own[:2]} " * 3, f"lang{k:02}")] * (1 if k == 69 else 3)
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs)).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "lang"), "doc_id")
    assert got.where("lang <> lang_pred").count() == 0 and got.select("lang_pred").distinct().count() == 70


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    own = got.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert own.n > 150 and own.a >= 0.98
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where("rejected and lang_pred <> 'und'").count() <= 0.01 * got.count()


def rows():
    en = "the house and the river were with them in the morning when they had been there "
    de = "das haus und der fluss waren mit ihnen am morgen als sie dort gewesen waren und nicht "
    out = [(k, (en if k % 2 else de) * (1 + k % 3), "en" if k % 2 else "de", "s", "x", "y") for k in range(60)]
    return out


def test_odd_rows(spark):
    odd = [(100, None, "en", "s", "x", "y"), (101, "", "en", "s", "x", "y"), (102, "123 !! \n", "de", "s", "x", "y"), (None, "und der fluss war nicht das haus", None, None, None, None), (103, "the river and the house", None, "s", "x", "y"), (103, "the river and the house", None, "s", "x", "y")]
    odd += [(104, "щдфы " * 200, "en", "s", "x", "y"), (105, "the river " * 300_000, "de", "s", "x", "y")]
    docs = spark.createDataFrame(rows() + odd, DOCS)
    model = langid.train(spark.createDataFrame(rows() + odd[:3], DOCS))
    got = {}
    for r in langid.predict(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k in (100, 101, 102):
        assert (got[k][0].lang_pred, got[k][0].score, got[k][0].rejected) == ("und", 0.0, True)
    assert got[None][0].lang_pred == "de" and [r.lang_pred for r in got[103]] == ["en", "en"]
    assert got[104][0].rejected and got[105][0].lang_pred == "en"
    assert all(r.lang_pred == ("en" if k % 2 else "de") and not r.rejected for k in range(60) for r in got[k])


def test_label_and_source_are_not_inputs(spark):
    model = langid.train(spark.createDataFrame(rows(), DOCS))
    a = langid.predict(spark.createDataFrame(rows(), DOCS), model).orderBy("doc_id").collect()
    b = langid.predict(spark.createDataFrame([(k, t, "zz", "other", "", "") for k, t, *_ in rows()], DOCS), model).orderBy("doc_id").collect()
    assert a == b


def test_unlabelled_languages_and_short_junk_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 20000")
    held = docs.where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    junk = ["asdkjh qweoiu zxmncb", "xkcd jjjj qqq wwxz", "qzx jqk vvbw xkq zzj", "kjhg fdsq wxcv bnmp lkjh"]
    for out in ("de", "en", "es", "fr"):
        model = langid.train(docs.where((F.col("lang") != out) & ~langid.held_out(F.col("doc_id"))))
        got = langid.predict(held, model).join(held.select("doc_id", "lang", "n_chars"), "doc_id").where("lang_pred <> 'und'").collect()
        foreign = [r.rejected for r in got if r.lang == out and r.n_chars >= 200]
        own = [r.rejected for r in got if r.lang != out]
        assert sum(foreign) >= 0.9 * len(foreign) > 0, out
        assert sum(own) <= 0.02 * len(own), out
        assert langid.judge(junk, model)[2].all()
        assert not langid.judge(["a", "The."], model)[2].any()
        assert langid.judge(["щдфы йцукен " * 13], model)[2].all()  # about 150 characters of a script that no model knows


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], DOCS)
    model = langid.train(none)
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame(rows()[:2], DOCS), model).collect()] == ["und", "und"]
    assert langid.predict(none, langid.train(spark.createDataFrame(rows(), DOCS))).count() == 0
