"""Readers, sinks, manifests, fingerprints and the phase registry, on files made here."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from countloom.functions import scalars
from countloom.plans import provenance as V
from countloom.sources import files as S

HEADER = ";".join(f'"{c}"' for c in S.COUNT_COLUMNS)
ROWS = [
    '"1";"AC";"01007";"0009";"0001";"Presidente";"04/10/2026 17:01:02";"Nominal";"13";"50"',
    '"1";"AC";"01007";"0009";"0001";"Presidente";"04/10/2026 17:01:02";"Branco";"95";"2"',
    '"1";"AC";"01007";"0009";"0002";"Presidente";"04/10/2026 18:00:00";"Nominal";"022";"143"',
    '"1";"AC";"01007";"0009";"0002";"Presidente";"04/10/2026 18:00:01";"Nominal";"13";"1"',
    '"1";"AC";"01007";"0009";"0001";"Governador";"04/10/2026 17:01:02";"Nominal";"13";"7"',
    '"2";"AC";"01007";"0009";"0001";"Presidente";"04/10/2026 17:01:02";"Nominal";"13";"9"',
    '"1";"";"01007";"0009";"0001";"Presidente";"x";"Nominal";"13";"abc"',
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/a.csv").write_text("\n".join([HEADER, *ROWS]) + "\n", "latin-1")
    (tmp_path / "zip").mkdir()
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"zip/a{k}.zip", "w") as z:
            z.writestr("bu_AC.csv", "\r\n".join([HEADER, *ROWS[: 4 + k]]) + "\r\n")
            z.writestr("readme.pdf", "no")
    return tmp_path


def test_csv_facts_and_sections(spark, folder):
    rows = S.read_counts_csv(spark, f"{folder}/csv")
    facts = S.facts(rows, "a").collect()
    assert len(facts) == 6 and all(f.region == "AC" and f.area == "1007" and f.zone == "9" for f in facts)
    assert sorted(f.category for f in facts) == ["13", "13", "13", "13", "22", "95"]
    assert json.loads(facts[0].row)["DS_TIPO_VOTAVEL"] == "Nominal"
    got = {r.unit: (r.valid, r.total, r.conflict) for r in S.section_counts(rows, "presidente", "1").where("region = 'AC'").collect()}
    assert got == {"1": (50, 52, False), "2": (144, 144, True)}


def test_ragged_rows_and_missing_columns_are_fatal(spark, folder):
    (folder / "csv/bad.csv").write_text(HEADER + '\n"1";"AC"\n', "latin-1")
    with pytest.raises(Exception, match="(?i)malformed|column"):
        S.read_counts_csv(spark, f"{folder}/csv/bad.csv").collect()
    with pytest.raises(ValueError, match="NOPE"):
        S.require(S.read_counts_csv(spark, f"{folder}/csv/a.csv"), ["NOPE"])


def test_zip(spark, folder):
    members = S.archive_members(S.archives(spark, f"{folder}/zip")).collect()
    assert len(members) == 4
    for mounted in (False, True):
        rows = S.read_zipped_csv(spark, f"{folder}/zip", mounted=mounted)
        assert rows.count() == 9 and rows.where("QT_VOTOS = '143'").count() == 2
    assert rows.rdd.getNumPartitions() == 2  # a member each
    again = S.zipped(rows.withColumn("QT_VOTOS", F.lit("1\n2;3")), "archive", "member", S.COUNT_COLUMNS)
    back = S.zipped_csv(again)
    assert back.count() == 9 and back.where("QT_VOTOS = '1\n2;3'").count() == 9  # a line break within quotes
    with zipfile.ZipFile(folder / "zip/bad.zip", "w") as z:
        z.writestr("x.csv", HEADER + "\n1;2\n")
    with pytest.raises(Exception, match="ragged"):
        S.read_zipped_csv(spark, f"{folder}/zip").collect()


def test_archives_are_written_from_chunks(spark, monkeypatch):
    """What is dealt to an archive's task is its compressed chunks, not its rows; they are cut at a size and give the same rows back."""
    monkeypatch.setattr(S, "CHUNK", 2000)
    rows = spark.range(3000).select(F.concat(F.col("id") % 3, F.lit(".zip")).alias("a"), F.concat(F.col("id") % 2, F.lit(".csv")).alias("m"), F.col("id").cast("string").alias("x"), F.lit('é;"\n').alias("y"))
    got = S.zipped(rows, "a", "m", ["x", "y"])
    sorts = got._jdf.queryExecution().optimizedPlan().toString().split("Sort [archive")[1]
    assert "MapInPandas" in sorts and "chunk" in sorts
    assert got.count() == 3 and sorted(map(tuple, S.archive_members(got).select("archive", "member").collect())) == [(f"{a}.zip", f"{m}.csv") for a in range(3) for m in range(2)]
    back = S.zipped_csv(got, ["x", "y"])
    assert sorted((r.archive, r.member, r.x, r.y) for r in back.collect()) == sorted(map(tuple, rows.collect()))



def test_nested_documents(spark, tmp_path):
    doc = {"dg": "04/10/2026", "carg": [{"cd": "1", "agr": [{"par": [{"sg": "AA", "cand": [{"n": "13", "nm": "X", "vap": "1.234", "pvapn": "99,16"}, {"n": "22", "nm": "Y", "vap": "", "pvapn": None}]}]}]}], "s": {"st": "5", "ts": "10"}, "v": {"vv": "1.234"}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    rows = S.read_results(spark, str(tmp_path / "r.json"))
    got = {r.number: (r.votes, r.percent, r.units, r.valid, r.party) for r in rows.collect()}
    assert got == {"13": (1234, 99.16, 5, 1234, "AA"), "22": (None, None, 5, 1234, "AA")}
    assert S.result_map(rows).first().votes == {"13": 1234, "22": None}
    config = {"abr": [{"cd": "AC", "mu": [{"cd": "1", "nm": "M", "zon": [{"cd": "9", "sec": [{"ns": "1", "da": "04/10/2026", "ha": "17:00:00"}, {"ns": "2", "nsp": "1"}, {"ns": "1"}]}]}]}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    units = S.read_config_units(spark, str(tmp_path / "c.json"))
    assert sorted((u.unit, u.principal, u.arrived is None) for u in units.collect()) == [("1", True, False), ("1", True, True), ("2", False, True)]
    assert [(r.unit, r.times) for r in S.repeated(units, ["region", "area", "zone", "unit"]).collect()] == [("1", 2)]
    (tmp_path / "p.json").write_text(json.dumps({"colunas": ["a", "b"], "linhas": [["1", "2"], ["3", None]]}))
    assert [tuple(r) for r in S.read_packed_table(spark, str(tmp_path / "p.json"), ["a", "b"]).collect()] == [("1", "2"), ("3", None)]
    with pytest.raises(Exception, match="unexpected columns"):
        S.read_packed_table(spark, str(tmp_path / "p.json"), ["a", "c"]).collect()


def test_manifest_audit_finds_a_flipped_byte(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for name, text in [("x_1.csv", "one"), ("x_2.csv", "two"), ("y_1.json", "3")]:
        (data / name).write_text(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = [("x_1.csv", sha("one")), ("x_2.csv", sha("TWO")), ("gone.csv", sha("")), ("../../etc/passwd", sha(""))]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"path": p, "sha256": h, "captured": "2026-10-04T17:00:00Z"}) for p, h in lines))
    hashed = S.hash_files(spark, str(data))
    got = {r.path: r.status for r in S.audit_manifest(S.read_manifest(spark, str(tmp_path / "m.jsonl")), hashed, str(data)).collect()}
    assert got == {"x_1.csv": "OK", "x_2.csv": "CHANGED", "gone.csv": "MISSING", "../../etc/passwd": "UNSAFE", "y_1.json": "UNDECLARED"}
    rows = lambda *x: spark.createDataFrame([(p, h, 1) for p, h in x], "path string, sha256 string, bytes long")
    got = {r.path: r.status for r in S.audit_manifest(rows(("a/x", "1"), ("./b/x", "2")), rows(("a/x", "2"), ("b/x", "2"))).collect()}
    assert got == {"a/x": "CHANGED", "b/x": "OK"}  # one name in two folders
    inv = {(r.prefix, r.extension): (r.files, r.samples) for r in S.inventory(hashed).collect()}
    assert inv["x", "csv"] == (2, ["x_1.csv", "x_2.csv"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", "b", 1), ("t1", "a", None), ("t2", "a", 3)], "ts string, c string, n long")
    S.write_wide(df, str(tmp_path / "wide"), "ts", "c", "n", ["b", "a"])
    lines = [line for f in sorted((tmp_path / "wide").glob("part-*.csv")) for line in f.read_text().splitlines()]
    assert "ts;a;b" in lines and "t1;;1" in lines and "t2;3;" in lines
    S.write_backup(df, str(tmp_path / "backup"))
    back = [json.loads(line) for f in (tmp_path / "backup").glob("part-*") for line in f.read_text().splitlines()]
    assert {"ts": "t1", "c": "a", "n": None} in back and len(back) == 3
    assert S.control_totals(df, {"n": 4}).count() == 3
    with pytest.raises(ValueError, match="control totals"):
        S.control_totals(df, {"n": 5})


def test_headers():
    assert S.canonical_header(["﻿a", "", "A", "b "]) == ["A", "COL_1", "A_DUP1", "B"]


def test_scalars(spark):
    rows = spark.createDataFrame([("1.234",), ("99,16",), ("007",), (" abc ",), ("12abc",), ("-5",), ("",), (None,)], "x string")
    x = F.col("x")
    got = {r.x: tuple(r)[1:] for r in rows.select("x", scalars.locale_int(x), scalars.locale_float(x), scalars.strict_int(x), scalars.prefix_int(x), scalars.canonical_category(x)).collect()}
    assert got["1.234"] == (1234, 1.234, None, 1, "1.234") and got["99,16"] == (None, 99.16, None, 99, "99,16")
    assert got["007"] == (7, 7.0, 7, 7, "7") and got[" abc "] == (None, None, None, 0, "ABC") and got["12abc"][3] == 12
    assert got["-5"][2] == -5 and got[""][4] == "" and got[None] == (None, None, None, 0, None)
    times = spark.createDataFrame([("04/10/2026 17:01:02",), ("04/10/2026 17:01",), ("2026-10-04 17:01:02",), ("nope",)], "x string")
    ts, seconds = scalars.parse_time(F.col("x"))
    assert [(str(a), b) for a, b in times.select(ts, seconds).collect()] == [("2026-10-04 17:01:02", True), ("2026-10-04 17:01:00", False), ("2026-10-04 17:01:02", True), ("None", False)]
    names = spark.createDataFrame([("counts_1t_AC_2026.zip",), ("https://x/y/sp/file",), ("none",)], "x string")
    assert [r[0] for r in names.select(scalars.region_of(F.col("x"), ["AC", "SP"])).collect()] == ["AC", "SP", None]
    known = ["AC", "SP"]
    for name, url, want in [("AC - counts", "x", "AC"), ("counts", "https://x/bweb_1t_SP_1.zip?a=b", "SP"), (None, "https://x/votes%5F2026_AC.csv", "AC"), ("XX - counts", "https://x/bweb_1t_XX_1_SP.zip", "SP"), ("counts", None, None)]:
        assert spark.range(1).select(scalars.region_of_resource(F.lit(name), F.lit(url), known)).first()[0] == want, name
    for name, want in [("p000407-ac-m01007-z0009-s0012.dat", ("AC", "1007", "9", "12")), ("o/SP/71072/0001/0100", ("SP", "71072", "1", "100")), ("a\\ac\\m01007\\z9\\s1.jez", ("AC", "1007", "9", "1")), ("o/xx/71072/0001/0100", None), ("counts.csv", None), (None, None)]:
        got = spark.range(1).select(scalars.unit_of_file(F.lit(name), known).alias("x")).first().x
        assert (tuple(got) if got else None) == want, name
    assert spark.range(1).select(scalars.plain_key(F.lit("Ação ÜBER ñandú"))).first()[0] == "acao uber nandu"
    same = spark.createDataFrame([("União", "uniao")], "a string, b string").select((scalars.accent_free(F.col("a")) == scalars.accent_free(F.col("b"))).alias("e")).first()
    assert same.e


def test_crc_matches_zlib(spark):
    import zlib

    rows = spark.createDataFrame([("AC", 7), ("São", 8)], "a string, b int")
    for r in rows.select("a", "b", scalars.crc_bucket(256, "a", "b").alias("k")).collect():
        assert r.k == zlib.crc32(f"{r.a}|{r.b}".encode()) % 256


def test_fingerprints(spark):
    df = spark.range(50).select("id", (F.col("id") * 3).alias("n"))
    assert V.table_fingerprint(df) == V.table_fingerprint(df.repartition(7).orderBy(F.desc("id")))
    assert V.table_fingerprint(df) != V.table_fingerprint(df.withColumn("n", F.when(F.col("id") == 4, 0).otherwise(F.col("n"))))
    assert V.fingerprint({"a": "1", "b": "2"}, {"p": 1}) == V.fingerprint({"b": "2", "a": "1"}, {"p": 1}) != V.fingerprint({"a": "1", "b": "2"}, {"p": 2})


def test_phases_replay(spark, tmp_path):
    runs = []

    def sums(_, t):
        runs.append("sums")
        return t["facts"].groupBy("k").agg(F.sum("n").alias("n"))

    r = V.Registry([V.Phase("top", ("sums",), lambda _, t: t["sums"].orderBy(F.desc("n")).limit(1)), V.Phase("sums", ("facts",), sums)])
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n long")
    go = lambda f, **kw: [(n, s) for n, _, s in r.replay(spark, {"facts": f}, f"file://{tmp_path}/out", **kw)]
    assert go(facts, dry=True) == [("sums", "WOULD_RUN"), ("top", "WOULD_RUN")]
    assert go(facts) == [("sums", "RAN"), ("top", "RAN")]
    assert go(facts) == [("sums", "REUSED"), ("top", "REUSED")] and runs == ["sums"]
    assert go(facts.where("n > 1"))[0] == ("sums", "RAN")
    assert r.missing_sources(["other"]) == [("sums", "facts")]
    with pytest.raises(ValueError, match="cycle"):
        V.Registry([V.Phase("a", ("b",), sums), V.Phase("b", ("a",), sums)]).order()


def test_seal(spark, tmp_path):
    out = f"{tmp_path}/t"
    spark.range(10).repartition(2).write.parquet(out)
    rows = [tuple(r) for r in V.seal(spark, out).collect()]
    sealed = spark.createDataFrame(rows, "name string, bytes long, sha256 string")
    assert sealed.count() == 2 and V.verify(spark, out, sealed).isEmpty()
    part = next((tmp_path / "t").glob("part-*"))
    data = bytearray(part.read_bytes())
    data[-20] ^= 1
    part.write_bytes(bytes(data))
    part.with_name(f".{part.name}.crc").unlink()  # else the file system itself refuses to read it
    assert [(r.name, r.status) for r in V.verify(spark, out, sealed).collect()] == [(part.name, "CHANGED")]
