"""Readers of delimited, zipped and nested JSON counts, and the sinks. Every reader has a declared schema and asserts it."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from countloom.functions import scalars
from countloom.operators.reconcile import fatal_if_any

# The columns of the published count files, as they are named there.
COUNT_COLUMNS = ("NR_TURNO", "SG_UF", "CD_MUNICIPIO", "NR_ZONA", "NR_SECAO", "DS_CARGO_PERGUNTA", "DT_BU_RECEBIDO", "DS_TIPO_VOTAVEL", "NR_VOTAVEL", "QT_VOTOS")

#: Shape of a nested result document: offices, groups, parties and candidates, with totals beside them.
RESULT = """dg string, hg string, carg array<struct<cd:string, agr:array<struct<par:array<struct<sg:string, cand:array<struct<n:string, nm:string, vap:string, pvapn:string>>>>>>>>,
 s struct<st:string, ts:string, pstn:string>, v struct<vv:string, tv:string, vb:string, tvn:string>, e struct<c:string, te:string, a:string>"""
#: Shape of a nested configuration document: regions, areas, zones and units; nsp marks a unit that is part of another.
CONFIG = "abr array<struct<cd:string, mu:array<struct<cd:string, nm:string, zon:array<struct<cd:string, sec:array<struct<ns:string, nsp:string, da:string, ha:string>>>>>>>>"


def canonical_header(names: Sequence[str]) -> list[str]:
    """Names without a byte order mark, upper-cased; empty ones are numbered and repeated ones marked."""
    seen: dict[str, int] = {}
    out = []
    for k, name in enumerate(names):
        n = (name or "").replace("﻿", "").strip().upper() or f"COL_{k}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_DUP{seen[n] - 1}")
    return out


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_counts_csv(spark: SparkSession, path: str, columns: Sequence[str] = COUNT_COLUMNS, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited text, every value as text; a row with more or fewer fields than the header is fatal."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, sep=sep, header=True, encoding=encoding, quote='"', mode="FAILFAST", enforceSchema=False)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """ZIP files as rows (path, content), by Spark's own reader: from any store, up to 2 GiB each. :class:`ZippedRows` has no such bound."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archive_members(archives: DataFrame) -> DataFrame:
    """(archive, member, bytes, crc) of the files within archives (path, content)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    out += [(name, i.filename, i.file_size, i.CRC) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(out, columns=["archive", "member", "bytes", "crc"])

    return archives.mapInPandas(run, "archive string, member string, bytes long, crc long")


#: What readers of zipped text give: a row of a member, its place and its fields.
ROWS = "archive string, member string, line long, fields array<string>"


def _member_rows(name: str, z: zipfile.ZipFile, member: zipfile.ZipInfo, sep: str, encoding: str) -> Iterator[tuple]:
    """Rows of one member, read as a stream; a line break within quotes belongs to its field."""
    with z.open(member) as f:
        for k, fields in enumerate(csv.reader(io.TextIOWrapper(f, encoding=encoding, newline=""), delimiter=sep)):
            yield name, member.filename, k, [x.replace("\ufeff", "") for x in fields]


def zipped_rows(archives: DataFrame, suffix: str = ".csv", sep: str = ";", encoding: str = "ISO-8859-1", block: int = 20_000) -> DataFrame:
    """Rows of the text members of archives (path, content), read as a stream within each."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        if not i.is_dir() and i.filename.lower().endswith(suffix):
                            rows = _member_rows(name, z, i, sep, encoding)
                            while part := list(islice(rows, block)):
                                yield pd.DataFrame(part, columns=["archive", "member", "line", "fields"])

    return archives.mapInPandas(run, ROWS)


class ZippedRows(DataSource):
    """``spark.read.format("zipped_rows").load(folder)``: text members of ZIP files under a path that driver and executors mount.

    Each member is a split of its own, read as a stream: no archive is held, whatever its size. Options: suffix, sep, encoding.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_rows"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema):
        return _ZippedReader(self.options)


class _Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


class _ZippedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"].removeprefix("file://"), options.get("suffix", ".csv")
        self.sep, self.encoding = options.get("sep", ";"), options.get("encoding", "ISO-8859-1")

    def partitions(self):
        path = Path(self.path)
        found = []
        for p in sorted(path.rglob("*.zip")) if path.is_dir() else [path]:
            with zipfile.ZipFile(p) as z:
                found += [_Member(str(p), i.filename) for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(self.suffix)]
        return found or [_Member("", "")]

    def read(self, partition):
        if partition.archive:
            with zipfile.ZipFile(partition.archive) as z:
                yield from _member_rows(partition.archive, z, z.getinfo(partition.member), self.sep, self.encoding)


def with_columns(rows: DataFrame, columns: Sequence[str] = COUNT_COLUMNS) -> DataFrame:
    """(archive, member, line, columns) of zipped rows; another header or number of fields is fatal."""
    want = F.array(*[F.lit(c.upper()) for c in columns])
    header = F.transform("fields", lambda x: F.upper(F.trim(x)))
    wrong = F.when((F.col("line") == 0) & (header != want), F.raise_error(F.concat(F.lit("unexpected header in "), "member"))).when(F.size("fields") != len(columns), F.raise_error(F.concat(F.lit("ragged row in "), "member")))
    checked = rows.withColumn("wrong", wrong.cast("string")).where("wrong is null and line > 0")
    return checked.select("archive", "member", "line", *[F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def zipped_csv(archives: DataFrame, columns: Sequence[str] = COUNT_COLUMNS, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """The CSV members of archives (path, content) as rows."""
    return with_columns(zipped_rows(archives, sep=sep, encoding=encoding), columns)


def read_zipped_csv(spark: SparkSession, path: str, columns: Sequence[str] = COUNT_COLUMNS, mounted: bool = False) -> DataFrame:
    """The CSV members of the ZIP files at ``path``; ``mounted`` takes the reader that has no bound on an archive's size."""
    if mounted:
        spark.dataSource.register(ZippedRows)
        return with_columns(spark.read.format("zipped_rows").load(path), columns)
    return zipped_csv(archives(spark, path), columns)


#: Characters of text that a task holds before it compresses them, and so the most that a chunk has.
CHUNK = 16 << 20


def zipped(rows: DataFrame, archive: str, member: str, columns: Sequence[str], sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Archives (path, content) of CSV members, the reverse of :func:`zipped_csv`.

    Rows become compressed chunks of members where they lie; only chunks are dealt and sorted, and an archive is written from its own as a stream.
    """

    def chunks(batches):
        import pandas as pd

        held: dict[tuple, io.StringIO] = {}
        size = 0

        def packed():
            out = [(a, m, zlib.compress(text.getvalue().encode(encoding))) for (a, m), text in held.items()]
            held.clear()
            return pd.DataFrame(out, columns=["archive", "member", "chunk"])

        for b in batches:
            for a, m, *values in zip(*(b[c] for c in b.columns)):
                if (a, m) not in held:
                    held[a, m] = io.StringIO(newline="")
                text = held[a, m]
                began = text.tell()
                csv.writer(text, delimiter=sep, quoting=csv.QUOTE_ALL, lineterminator="\n").writerow(values)
                size += text.tell() - began
                if size > CHUNK:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    def run(batches):
        import pandas as pd

        name, inside, held, z, f = None, None, None, None, None

        def closed():
            f.close()
            z.close()
            return pd.DataFrame({"path": [name], "content": [held.getvalue()]})

        for b in batches:
            for a, m, chunk in zip(b["archive"], b["member"], b["chunk"]):
                if a != name:
                    if name is not None:
                        yield closed()
                    name, inside, held = a, None, io.BytesIO()
                    z = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED)
                if m != inside:
                    if inside is not None:
                        f.close()
                    inside, f = m, z.open(m, "w")
                    head = io.StringIO(newline="")
                    csv.writer(head, delimiter=sep, quoting=csv.QUOTE_ALL, lineterminator="\n").writerow(columns)
                    f.write(head.getvalue().encode(encoding))
                f.write(zlib.decompress(chunk))
        if name is not None:
            yield closed()

    packed = rows.select(F.col(archive), F.col(member), *columns).mapInPandas(chunks, "archive string, member string, chunk binary")
    return packed.repartition("archive").sortWithinPartitions("archive", "member").mapInPandas(run, "path string, content binary")


def facts(rows: DataFrame, source: str) -> DataFrame:
    """Canonical facts from count rows; blank keys are left out, an unreadable count stays null; the row is kept as JSON."""
    c = lambda name: scalars.canonical_category(F.col(name))
    out = rows.select(
        F.lit(source).alias("source"), F.upper(F.trim("SG_UF")).alias("region"), c("CD_MUNICIPIO").alias("area"), c("NR_ZONA").alias("zone"), c("NR_SECAO").alias("unit"), c("NR_TURNO").alias("turn"), c("DS_CARGO_PERGUNTA").alias("contest"),
        c("NR_VOTAVEL").alias("category"), scalars.strict_int(F.col("QT_VOTOS")).alias("n"), F.to_json(F.struct(*rows.columns)).alias("row"),
    )
    keys = ["region", "area", "zone", "unit", "turn", "contest", "category"]
    filled = F.forall(F.array(*[F.coalesce(F.col(k), F.lit("")) for k in keys]), lambda x: x != "")
    return out.where(filled)


def section_counts(rows: DataFrame, contest: str, turn: str, invalid: Sequence[str] = ("95", "96")) -> DataFrame:
    """Per unit valid and all counts of one contest and turn, its time of receipt, and whether it has two of them."""
    keys = {"region": "SG_UF", "area": "CD_MUNICIPIO", "zone": "NR_ZONA", "unit": "NR_SECAO"}
    chosen = rows.where((F.upper(F.trim("DS_CARGO_PERGUNTA")) == contest.upper()) & (scalars.canonical_category(F.col("NR_TURNO")) == turn))
    ts, _ = scalars.parse_time(F.col("DT_BU_RECEBIDO"))
    n = scalars.strict_int(F.col("QT_VOTOS"))
    valid = ~scalars.canonical_category(F.col("NR_VOTAVEL")).isin(*invalid) & ~F.lower(F.coalesce("DS_TIPO_VOTAVEL", F.lit(""))).rlike("branco|nulo")
    grouped = chosen.groupBy(*[scalars.canonical_category(F.col(v)).alias(k) for k, v in keys.items()])
    return grouped.agg(F.sum(F.when(valid, n)).alias("valid"), F.sum(n).alias("total"), F.min(ts).alias("received"), (F.count_distinct(ts) > 1).alias("conflict"))


def category_counts(rows: DataFrame, number: str, split: str, kinds: Sequence[str]) -> DataFrame:
    """(region, unit, n, <split>_<kind> ...): one category's counts by unit with a breakdown; units without any go."""
    n, c = scalars.strict_int(F.col("QT_VOTOS")), scalars.canonical_category
    name = split.rpartition("_")[2].lower()
    name = "turn" if split == "NR_TURNO" else name
    parts = [F.sum(F.when(c(F.col(split)) == k, n)).alias(f"{name}_{k}") for k in kinds]
    chosen = rows.where(c(F.col("NR_VOTAVEL")) == number)
    return chosen.groupBy(F.upper(F.trim("SG_UF")).alias("region"), c(F.col("NR_SECAO")).alias("unit")).agg(F.sum(n).alias("n"), *parts).where("n > 0")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, contest, party, number, name, votes, units, units_total, valid) from nested result documents."""
    docs = spark.read.schema(RESULT).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    rows = docs.select("*", F.explode("carg").alias("o")).select("*", F.explode("o.agr").alias("g")).select("*", F.explode("g.par").alias("p")).select("*", F.explode("p.cand").alias("c"))
    i = lambda c: scalars.locale_int(F.col(c))
    return rows.select("file", F.col("o.cd").alias("contest"), F.col("p.sg").alias("party"), F.col("c.n").alias("number"), F.col("c.nm").alias("name"), i("c.vap").alias("votes"), i("s.st").alias("units"), i("s.ts").alias("units_total"), i("v.vv").alias("valid"), scalars.locale_float(F.col("c.pvapn")).alias("percent"))


def result_map(results: DataFrame, blank: str = "95", void: str = "96") -> DataFrame:
    """One map of votes by number for each file and contest."""
    return results.groupBy("file", "contest").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("number", "votes")))).alias("votes"))


def sum_maps(rows: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Maps of counts summed key by key."""
    flat = rows.select(*by, F.explode(column).alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    return flat.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(column))


def read_config_units(spark: SparkSession, path: str) -> DataFrame:
    """(region, area, zone, unit, principal, arrived): units of a configuration; principal ones are not part of another."""
    docs = spark.read.schema(CONFIG).json(path, multiLine=True)
    rows = docs.select(F.explode("abr").alias("a")).select(F.col("a.cd").alias("region"), F.explode("a.mu").alias("m"))
    rows = rows.select("region", F.col("m.cd").alias("area"), F.explode("m.zon").alias("z")).select("region", "area", F.col("z.cd").alias("zone"), F.explode("z.sec").alias("s"))
    arrived = F.try_to_timestamp(F.concat_ws(" ", "s.da", "s.ha"), F.lit("dd/MM/yyyy HH:mm:ss"))
    return rows.select("region", "area", "zone", F.col("s.ns").alias("unit"), F.col("s.nsp").isNull().alias("principal"), arrived.alias("arrived"))


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def read_packed_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A JSON table of one list of column names and one of rows; the names are asserted by position."""
    docs = spark.read.schema("colunas array<string>, linhas array<array<string>>").json(path, multiLine=True)
    want = F.array(*[F.lit(c) for c in columns])
    rows = docs.select(F.when(F.col("colunas") == want, F.col("linhas")).otherwise(F.raise_error(F.lit("unexpected columns"))).alias("linhas")).select(F.explode("linhas").alias("r"))
    return rows.select(*[F.get("r", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def validated_mapping(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """A reference table of one row per key with no blank field; anything else is fatal."""
    require(df, [key, *required])
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(c), F.lit("")) == "" for c in (key, *required)])
    fatal_if_any(df.where(blank), "blank field")
    fatal_if_any(repeated(df, [key]), "key occurs twice")
    return df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (path, sha256, captured)."""
    return spark.read.schema("path string, sha256 string, captured timestamp").json(path)


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files at ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def audit_manifest(manifest: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(path, declared, bytes, status) of every declared and every present file, by the path below ``root``.

    A declared path that leaves the folder is UNSAFE; files of one name in different folders are different files.
    """
    unsafe = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    tidy = F.regexp_replace(F.regexp_replace("path", r"/(?:\./)+|//+", "/"), r"^\./", "")
    declared = manifest.select(F.col("path").alias("declared"), F.col("sha256").alias("want"), unsafe.alias("unsafe"), tidy.alias("at"))
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(root.removeprefix('file://').rstrip('/'))}/", "") if root else F.col("path")
    present = files.select(below.alias("at"), "sha256", "bytes", F.lit(True).alias("there"))
    status = F.when(F.col("unsafe"), "UNSAFE").when(F.col("declared").isNull(), "UNDECLARED").when(F.col("there").isNull(), "MISSING").when(~F.col("sha256").eqNullSafe(F.col("want")), "CHANGED").otherwise("OK")
    return declared.join(present, "at", "full_outer").select(F.col("at").alias("path"), "declared", "bytes", status.alias("status"))


def inventory(files: DataFrame, samples: int = 2) -> DataFrame:
    """Files by prefix and extension: how many, how many hashed, bytes, and the first names."""
    named = files.select(F.substring_index(F.element_at(F.split("path", "/"), -1), "_", 1).alias("prefix"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), "path", "bytes", "sha256")
    return named.groupBy("prefix", "extension").agg(F.count("*").alias("files"), F.count("sha256").alias("hashed"), F.sum("bytes").alias("bytes"), F.slice(F.sort_array(F.collect_set(F.element_at(F.split("path", "/"), -1))), 1, samples).alias("samples"))


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """Delimited output; Spark's commit protocol makes it whole or absent. Nulls are empty fields."""
    df.write.csv(path, sep=sep, header=True, emptyValue="", nullValue="")


def write_wide(counts: DataFrame, path: str, key: str, category: str, n: str, categories: Sequence[str]) -> None:
    """A column per category, in sorted order."""
    wide = counts.groupBy(key).agg(*[F.sum(F.when(F.col(category) == c, F.col(n))).alias(c) for c in sorted(categories)])
    write_csv(wide.orderBy(key), path)


def write_backup(df: DataFrame, path: str) -> None:
    """Every row whole, as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def control_totals(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Raises where a control total is not met; returns ``df``."""
    got = df.agg(*[F.sum(c).cast(LongType()).alias(c) for c in expected]).first().asDict()
    wrong = {c: (got[c], n) for c, n in expected.items() if got[c] != n}
    if wrong:
        raise ValueError(f"control totals differ (found, expected): {wrong}")
    return df
