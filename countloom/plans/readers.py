"""Queries through the readers and sinks: tables are written as files into the shared folder and read back, each beside its SQL twin.

The files hold all rows of the tables they come from, in the shapes that the readers expect; only what the reader gives is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions import scalars
from countloom.plans import provenance as V
from countloom.plans.registry import query
from countloom.sources import files as S
from countloom.sources.driver import COUNTED, counted, feed, table
from countloom.sources.storage import new_path
from countloom.streaming import feeds as T

#: Category, number and kind on a published row.
KINDS = [("RF", "13", "Nominal"), ("AF", "022", "Nominal"), ("NF", "95", "Branco"), ("NO", "45", "Nominal"), ("AO", "7", "Nominal"), ("RO", "033", "Nominal")]


def published(spark, sf_dir) -> DataFrame:
    """The facts as rows of a published count file: every value is text, codes have leading zeros."""
    number = F.element_at(F.create_map(*[F.lit(x) for k, n, _ in KINDS for x in (k, n)]), F.col("category"))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, _, t in KINDS for x in (k, t)]), F.col("category"))
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    received = F.date_format(F.col("received").cast("timestamp"), "dd/MM/yyyy HH:mm:ss")
    values = [(F.col("l_suppkey") % 2 + 1).cast("string"), F.lower("region"), pad("area", 5), pad("zone", 4), pad("unit", 9), F.concat(F.lit("Office "), "contest"), received, kind, number, F.col("n").cast("string")]
    return counted(spark, sf_dir).select(*[v.alias(c) for c, v in zip(S.COUNT_COLUMNS, values)])


def _number(c: str = "category") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{n.lstrip('0')}'" for k, n, _ in KINDS) + " END"


def _as_csv(spark, sf_dir) -> str:
    path = new_path(spark, "published-csv")
    published(spark, sf_dir).write.csv(path, sep=";", header=True, quoteAll=True, encoding="ISO-8859-1")
    return path


_PUBLISHED = f"{COUNTED}, published AS (SELECT *, CAST(l_suppkey % 2 + 1 AS VARCHAR) AS turn, {_number()} AS number FROM counted)"
_FACTS = f"WITH {_PUBLISHED} SELECT upper(region) AS region, turn, 'OFFICE ' || contest AS contest, number AS category, count(*) AS facts, CAST(sum(n) AS BIGINT) AS n FROM published GROUP BY ALL"


def _fact_totals(facts: DataFrame) -> DataFrame:
    return facts.groupBy("region", "turn", "contest", "category").agg(F.count("*").alias("facts"), F.sum("n").alias("n"))


@query(_FACTS)
def csv_facts(spark, sf_dir):
    """Canonical facts from delimited text in a single-byte encoding."""
    return _fact_totals(S.facts(S.read_counts_csv(spark, _as_csv(spark, sf_dir)), "a"))


@query(_FACTS)
def csv_stream_facts(spark, sf_dir):
    """The same facts by a stream over the files, with offsets and output committed together; a second run finds nothing new."""
    source, run = _as_csv(spark, sf_dir), new_path(spark, "csv-stream")
    for _ in range(2):
        rows = spark.readStream.schema(S.read_counts_csv(spark, source).schema).option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(source)
        T.run_to_end(S.facts(rows, "a").select("region", "turn", "contest", "category", "n"), f"{run}/table", f"{run}/checkpoint")
    return _fact_totals(spark.read.parquet(f"{run}/table"))


@query(
    f"""WITH {_PUBLISHED} SELECT upper(region) AS region, CAST(area AS VARCHAR) AS area, CAST(zone AS VARCHAR) AS zone, CAST(unit AS VARCHAR) AS unit, CAST(sum(n) FILTER (WHERE number <> '95') AS BIGINT) AS valid, CAST(sum(n) AS BIGINT) AS total,
    date_trunc('second', min(received)) AS received, count(DISTINCT date_trunc('second', received)) > 1 AS conflict FROM published WHERE contest = '1' AND turn = '1' GROUP BY ALL"""
)
def section_receipts(spark, sf_dir):
    """Valid and all counts per unit of one office and turn, time of receipt and whether there are two of them."""
    got = S.section_counts(S.read_counts_csv(spark, _as_csv(spark, sf_dir)), "Office 1", "1")
    return got.select(F.upper("region").alias("region"), "area", "zone", "unit", "valid", "total", F.col("received").cast("timestamp_ntz").alias("received"), "conflict")


@query(f"WITH {_PUBLISHED} SELECT upper(region) AS region, CAST(unit AS VARCHAR) AS unit, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (WHERE turn = '1') AS BIGINT) AS turn_1, CAST(sum(n) FILTER (WHERE turn = '2') AS BIGINT) AS turn_2 FROM published WHERE number = '22' GROUP BY ALL HAVING sum(n) > 0")
def category_scan(spark, sf_dir):
    """One category's counts per unit with a breakdown; units without any are left out."""
    return S.category_counts(S.read_counts_csv(spark, _as_csv(spark, sf_dir)), "22", "NR_TURNO", ["1", "2"]).select("region", "unit", "n", "turn_1", "turn_2")


_ARCHIVES = f"""{_PUBLISHED}, lines AS (SELECT region, contest, count(*) AS facts, CAST(sum(n) AS BIGINT) AS n FROM published GROUP BY 1, 2)"""


def _archives(spark, sf_dir) -> DataFrame:
    """ZIP archives as rows (path, content): one per region and office, written by the tasks."""
    return S.zipped(published(spark, sf_dir).withColumn("archive", F.concat(F.lit("counts_1t_"), F.upper("SG_UF"), F.lit(".zip"))).withColumn("member", F.concat(F.regexp_replace("DS_CARGO_PERGUNTA", " ", "_"), F.lit(".csv"))), "archive", "member", S.COUNT_COLUMNS)


@query(f"WITH {_ARCHIVES} SELECT 'counts_1t_' || upper(region) || '.zip' AS archive, 'Office_' || contest || '.csv' AS member, facts, n FROM lines")
def zip_facts(spark, sf_dir):
    """Rows of the CSV members of ZIP archives; line breaks within quotes stay within their row."""
    rows = S.zipped_csv(_archives(spark, sf_dir))
    return S.facts(rows, "zip").withColumn("x", F.from_json("row", "archive string, member string")).groupBy("x.archive", "x.member").agg(F.count("*").alias("facts"), F.sum("n").alias("n"))


@query(f"WITH {_ARCHIVES} SELECT 'counts_1t_' || upper(region) || '.zip' AS archive, count(*) AS members, true AS has_bytes FROM lines GROUP BY region")
def zip_catalogue(spark, sf_dir):
    """The members of archives; an archive that occurs twice would be an error."""
    members = S.archive_members(_archives(spark, sf_dir))
    return members.groupBy("archive").agg(F.count("*").alias("members"), (F.min("bytes") > 0).alias("has_bytes"))


def _results(spark, sf_dir) -> str:
    """Nested result documents, one per region and office, as JSON files of a snapshot folder."""
    t = counted(spark, sf_dir).groupBy("region", "contest", "category").agg(F.sum("n").alias("n"), F.count_distinct("unit").alias("units"))
    party = F.substring("category", 1, 1)
    c = F.struct(F.col("category").alias("n"), F.concat(F.lit("Name "), "category").alias("nm"), F.translate(F.format_string("%,d", "n"), ",", ".").alias("vap"), F.lit("12,5").alias("pvapn"))
    p = t.select("region", "contest", party.alias("sg"), c.alias("cand"), "n", "units").groupBy("region", "contest", "sg").agg(F.collect_list("cand").alias("cand"), F.sum("n").alias("n"), F.max("units").alias("units"))
    o = p.groupBy("region", "contest").agg(F.collect_list(F.struct("sg", "cand")).alias("par"), F.sum("n").alias("n"), F.max("units").alias("units"))
    office = F.struct(F.col("contest").alias("cd"), F.array(F.struct("par")).alias("agr"))
    s = F.struct(F.col("units").cast("string").alias("st"), F.col("units").cast("string").alias("ts"), F.lit("100,00").alias("pstn"))
    docs = o.select(F.array(office).alias("carg"), s.alias("s"), F.struct(F.col("n").cast("string").alias("vv")).alias("v"), "region", "contest")
    path = new_path(spark, "results")
    docs.select("carg", "s", "v", F.concat("region", F.lit("-"), "contest").alias("run")).write.partitionBy("run").json(path)
    return path


_RESULT = f"{COUNTED}, r AS (SELECT region, contest, category, CAST(sum(n) AS BIGINT) AS votes, count(DISTINCT unit) AS units FROM counted GROUP BY ALL)"


@query(f"WITH {_RESULT} SELECT region || '-' || contest AS run, contest, substr(category, 1, 1) AS party, category AS number, 'Name ' || category AS name, votes, 12.5::DOUBLE AS percent, max(units) OVER (PARTITION BY region, contest) AS units, CAST(sum(votes) OVER (PARTITION BY region, contest) AS BIGINT) AS valid FROM r")
def result_documents(spark, sf_dir):
    """Candidates of nested result documents, found in the folders of their runs."""
    got = S.read_results(spark, f"{_results(spark, sf_dir)}/run=*")
    return got.select(F.regexp_extract("file", "run=([^/]+)/", 1).alias("run"), "contest", "party", "number", "name", "votes", "percent", "units", "valid")


@query(f"WITH {_RESULT} SELECT contest, category AS number, CAST(sum(votes) AS BIGINT) AS votes FROM r GROUP BY ALL")
def result_maps(spark, sf_dir):
    """One map of votes per document, and their sum by office."""
    maps = S.result_map(S.read_results(spark, f"{_results(spark, sf_dir)}/run=*"))
    return S.sum_maps(maps, ["contest"], "votes").select("contest", F.explode("votes").alias("number", "votes"))


def _config(spark, sf_dir) -> str:
    """Nested configuration documents: a unit whose number 7 divides is part of another; one in eleven has no time yet."""
    u = counted(spark, sf_dir).groupBy("region", "area", "zone", "unit").agg(F.max("received").cast("timestamp").alias("at"))
    unit, there = F.col("unit").cast("string"), F.col("unit") % 11 != 0
    section = F.struct(unit.alias("ns"), F.when(F.col("unit") % 7 == 0, F.lit("1")).alias("nsp"), F.when(there, F.date_format("at", "dd/MM/yyyy")).alias("da"), F.when(there, F.date_format("at", "HH:mm:ss")).alias("ha"))
    z = u.select("region", "area", "zone", section.alias("s")).groupBy("region", "area", "zone").agg(F.collect_list("s").alias("sec"))
    m = z.groupBy("region", "area").agg(F.collect_list(F.struct(F.col("zone").cast("string").alias("cd"), "sec")).alias("zon"))
    a = m.groupBy("region").agg(F.collect_list(F.struct(F.col("area").cast("string").alias("cd"), F.lit("name").alias("nm"), "zon")).alias("mu"))
    path = new_path(spark, "config")
    a.select(F.array(F.struct(F.col("region").alias("cd"), "mu")).alias("abr"), F.col("region").alias("r")).write.partitionBy("r").json(path)
    return path


@query(
    f"""WITH {COUNTED}, u AS (SELECT region, area, zone, unit, max(received) AS done FROM counted GROUP BY ALL)
    SELECT region, CAST(area AS VARCHAR) AS area, count(*) AS units, count(*) FILTER (WHERE unit % 7 <> 0) AS principal, count(*) FILTER (WHERE unit % 11 <> 0) AS arrived, max(date_trunc('second', done)) FILTER (WHERE unit % 11 <> 0) AS latest, 0 AS repeated FROM u GROUP BY ALL"""
)
def config_units(spark, sf_dir):
    """Units of nested configurations by area: principal ones, those with a time, and keys that occur twice."""
    units = S.read_config_units(spark, f"{_config(spark, sf_dir)}/r=*")
    twice = S.repeated(units, ["region", "area", "zone", "unit"]).groupBy("region", "area").agg(F.count("*").alias("twice"))
    got = units.groupBy("region", "area").agg(F.count("*").alias("units"), F.count_if("principal").alias("principal"), F.count("arrived").alias("arrived"), F.max("arrived").cast("timestamp_ntz").alias("latest"))
    return got.join(twice, ["region", "area"], "left").select("region", "area", "units", "principal", "arrived", "latest", F.coalesce("twice", F.lit(0)).cast("int").alias("repeated"))


def _documents(spark, sf_dir) -> DataFrame:
    """Documents as files: (path, bytes, sha256), in folders by source, some of the same name in two of them."""
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit("/doc_"), F.floor(F.col("doc_id") / 50).cast("string"), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", name.alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"))


_FILES = "files AS (SELECT doc_id, coalesce(source, 'none') || '/' || (doc_id % 50) || '/doc_' || (doc_id // 50) || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents)"


@query("SELECT count(*) AS declared, min(date_trunc('second', o_orderdate)) AS first, max(date_trunc('second', o_orderdate)) AS last, CAST((epoch(max(date_trunc('second', o_orderdate))) - epoch(min(date_trunc('second', o_orderdate)))) // 60 AS BIGINT) AS minutes, count(DISTINCT o_custkey) AS hashes, 0 AS twice FROM orders")
def manifest_window(spark, sf_dir):
    """First and last capture of a JSON-lines manifest, and paths that occur twice."""
    path = new_path(spark, "manifest")
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    rows.select(F.concat(F.lit("run/"), F.col("o_orderkey").cast("string")).alias("path"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"), at.alias("captured")).write.json(path)
    m = S.read_manifest(spark, path)
    twice = S.repeated(m, ["path"]).agg(F.count("*").cast("int").alias("twice"))
    first, last = F.min("captured"), F.max("captured")
    got = m.agg(F.count("*").alias("declared"), first.cast("timestamp_ntz").alias("first"), last.cast("timestamp_ntz").alias("last"), F.timestamp_diff("MINUTE", first, last).alias("minutes"), F.count_distinct("sha256").alias("hashes"))
    return got.crossJoin(twice)  # a row each


@query(
    f"""WITH {_FILES}, m AS (SELECT path AS declared, CASE WHEN doc_id % 10 = 1 THEN sha256('other') ELSE sha256 END AS want FROM files WHERE doc_id % 10 <> 2 UNION ALL SELECT 'gone/' || doc_id || '.txt', sha256('') FROM files WHERE doc_id % 10 = 3 UNION ALL SELECT '../../' || path, sha256 FROM files WHERE doc_id % 10 = 4)
    SELECT CASE WHEN declared LIKE '../%' THEN 'UNSAFE' WHEN declared IS NULL THEN 'UNDECLARED' WHEN sha256 IS NULL THEN 'MISSING' WHEN sha256 <> want THEN 'CHANGED' ELSE 'OK' END AS status, count(*) AS files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM m FULL JOIN files ON declared = path GROUP BY 1"""
)
def manifest_audit(spark, sf_dir):
    """Declared files against those there, by path and hash; files of one name in two folders stay apart."""
    files = _documents(spark, sf_dir)
    k = F.col("doc_id") % 10
    declared = files.where(k != 2).select("path", F.when(k == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    declared = declared.unionAll(files.where(k == 3).select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.sha2(F.lit(""), 256))).unionAll(files.where(k == 4).select(F.concat(F.lit("../../"), "path"), "sha256"))
    return S.audit_manifest(declared, files.drop("doc_id")).groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


@query(f"WITH {_FILES} SELECT 'doc' AS prefix, 'txt' AS extension, count(*) AS files, count(sha256) AS hashed, CAST(sum(bytes) AS BIGINT) AS bytes, list_sort(list(DISTINCT string_split(path, '/')[3]))[1] AS first FROM files GROUP BY 1, 2")
def file_inventory(spark, sf_dir):
    """Files by prefix and extension: how many, how many hashed, their bytes and the first name."""
    return S.inventory(_documents(spark, sf_dir).drop("doc_id"), 2).select("prefix", "extension", "files", "hashed", "bytes", F.get("samples", F.lit(0)).alias("first"))


@query(f"WITH {COUNTED} SELECT region, " + ", ".join(f"CAST(sum(n) FILTER (WHERE category = '{k}') AS BIGINT) AS \"{k}\"" for k, _, _ in KINDS) + " FROM counted GROUP BY 1")
def wide_csv(spark, sf_dir):
    """A column per category, written and read again."""
    path, names = new_path(spark, "wide"), sorted(k for k, _, _ in KINDS)
    S.write_wide(counted(spark, sf_dir), path, "region", "category", "n", names)
    return spark.read.csv(path, sep=";", header=True, schema="region string, " + ", ".join(f"{k} long" for k in names))


@query("SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, count(source) AS sources FROM documents GROUP BY 1")
def backup_round_trip(spark, sf_dir):
    """Every row whole as JSON lines, nulls included, and read again."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "backup")
    S.write_backup(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    return back.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("chars"), F.count("source").alias("sources"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, upper(n_name) AS name, CAST(n_regionkey AS VARCHAR) AS parent FROM nation")
def reference_mapping(spark, sf_dir):
    """A reference table from a file, one row per key and no blank field, or an error."""
    path = new_path(spark, "mapping")
    S.write_csv(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.upper("n_name").alias("name"), F.col("n_regionkey").alias("parent")), path)
    return S.validated_mapping(spark.read.csv(path, sep=";", header=True, schema="code string, name string, parent string"), "code", ["name", "parent"])


@query(f"WITH {COUNTED}, t AS (SELECT region, CAST(sum(n) AS BIGINT) AS n, count(*) AS rows FROM counted GROUP BY 1) SELECT region, n, rows, CAST(sum(n) OVER () AS BIGINT) AS national FROM t")
def official_totals(spark, sf_dir):
    """Totals by region from a file whose national sum and number of rows are asserted."""
    rows = counted(spark, sf_dir)
    path = new_path(spark, "totals")
    S.write_csv(rows.groupBy("region").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), path)
    nation = rows.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first().asDict()  # one row of control totals
    got = S.control_totals(spark.read.csv(path, sep=";", header=True, schema="region string, n long, rows long"), nation)
    return got.select("region", "n", "rows", F.lit(nation["n"]).alias("national"))


@query("WITH k AS (SELECT lower(strip_accents(unnest(string_split(coalesce(text, ''), ' ')))) AS word FROM documents) SELECT word, count(*) AS times FROM k WHERE regexp_full_match(word, '[a-z]{4,12}') GROUP BY 1")
def accent_free_words(spark, sf_dir):
    """Words that are equal but for accents and case count together."""
    words = table(spark, sf_dir, "documents", "text").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))
    return words.select(scalars.plain_key(F.col("word")).alias("word")).where("word rlike '^[a-z]{4,12}$'").groupBy("word").agg(F.count("*").alias("times"))


_CODES = ["AC", "BA", "CE", "DF", "ES", "GO", "MA", "PA", "RJ", "SP"]


@query(
    f"""WITH k AS (SELECT o_orderkey AS id, o_orderkey % 6 AS form, [{", ".join(f"'{c}'" for c in _CODES)}][CAST(o_custkey % 10 AS INT) + 1] AS code FROM orders)
    SELECT form, code, count(*) AS files, count(*) FILTER (WHERE form < 4) AS placed, count(*) FILTER (WHERE form = 3) AS units, CAST(coalesce(sum(id % 9000 + 1) FILTER (WHERE form = 3), 0) AS BIGINT) AS unit_sum FROM k GROUP BY ALL"""
)
def file_names(spark, sf_dir):
    """F1 F2: region and unit from resource and file names, by a cascade of patterns; other names give neither."""
    k = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 6).alias("form"), F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("o_custkey") % 10 + 1).cast("int")).alias("code"))
    unit = (F.col("id") % 9000 + 1).cast("string")
    name = F.when(F.col("form") == 0, F.concat("code", F.lit(" - counts"))).otherwise("counts")
    file = F.when(F.col("form") == 1, F.concat(F.lit("https://x/y/bweb_1t_"), "code", F.lit("_041020261.zip"))).when(F.col("form") == 2, F.concat(F.lit("https://x/y/counts_2026_"), "code", F.lit(".csv")))
    file = file.when(F.col("form") == 3, F.concat(F.lit("p000407-"), F.lower("code"), F.lit("-m01007-z0009-s"), F.lpad(unit, 4, "0"), F.lit(".dat"))).when(F.col("form") == 4, F.lit("https://x/y/readme_2026.pdf")).otherwise(F.lit("counts_ZZZ"))
    k = k.withColumns({"name": name, "file": file})
    ids = scalars.unit_of_file(F.col("file"), _CODES)
    region = F.coalesce(scalars.region_of_resource(F.col("name"), F.col("file"), _CODES), ids["region"])
    k = k.select("form", "code", region.alias("region"), ids["unit"].alias("unit"))
    right = F.col("region").eqNullSafe(F.col("code"))
    return k.groupBy("form", "code").agg(F.count("*").alias("files"), F.count_if(right).alias("placed"), F.count("unit").alias("units"), F.coalesce(F.sum(F.col("unit").cast("long")), F.lit(0)).alias("unit_sum"))


@query(f"WITH {COUNTED}, t AS (SELECT region, sum(n) FILTER (WHERE category = 'RF') AS a, sum(n) FILTER (WHERE category = 'NO') AS b, sum(n) AS n FROM counted GROUP BY 1) SELECT region, round(100.0::DOUBLE * (a - b)::DOUBLE / n::DOUBLE, 6) AS margin FROM t")
def margins(spark, sf_dir):
    """difference of two categories' shares in percentage points."""
    of = lambda c: F.sum(F.when(F.col("category") == c, F.col("n")))
    t = counted(spark, sf_dir).groupBy("region").agg(of("RF").alias("a"), of("NO").alias("b"), F.sum("n").alias("n"))
    return t.select("region", F.round(scalars.margin_pp(F.col("a"), F.col("b"), F.col("n")), 6).alias("margin"))


@query(
    """WITH e AS (SELECT user_id, event_id, 'feed' AS source FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, event_id, 'backfill' FROM events WHERE event_id % 2 = 0),
    f AS (SELECT event_id, min(source) AS source FROM e GROUP BY 1) SELECT source, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM f GROUP BY 1"""
)
def backfilled_feed(spark, sf_dir):
    """A live feed and a backfill with their sources in one store, each event once, the backfill's row before the live one."""
    events = table(spark, sf_dir, "events", "event_id", "user_id")
    live = events.where("event_id % 3 <> 0").withColumn("source", F.lit("feed"))
    back = events.where("event_id % 2 = 0").withColumn("source", F.lit("backfill"))
    source, run = new_path(spark, "feed"), new_path(spark, "store")
    live.write.mode("append").parquet(source)
    schema = live.schema
    for part in (None, back):
        if part is not None:
            part.write.mode("append").parquet(source)
        T.upsert_latest(spark.readStream.schema(schema).parquet(source), f"{run}/table", f"{run}/checkpoint", ["event_id"], "source")
    return T.latest(spark, f"{run}/table", ["event_id"], "source").groupBy("source").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


@query("SELECT count(*) AS rows, true AS seen FROM events")
def stream_heartbeat(spark, sf_dir):
    """Rows that a stream's own progress reports when it has read all there is."""
    target, check = new_path(spark, "beat"), new_path(spark, "beat-checkpoint")
    stream = T.file_feed(spark, f"{sf_dir}/events.parquet").select("event_id").writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start()
    stream.awaitTermination()
    beats = [(p.batchId, p.numInputRows) for p in stream.recentProgress]
    return spark.createDataFrame([(sum(n for _, n in beats), len(beats) > 0)], "rows long, seen boolean")


@query(f"WITH {COUNTED} SELECT region, count(DISTINCT unit) AS units, CAST(sum(n) AS BIGINT) AS n, 'RAN,RAN' AS first_run, 'REUSED,REUSED' AS second_run, 0 AS gaps FROM counted GROUP BY 1")
def phase_replay(spark, sf_dir):
    """Phases run once for given inputs and are found again by their fingerprint."""
    facts = counted(spark, sf_dir).select("region", "unit", "n")
    by_unit = V.Phase("by_unit", ("facts",), lambda _, t: t["facts"].groupBy("region", "unit").agg(F.sum("n").alias("n")))
    by_region = V.Phase("by_region", ("by_unit",), lambda _, t: t["by_unit"].groupBy("region").agg(F.count("*").alias("units"), F.sum("n").alias("n")))
    registry, folder = V.Registry([by_region, by_unit]), new_path(spark, "phases")
    runs = [registry.replay(spark, {"facts": facts}, folder) for _ in range(2)]
    said = [",".join(s for _, _, s in run) for run in runs]
    out = spark.read.parquet(f"{folder}/by_region/{runs[1][-1][1][:16]}")
    return out.withColumns({"first_run": F.lit(said[0]), "second_run": F.lit(said[1]), "gaps": F.lit(len(registry.missing_sources(["facts"])))})


@query("SELECT 4 AS files, 0 AS differing, true AS all_hashed")
def sealed_output(spark, sf_dir):
    """The data files of an output, sealed by their hashes and verified again."""
    path = new_path(spark, "sealed")
    table(spark, sf_dir, "orders", "o_orderkey").repartition(4, "o_orderkey").write.parquet(path)
    sealed = V.seal(spark, path)
    differing = V.verify(spark, path, sealed).agg(F.count("*").cast("int").alias("differing"))
    return sealed.agg(F.count("*").cast("int").alias("files"), F.bool_and(F.length("sha256") == 64).alias("all_hashed")).crossJoin(differing).select("files", "differing", "all_hashed")
