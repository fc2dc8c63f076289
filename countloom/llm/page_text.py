"""Main text of web pages: subtrees that recur across many pages of a host are its template and go.

Every page is parsed once, into blocks of text with the hashes of the block-level subtrees that they stand in. Spark counts for each
host how many different articles a subtree is seen with, tells every page which of its subtrees are template, and what is left without
them, without elements that are no content by their tag, role or class, and outside of any article if the page has one, is the text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stage

# Tags of HTML and names that sites use.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title iframe noscript noembed noframes template select button svg math canvas object audio video"
DROPPED = frozenset("aside dialog footer form menu nav search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion nav navbar navigation menu sidebar footer cookie cookies consent notice newsletter subscribe comment comments respond replies share sharing social breadcrumb breadcrumbs related popup modal".split())
#: Elements that are nested deeper than this belong to the one at this depth, as in browsers.
DEPTH = 512
#: What an open element of the first kind is closed by, up to the nearest element of the second kind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Text of these is never taken for template inside an article: articles quote and repeat each other.
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th tr tbody thead".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<({'|'.join(RAW.split())})(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]{0,65536}+\"|'[^']{0,65536}+'|[\"'])*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-z!?/][^>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")


@dataclass
class Element:
    tag: str
    parent: int
    dropped: bool
    digest: xxhash.xxh3_64 = field(default_factory=xxhash.xxh3_64)
    main: bool = False  # holds an article or main, or is in one
    hash: int = 0


@dataclass
class Block:
    parts: list[str]
    at: int


def _dropped(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    return tag not in {"html", "body", "main", "article"} and any(w in NAMES for w in re.split(r"[^a-z0-9]+", (found.get("class", "") + " " + found.get("id", "")).lower()))


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Block-level elements, parents first, with hashes of their subtrees, and the blocks of text in page order."""
    elements = [Element("", -1, False)]
    open_ = [0]
    blocks: list[Block] = []
    inside = 0  # articles that are open
    last = 0

    def close() -> None:
        nonlocal inside
        k = open_.pop()
        e = elements[k]
        e.hash = e.digest.intdigest() - (1 << 63)
        elements[e.parent].digest.update(e.digest.digest())
        inside -= e.tag in ("article", "main")

    def text(piece: str) -> None:
        if not piece:
            return
        at = open_[-1]
        elements[at].digest.update(b"\0" + " ".join(piece.split()).encode("utf-8", "surrogatepass"))
        if blocks and blocks[-1].at == at and ended[0] == at:
            blocks[-1].parts.append(piece)
        else:
            blocks.append(Block([piece], at))
            ended[0] = at

    ended = [-1]  # the element whose block goes on
    deeper = 0  # open elements beyond the depth
    for m in TOKEN.finditer(page):
        text(page[last : m.start()])
        last = m.end()
        tag = (m[3] or "").lower()
        if tag == "br":
            text(" ")
        if tag not in BLOCKS:
            continue
        ended[0] = -1
        if m[2] and deeper:
            deeper -= 1
            continue
        if m[2]:
            if any(elements[k].tag == tag for k in open_):
                while elements[open_[-1]].tag != tag:
                    close()
                close()
            continue
        if elements[open_[-1]].tag == "p":
            close()
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            for depth in range(len(open_) - 1, 0, -1):
                here = elements[open_[depth]].tag
                if here in stop:
                    break
                if here in closed:
                    while len(open_) > depth:
                        close()
        if tag in VOID:
            continue
        if len(open_) > DEPTH:
            deeper += 1
            continue
        e = Element(tag, open_[-1], _dropped(tag, m[4], inside > 0), main=inside > 0)
        e.digest.update(f"<{tag}>".encode())
        if tag in ("article", "main"):
            inside += 1
            up = open_[-1]
            while up >= 0 and not elements[up].main:
                elements[up].main = True
                up = elements[up].parent
            e.main = True
        elements.append(e)
        open_.append(len(elements) - 1)
    text(page[last:])
    while len(open_) > 1:
        close()
    return elements, blocks


def digest(page: str) -> tuple[int, list[int], list[tuple[str, list[int]]]]:
    """(hash of the article, hashes of the subtrees that could be template, (text, hashes of such subtrees around it) of each block that is content).

    The article is the outermost article or main elements, or else the whole page. Subtrees that hold or are an article, and prose in
    one, are no candidates.
    """
    elements, blocks = parse(page)
    tops = [k for k, e in enumerate(elements) if e.tag in ("article", "main") and not _within(elements, e.parent, ("article", "main"))]
    article = xxhash.xxh3_64()
    for k in tops:
        article.update(elements[k].hash.to_bytes(8, "little", signed=True))
    if not tops:
        for b in blocks:
            if not _lost(elements, b.at):
                article.update(" ".join("".join(b.parts).split()).encode("utf-8", "surrogatepass"))
    around: list[list[int]] = []
    lost: list[bool] = []
    taken: list[bool] = []
    for e in elements:
        up = e.parent
        inside = up >= 0 and taken[up]
        candidate = up >= 0 and e.tag not in ("html", "body", "article", "main") and (e.tag not in PROSE if inside or not tops else not e.main)
        holds = e.main and not inside and e.tag not in ("article", "main")
        around.append(([] if up < 0 else around[up]) + ([e.hash] if candidate and not holds else []))
        lost.append(up >= 0 and lost[up] or e.dropped and not holds)
        taken.append(inside or e.tag in ("article", "main"))
    every = sorted({h for hashes in around for h in hashes})
    told = []
    for b in blocks:
        if lost[b.at] or tops and not taken[b.at]:
            continue
        words = " ".join(html.unescape("".join(b.parts)).split())
        if words:
            told.append((words, around[b.at]))
    return article.intdigest() - (1 << 63), every, told


def _within(elements: list[Element], k: int, tags: tuple[str, ...]) -> bool:
    while k >= 0:
        if elements[k].tag in tags:
            return True
        k = elements[k].parent
    return False


def _lost(elements: list[Element], k: int) -> bool:
    while k >= 0:
        if elements[k].dropped:
            return True
        k = elements[k].parent
    return False


def host(url: str | Column = "url") -> Column:
    """The lower-cased host of an URL; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def templates(parsed: DataFrame, least: int = 3, share: float = 0.05) -> DataFrame:
    """(host, hash): subtrees that stand on pages of a host with ``least`` different articles or more, and with ``share`` of its articles or more.

    Pages that copy one article count once, so copies are no template. The counts are partial sums by (host, hash, article), so a
    host with very many pages is no hot group. Pages without a host have no template.
    """
    seen = parsed.where("host is not null").select("host", "article", F.explode("every").alias("hash")).distinct()
    n = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = parsed.where("host is not null").select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("total"))
    return n.join(total, "host").where(F.col("n") >= share * F.col("total")).select("host", "hash")


def main_text(pages: DataFrame, least: int = 3, share: float = 0.05, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, blocks joined by an empty line.

    A null or empty page, or one without content, has an empty text. Repeated rows each come back; rows may lack id or URL (their subtrees are counted by
    host only where there is one). Markup may be unclosed, cut off or nested wrongly; character references without a semicolon
    are read as browsers do; an attribute of over 65,536 characters ends at the next ``>``. Further columns are ignored; an empty
    table gives no rows.
    """
    lean(pages.sparkSession)
    schema = "row long, page_id {}, url string, host string, article long, every array<long>, blocks array<struct<text string, around array<long>>>"
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches):
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for b in batches:
            got = [digest(x.as_py() or "") for x in b.column(3)]
            rows = pa.array(range(row, row + len(got)), pa.int64())
            row += len(got)
            blocks = pa.array([[{"text": t.encode("utf-8", "replace").decode(), "around": a} for t, a in x[2]] for x in got], pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))])))
            columns = [rows, b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.list_(pa.int64())), blocks]
            yield pa.record_batch(columns, ["row", "page_id", "url", "host", "article", "every", "blocks"])

    parsed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(url).alias("host"), F.col(page).alias("html")).mapInArrow(run, schema.format(kind))
    parsed = stage(parsed, "pages")
    used = F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["around"])))
    around = parsed.where("host is not null").select("row", "host", F.explode(used).alias("hash"))
    dead = around.join(templates(parsed, least, share), ["host", "hash"]).groupBy("row").agg(F.collect_list("hash").alias("dead"))
    kept = F.filter("blocks", lambda b: F.col("dead").isNull() | ~F.arrays_overlap(b["around"], F.col("dead")))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n").alias("text")
    # only pages with content in such a subtree have to be told; the others' texts aren't moved
    told = F.col("host").isNotNull() & (F.size(used) > 0)
    columns = parsed.select("row", "page_id", "url", "host", "blocks")
    out = columns.where(told).join(dead, "row", "left").select("page_id", "url", text)
    out = out.unionByName(columns.where(~told).withColumn("dead", F.lit(None).cast("array<long>")).select("page_id", "url", text))
    return out.withColumn("n_chars", F.length("text").cast("long"))
