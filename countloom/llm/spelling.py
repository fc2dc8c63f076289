"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the forms they go back to.

Two words at distance one share their first half or their last half. So every word is dealt by both halves, and what shares
one meets in a shard. A shard builds a minimal acyclic automaton of its words, read forward for first halves and backward
for last ones; each path through it gives a word's number (a minimal perfect hash), and a search follows one half exactly and
completes the other with one error. A half that very many words share is cut into blocks of words, and the words to look up go
to each block of it; nothing is capped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stage

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in lower-cased UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Bytes of a text that are looked at together, and distinct words that a task holds before it sends them.
PIECE = 1 << 20
HELD = 1 << 18
#: Words of a block, and words that a shard should have.
BLOCK = 20_000
SHARD = 2_000


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that cut no run."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and (text[end - 1 : end].isalpha() or text[end - 1] >= 0x80) and (text[end : end + 1].isalpha() or text[end] >= 0x80):
            end += 1
        yield text[at:end]
        at = end


def code_points(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def slipped(every: int = 199) -> Callable[[bytes, bytes], bytes]:
    """A change of words that stands for misspellings: of a word whose CRC-32 with its document's id ``every`` divides, one code point goes."""

    def change(doc_id: bytes, word: bytes) -> bytes:
        h = zlib.crc32(word, zlib.crc32(doc_id + b":"))
        if h % every:
            return word
        plain = word.decode()
        at = h % len(plain)
        return (plain[:at] + plain[at + 1 :]).encode()

    return change


def count_words(docs: DataFrame, length: int = 6, least: int = 5, change: Callable[[bytes, bytes], bytes] | None = None) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all whole texts with ``length`` or more code points that occur ``least`` times or more.

    ``change`` maps (doc_id, word) to the word to be counted. Tasks send a word and its number once for each
    ``HELD`` distinct ones; Spark adds them up. Only A-Z are lower-cased. A null text has no words, a null doc_id reads as an
    empty one, repeated rows count each time, further columns are ignored, and an empty table gives no rows.
    """
    lean(docs.sparkSession)

    def run(batches):
        held: Counter[bytes] = Counter()

        def flush():
            yield pa.record_batch({"word": pa.array(list(held), pa.binary()).cast(pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                for part in pieces(text.as_py() or b""):
                    for word, n in Counter(RUN.findall(part.lower())).items():
                        if change is not None:
                            word = change((doc_id or "").encode(), word)
                        if code_points(word) >= length:
                            held[word] += n
                    if len(held) >= HELD:
                        yield from flush()
        if held:
            yield from flush()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words. ``edges[state]`` maps a code point to (state, words that come before)."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._count: list[int] = []
        known: dict[tuple, int] = {}

        def state(final: bool, children: list[tuple[str, int]]) -> int:
            key = (final, *children)
            if key not in known:
                known[key] = len(self.edges)
                out, before = {}, int(final)
                for c, to in children:
                    out[c] = to, before
                    before += self._count[to]
                self.edges.append(out)
                self.final.append(final)
                self._count.append(before)
            return known[key]

        open_, last = [(False, [])], ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                done = state(*open_.pop())
                open_[-1][1].append((last[len(open_) - 1], done))

        for w in words:
            shared = len(commonprefix((last, w)))
            close(shared)
            open_ += [(False, []) for _ in range(len(w) - shared)]
            open_[-1] = True, open_[-1][1]
            last = w
        close(0)
        self.root = state(*open_.pop())

    def number(self, word: str, state: int | None = None, before: int = 0, at: int = 0) -> int | None:
        """The word's place among the sorted words, None if it isn't one; from another state: of what is left of it from ``at`` on."""
        state = self.root if state is None else state
        for k in range(at, len(word)):
            to = self.edges[state].get(word[k])
            if to is None:
                return None
            state = to[0]
            before += to[1]
        return before if self.final[state] else None

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that have ``word``'s first ``exact`` code points and one later code point replaced or inserted."""
        edges, found = self.edges, set()
        state, before = self.root, 0
        for k in range(len(word) + 1):
            if k >= exact:
                for c, (to, skipped) in edges[state].items():
                    if k < len(word) and c != word[k]:
                        found.add(self.number(word, to, before + skipped, k + 1))
                    found.add(self.number(word, to, before + skipped, k))
            if k < len(word):
                step = edges[state].get(word[k])
                if step is None:
                    break
                state, before = step[0], before + step[1]
        found.discard(None)
        return found


def _halves(words: DataFrame) -> DataFrame:
    """(key, backward, query, word, n): each word under the half that words of its length go by, to be looked up and found, and under the half of words shorter by one, to be found."""
    size = F.length("word")
    out = []
    for backward in (False, True):
        for base, query in ((size, True), (size - 1, False)):
            first = F.floor(base / 2).cast("int")
            half = F.substring("word", size - (base - first) + 1, base - first) if backward else F.substring("word", F.lit(1), first)
            out.append(F.struct(F.xxhash64(F.lit(backward), base, half).alias("key"), F.lit(backward).alias("backward"), F.lit(query).alias("query")))
    return words.select(F.explode(F.array(*out)).alias("h"), "word", "n").select("h.*", "word", "n")


def _search(table: pa.Table) -> pa.Table:
    """(word, near, near_n) for the pairs at distance one of a shard, in both directions."""
    got: list[tuple[str, str, int]] = []
    rows = list(zip(*(table[c].to_pylist() for c in ("backward", "query", "found", "word", "n", "key", "block"))))
    for backward in (False, True):
        turn = slice(None, None, -1) if backward else slice(None)
        own = {w[turn]: n for back, _, found, w, n, *_ in rows if back == backward and found}
        under = {(w, *place) for back, _, found, w, _, *place in rows if back == backward and found}
        words = sorted(own)
        automaton = Automaton(words)
        for w, n, *place in {(w, n, *place) for back, query, _, w, n, *place in rows if back == backward and query}:
            first = len(w) // 2
            for k in automaton.one_error(w[turn], len(w) - first if backward else first):
                near, near_n = words[k][turn], own[words[k]]
                if backward and near[:first] == w[:first] or (near, *place) not in under:
                    continue  # found forward, or in another block
                got.append((w, near, near_n))
                if len(near) > len(w):
                    got.append((near, w, n))
    word, near, near_n = zip(*got) if got else ((), (), ())
    return pa.table({"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())})


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of distinct ``words`` (word, n) that differ by one code point, each once.

    Halves that more than ``BLOCK`` words share are cut into blocks by a hash of the word. A shorter word looks for those
    of its own length and longer by one, so that each pair is found from one or two sides but told once in each direction.
    """
    rows = _halves(words)
    large = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    rows = rows.join(large, "key", "left").withColumns({"own": own, "last": blocks - 1})
    rows = rows.withColumn("block", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("last"))).otherwise(F.array("own"))))
    shards = max(512, 4 * words.count() // SHARD)
    shard = F.pmod(F.xxhash64("key", "block"), F.lit(shards)).alias("shard")
    rows = rows.select(shard, "backward", "query", (F.col("block") == F.col("own")).alias("found"), "word", "n", "key", "block")
    return rows.groupBy("shard").applyInArrow(_search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms (word, form), which hold no circle, end. Each round doubles the steps, so a chain of c takes log2(c) rounds."""
    hops = stage(forms.select("word", F.col("form").alias("root")), "hops")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = stage(hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "hops")
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.drop("moved")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct ``words`` (word, n).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if its n is ``ratio`` times the word's or more,
    else null. ``root`` follows the forms to the last and is the word itself where there is none. ``ratio`` is 2 or more, so
    that chains rise and end. Null words are ignored; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    lean(words.sparkSession)
    words = stage(words.where("word is not null").select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    takes = -F.col("best.n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n"))
    told = stage(told, "near-words")
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
