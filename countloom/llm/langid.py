"""Language identification by interpolated Kneser-Ney character models.

Every language has a character 4-gram model with Kneser-Ney smoothing. Counts, continuation counts, discounts and
probabilities are Spark aggregations and joins over all training rows and all n-grams; the model is a table of (key, language,
value), keys being hashes of n-grams and contexts, and it grows with the input. A task scores texts with sorted arrays of
the rows that its own n-grams need: cut from the whole table where that is small enough to be broadcast, and joined to
the n-grams of each chunk of documents where it isn't. Both ways give the same results.

A text gets the language with the lowest cross-entropy per character. It is rejected when even that one lies above what the
language's own training texts show for texts of its length.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, n_groups, stage

ORDER = 4
#: The discount of a level that has no n-gram seen once or none seen twice, from which it is estimated.
DISCOUNT = 0.75
#: A model of up to so many rows of 16 bytes is broadcast.
BROADCAST_ROWS = 1 << 22
PIECE = 1 << 18
#: Log-probabilities that a task remembers.
MEMO = 1 << 21
#: Up to so many possible n-grams are counted in an array with a place for each.
DIRECT = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; each run of other characters becomes one space, at both ends too."""
    s = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[s]
    if not letter.any():
        return s[:0]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, s, np.uint32(32))[keep]


def _compact(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct code points, sorted, and the place of each symbol among them."""
    seen = np.zeros(0x110000, bool)
    seen[s] = True
    values = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int32)
    place[values] = np.arange(len(values))
    return values.astype(np.uint32), place[s]


def _codes(s: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct code points, a number for each n-gram that fits in ``s``, and a bound of these numbers."""
    values, ids = _compact(s)
    code = np.zeros(max(0, len(s) - order + 1), np.int64)
    for k in range(order):
        code = code * len(values) + ids[k : len(s) - order + 1 + k]
    return values, code, len(values) ** order


def _texts(b: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in b.column(column).to_pylist()]


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram string, n) over all ``rows`` (lang, text); the grams of a batch are summed before the shuffle."""

    def run(batches):
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), _texts(b, 1)):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                joined: list[np.ndarray] = []
                size = 0
                for t in [*texts, None]:
                    if t is None or size > PIECE * 4:
                        if joined:
                            yield from _counted(lang, joined, order)
                        joined, size = [], 0
                    if t is not None:
                        s = symbols(t)
                        if len(s) >= order - 1:
                            # order - 2 more spaces in front: the first character has a whole context
                            joined.append(np.concatenate((np.full(order - 2, 32, np.uint32), s)))
                            size += len(s)

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counted(lang: str, parts: list[np.ndarray], order: int):
    s = np.concatenate(parts)
    inside = np.ones(len(s), bool)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    for k in range(order - 1):
        inside[starts + k] = False
    values, code, bound = _codes(s, order)
    code = code[inside[order - 1 :]]
    if bound <= DIRECT:
        n = np.bincount(code, minlength=1)
        code = np.flatnonzero(n)
        n = n[code]
    else:
        code, n = np.unique(code, return_counts=True)
    cols = []
    for _ in range(order):
        cols.append(values[code % len(values)])
        code = code // len(values)
    flat = np.stack(cols[::-1], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    yield pa.record_batch({"lang": pa.array([lang] * len(n)), "gram": pa.array([flat[i : i + order] for i in range(0, len(flat), order)]), "n": pa.array(n.astype(np.int64))})


def _keys(s: np.ndarray, ends: np.ndarray, order: int, context: bool) -> np.ndarray:
    """Keys of the ``order`` symbols up to each of ``ends``, or of their context, all but the last."""
    h = np.zeros(len(ends), np.uint64)
    for j in range(order - context):
        h = h * _STEP + s[ends - order + 1 + j].astype(np.uint64) + np.uint64(1)
    return mix64(h + np.full(1, 2 * order + context, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def model_table(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(level, context boolean, gram, lang, value) of the Kneser-Ney models of all languages from ``counts`` (lang, gram, n).

    The longest order uses counts, the shorter ones the number of distinct left neighbours. A level's discount is
    n1 / (n1 + 2 n2) of its language. The bottom is uniform over the symbols seen in any language and one more. The value of an
    n-gram is its log-probability, that of a context the log weight that it leaves to the next shorter order.
    """
    levels = [counts.select("lang", "gram", F.col("n").cast("double").alias("n"))]
    for _ in range(order - 1):
        levels.append(stage(levels[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").cast("double").alias("n")), "continuations"))
    floor = np.exp(_floor(counts, order))
    lower, out = None, None
    for k, level in enumerate(levels[::-1], 1):
        level = level.withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        n1, n2 = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = level.groupBy("lang").agg(F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(DISCOUNT).alias("d"))
        total = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        total = stage(total.join(discount, "lang"), "contexts")
        seen = level.join(total, ["lang", "context"])
        below = F.lit(float(floor))
        if lower is not None:
            seen = seen.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
            below = F.col("below")
        p = (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) + F.col("d") * F.col("kinds") * below) / F.col("total")
        lower = stage(seen.select("lang", "gram", p.alias("p")), "level")
        rows = lower.select(F.lit(k).alias("level"), F.lit(False).alias("context"), "gram", "lang", F.log("p").alias("value"))
        rows = rows.unionAll(total.select(F.lit(k), F.lit(True), "context", "lang", F.log(F.col("d") * F.col("kinds") / F.col("total"))))
        out = rows if out is None else out.unionAll(rows)
    return out


def _floor(counts: DataFrame, order: int) -> float:
    return -float(np.log(counts.select(F.expr(f"substring(gram, {order})")).distinct().count() + 1))


class Grams:
    """Rows of a model as sorted arrays: the values of a key, by language; and what was worked out from them lately."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, value: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.lang, self.value = lang[order], value[order]
        self.memo: tuple[np.ndarray, np.ndarray] | None = None

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``key``, language, value) of all that is known of the keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        lo = self.first[at[hit]]
        n = self.first[at[hit] + 1] - lo
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(hit, n), self.lang[entry], self.value[entry]


@dataclass
class Model:
    """``table`` (key long, lang int, value float) is staged; ``grams`` is it as arrays, where that is small enough."""

    langs: list[str]
    floor: float = 0.0
    order: int = ORDER
    limit: tuple[np.ndarray, float] | None = None
    grams: Grams | None = None
    table: DataFrame | None = field(default=None, repr=False)

    def sent(self) -> Model:
        """What tasks need of it, without the table."""
        return Model(self.langs, self.floor, self.order, self.limit, self.grams)


def log_probs(s: np.ndarray, model: Model) -> np.ndarray:
    """Log-probability of each symbol that has a whole context in ``s``, a column per language."""
    order, grams = model.order, model.grams
    ends, back_to = _distinct(s, order)
    key = _keys(s, ends, order, False)
    by = np.argsort(key)
    key, ends = key[by], ends[by]
    out = np.empty((len(ends), len(model.langs)), np.float32)
    known, rows = grams.memo or (np.zeros(0, np.uint64), out[:0])
    at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
    hit = known[at] == key if len(known) else np.zeros(len(key), bool)
    out[hit] = rows[at[hit]]
    new = np.flatnonzero(~hit)
    if len(new):
        out[new] = _resolved(s, ends[new], model)
        if len(known) + len(new) > max(1, MEMO // len(model.langs)):
            grams.memo = key, out.copy()
        else:
            place = np.searchsorted(known, key[new])
            grams.memo = np.insert(known, place, key[new]), np.insert(rows, place, out[new], axis=0)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return out[place[back_to]]


def _resolved(s: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    out = np.full((len(ends), len(model.langs)), model.floor, np.float32)
    for k in range(1, model.order + 1):
        # what the context leaves, times the shorter order's probability, but for what was seen itself
        row, lang, value = model.grams.find(_keys(s, ends, k, True))
        out[row, lang] += value
        row, lang, value = model.grams.find(_keys(s, ends, k, False))
        out[row, lang] = value
    return out


def _distinct(s: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """An end place of each distinct n-gram of ``s``, and which of these each place with a whole context has."""
    _, code, bound = _codes(s, order)
    if bound > DIRECT:
        bits = len(code).bit_length()
        if bound.bit_length() + bits > 63:
            _, first, back_to = np.unique(code, return_index=True, return_inverse=True)
            return first + order - 1, back_to
        both = (code << bits) | np.arange(len(code))  # values sort several times faster than places by value
        both.sort()
        place = both & ((1 << bits) - 1)
        both >>= bits
        new = np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))
        back_to = np.empty(len(code), np.int64)
        back_to[place] = np.cumsum(new) - 1
        return place[new] + order - 1, back_to
    last = np.full(bound, -1, np.int64)
    last[code] = np.arange(order - 1, len(s))
    distinct = np.flatnonzero(last >= 0)
    ends = last[distinct]
    last[distinct] = np.arange(len(distinct))
    return ends, last[code]


def entropies(texts: list[str], model: Model) -> np.ndarray:
    """Nats per symbol by language for each text; nan where a text has no letter."""
    return measured(texts, model)[0]


def measured(texts: list[str], model: Model, spread: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`entropies`, the symbols of each text, and with ``spread`` the sums of their squared nats. Long texts go piece by piece."""
    context = model.order - 1
    most = max(1 << 12, min(PIECE, (1 << 22) // len(model.langs)))
    front = np.full(context - 1, 32, np.uint32)
    out = np.full((len(texts), len(model.langs)), np.nan)
    sums, squares, n = np.zeros_like(out), np.zeros_like(out), np.zeros(len(texts))
    pend: list[tuple[int, np.ndarray]] = []

    def flush():
        if not pend:
            return
        lengths = np.array([len(p) for _, p in pend])
        lp = log_probs(np.concatenate([p for _, p in pend]), model)
        starts = np.cumsum(lengths) - lengths
        cuts = np.stack((starts, starts + lengths - context), axis=1).ravel()[:-1]
        total = np.add.reduceat(lp, cuts, axis=0, dtype=np.float64)[::2]
        if spread:
            for (i, _), row in zip(pend, np.add.reduceat(lp * lp, cuts, axis=0, dtype=np.float64)[::2]):
                squares[i] += row
        for (i, p), row in zip(pend, total):
            sums[i] += row
            n[i] += len(p) - context
        pend.clear()

    size = 0
    for i, t in enumerate(texts):
        s = symbols(t)
        if not len(s):
            continue
        s = np.concatenate((front, s))
        for a in range(context, len(s), most):
            pend.append((i, s[a - context : a + most]))
            size += len(pend[-1][1])
            if size > most:
                flush()
                size = 0
    flush()
    some = n > 0
    out[some] = -sums[some] / n[some, None]
    return out, n, squares


def _keyed(table: DataFrame, langs: list[str]) -> DataFrame:
    """(key, lang int, value float) of a :func:`model_table`."""
    place = {x: k for k, x in enumerate(langs)}

    def run(batches):
        for b in batches:
            level, context = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            grams = b.column(2).to_pylist()
            key = np.zeros(len(b), np.uint64)
            for k in np.unique(level).tolist():
                for c in (False, True):
                    own = np.flatnonzero((level == k) & (context == c))
                    if len(own):
                        flat = "".join([grams[i] + " " * c for i in own.tolist()])  # any symbol behind a context
                        s = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
                        key[own] = _keys(s, np.arange(k - 1, len(s), k), k, c)
            lang = np.array([place[x] for x in b.column(3).to_pylist()], np.int32)
            yield pa.record_batch({"key": pa.array(key.view(np.int64)), "lang": pa.array(lang), "value": pa.array(b.column(4).to_numpy().astype(np.float32))})

    return table.mapInArrow(run, "key long, lang int, value float")


def fit(counts: DataFrame, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS) -> Model:
    """The model of ``counts`` (lang, gram, n), which are read several times. The languages' names go through the driver."""
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([])
    model = Model(langs, _floor(counts, order), order, table=stage(_keyed(model_table(counts, order), langs), "language-models"))
    if model.table.count() <= broadcast_rows:
        got = model.table.toArrow()
        model.grams = Grams(got["key"].to_numpy().view(np.uint64), got["lang"].to_numpy(), got["value"].to_numpy())
    return model


def scored(docs: DataFrame, model: Model, apply: Callable[[pa.RecordBatch, Model], pa.RecordBatch], schema) -> DataFrame:
    """``apply`` over the batches of ``docs``, which have a column ``text``, each with a model that holds all n-grams of these texts.

    A model that is too large to be broadcast is joined to the distinct n-grams of chunks of documents; chunks follow
    from a hash of whole rows, and their rows travel packed, behind what the model knows of their n-grams.
    """
    spark = lean(docs.sparkSession)
    if model.grams is not None or not model.langs:
        shared = spark.sparkContext.broadcast(model.sent())

        def run(batches):
            for b in batches:
                yield apply(b, shared.value)

        return docs.mapInArrow(run, schema)
    bare, order = model.sent(), model.order
    by = [f"`{f.name}`" for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant", "struct", "array")]
    chunk = F.pmod(F.xxhash64(*by), F.lit(n_groups(docs, 4))).cast("int")
    rows = docs.select(chunk.alias("chunk"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def needed(batches):
        for b in batches:
            chunks = b.column(0).to_numpy()
            for k in np.unique(chunks).tolist():
                texts = b.filter(pa.array(chunks == k)).column(1).to_pylist()
                found = [key for s in pieces_of(texts, order, PIECE) for key in _needed(s, order)]
                if found:
                    key = np.unique(np.concatenate(found)).view(np.int64)
                    yield pa.record_batch({"chunk": pa.array(np.full(len(key), k, np.int32)), "key": pa.array(key)})

    def answers(batches):
        for b in batches:
            chunks = b.column(0).to_numpy()
            for k in np.unique(chunks).tolist():
                own = b.filter(pa.array(chunks == k))
                part = np.zeros(len(own), _ANSWER)
                part["key"], part["lang"], part["value"] = own.column(1).to_numpy().view(np.uint64), own.column(2).to_numpy(), own.column(3).to_numpy()
                yield pa.record_batch({"chunk": pa.array([k], pa.int32()), "kind": pa.array([0], pa.int32()), "payload": pa.array([part.tobytes()], pa.binary())})

    def bundles(batches):
        for b in batches:
            chunks = b.column(0).to_numpy()
            own = pa.RecordBatch.from_arrays(b.column(1).flatten(), names=[str(k) for k in range(len(names))])
            for k in np.unique(chunks).tolist():
                part = own.filter(pa.array(chunks == k))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.record_batch({"chunk": pa.array([k], pa.int32()), "kind": pa.array([1], pa.int32()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches):
        now, held, own = None, [], None
        for b in batches:
            for chunk, kind, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if chunk != now:
                    now, held, own = chunk, [], None
                if kind == 0:
                    held.append(payload)
                    continue
                if own is None:
                    part = np.frombuffer(b"".join(held), _ANSWER)
                    own, held = Model(bare.langs, bare.floor, bare.order, bare.limit, Grams(part["key"], part["lang"], part["value"])), []
                for batch in pa.ipc.open_stream(payload):
                    yield apply(pa.RecordBatch.from_arrays(batch.columns, names=names), own)

    names, packed = docs.columns, "chunk int, kind int, payload binary"
    asked = rows.select("chunk", "doc.text").mapInArrow(needed, "chunk int, key long").distinct()
    told = asked.join(model.table, "key").select("chunk", "key", "lang", "value").mapInArrow(answers, packed)
    both = told.unionAll(rows.mapInArrow(bundles, packed))
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)


_ANSWER = np.dtype([("key", "<u8"), ("lang", "<i4"), ("value", "<f4")])


def _needed(s: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of all n-grams of a piece, of their suffixes and of the contexts of these."""
    ends, _ = _distinct(s, order)
    return [np.unique(_keys(s, ends, k, c)) for k in range(1, order + 1) for c in (False, True)]


def pieces_of(texts: list[str | None], order: int, most: int):
    """Arrays of symbols of up to about ``most``, each with a whole context in front."""
    front = np.full(order - 2, 32, np.uint32)
    for t in texts:
        s = symbols(t or "")
        if len(s):
            s = np.concatenate((front, s))
            for a in range(order - 1, len(s), most):
                yield s[a - order + 1 : a + most]


def train(rows: DataFrame, reject_sd: float = 8.0, broadcast_rows: int = BROADCAST_ROWS) -> Model:
    """A model from ``rows`` (lang, text), all of them counted; rows with a null lang or text are left out.

    Every language with a letter and every n-gram is learned, and the model grows with them.
    A text of n symbols is far from a language beyond the mean of that language's own texts by ``reject_sd``
    deviations. Their variance is that of the own texts' means, which lines of code or secrets in them widen, and
    that of a symbol by n, so a short text needs a larger distance.
    The limits come from all rows too; nothing is sampled. An empty table gives a model without languages.
    """
    lean(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null").select("lang", "text")
    model = fit(stage(count_grams(rows), "grams"), broadcast_rows=broadcast_rows)
    if not model.langs:
        return model
    place = {x: k for k, x in enumerate(model.langs)}

    def own(b, m):
        e, n, squares = measured(_texts(b, 1), m, spread=True)
        langs = b.column(0).to_pylist()
        at = np.array([place.get(a, 0) for a in langs], np.int64)  # a language that the model lacks has no letter, so no entropy
        v, q = e[np.arange(len(at)), at], squares[np.arange(len(at)), at]
        ok = ~np.isnan(v)
        return pa.record_batch({"lang": pa.array([a for a, k in zip(langs, ok) if k], pa.string()), "v": pa.array(v[ok]), "n": pa.array(n[ok]), "q": pa.array(q[ok])})

    symbol = F.sum("q") / F.sum("n") - F.pow(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 2)
    spread = scored(rows, model, own, "lang string, v double, n double, q double").groupBy("lang").agg(F.avg("v").alias("m"), F.var_pop("v").alias("t"), symbol.alias("s"))
    found = {r["lang"]: (r["m"], r["t"] or 0.0, max(r["s"], 0.0)) for r in spread.collect()}
    model.limit = (np.array([found[x] for x in model.langs]), reject_sd)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score in 0 to 1 and rejected.

    ``und`` with score 0 stands for a null text, one without letters, or a model without
    languages; those are rejected. Ties go to the first language by name. The score is the
    posterior of the chosen language from the mean log-likelihoods, scaled by up to 50
    characters. Repeated rows keep a row each; an empty table gives no rows. Very long texts are scored whole, piece by piece.
    """
    def apply(b, m):
        pred, score, reject = judge(_texts(b, 1), m)
        return pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(reject, pa.bool_())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scored(docs.select("doc_id", "text"), model, apply, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def judge(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    e, n, _ = measured(texts, model)
    none = np.isnan(e[:, 0])
    safe = np.where(np.isnan(e), 0.0, e)
    best = safe.argmin(axis=1)
    low = safe[np.arange(len(texts)), best]
    size = np.array([len(t) for t in texts], np.float64)
    length = np.minimum(50, size)
    score = 1 / np.exp(-(safe - low[:, None]) * length[:, None]).sum(axis=1)
    pred = ["und" if x else model.langs[k] for x, k in zip(none, best)]
    own, reject_sd = model.limit
    mean, between, symbol = own[best].T
    reject = none | (low > mean + reject_sd * np.sqrt(between + symbol / np.maximum(n, 1)))
    return pred, np.where(none, 0.0, score), reject


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that :func:`predict` does not reject, all columns as they are."""
    at = docs.columns.index("text")
    return scored(docs, model, lambda b, m: b.filter(pa.array(~judge(_texts(b, at), m)[2])), docs.schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
