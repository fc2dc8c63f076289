"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A sequence of pieces is the byte-pair encoding of its text exactly if each two neighbours are
the encoding of their own joint text. So encoding is a path search whose steps weigh -1 for a
piece and minus infinity for a pair that is not its own encoding. Exactly one path stays finite;
it is what the sentencepiece library returns for the same model.

A giant document is split into chunks that are rows of their own. A state at a cut is the piece
that reaches it and how far it reaches beyond. Each chunk yields its (max, +) transfer matrix
from entry states to exit states; the matrices of a document are combined associatively, which
fixes the state at every cut, and each chunk is traced back on its own. Documents of one
chunk go to the library, each distinct space-delimited fragment of a batch once: no piece of
the model has a space mark behind another character, so fragments encode independently.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import TOKENIZERS, lean, stage

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
GIANT = 1 << 16
CHUNK = 1 << 14
#: Chunks of a task, about.
CHUNKS_OF_TASK = 32
SPACE = "▁"
FRAGMENT = re.compile(r" *[^ \n]+| +|\n")
CACHE = 60_000
START = (0, -1)


class Pieces:
    """The model's pieces, the library's processor without its dummy prefix, and pair checks."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        n = self.lib.get_piece_size()
        self.text = [self.lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i))]
        alone = self.lib.encode([self.text[i].replace(SPACE, " ") for i in plain])
        self.id = {self.text[i]: i for i, got in zip(plain, alone) if got == [i]}
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        value = {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.bytes = [value.get(i, b"" if self.lib.is_control(i) else self.text[i].replace(SPACE, " ").encode()) for i in range(n)]
        self.longest = max(map(len, self.id))
        #: No piece has a space mark behind another character, and none a line feed.
        self.whole = all(SPACE not in t.lstrip(SPACE) and "\n" not in t for t in self.id)
        self.fragment = FRAGMENT if self.whole else re.compile(r"(?s).+")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    def token(self, s: str) -> int | None:
        """Id of a piece; a character outside the vocabulary is its negative code point, less two."""
        found = self.id.get(s)
        return -2 - ord(s) if found is None and len(s) == 1 else found

    def fits(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.lib.encode((self.text[a] + self.text[b]).replace(SPACE, " ")) == [a, b]
        return found

    def out(self, tokens: list[int]) -> np.ndarray:
        ids: list[int] = []
        for t in tokens:
            ids += [t] if t >= 0 else [self.byte[b] for b in chr(-2 - t).encode()]
        return np.array(ids, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text: the mark becomes a space and the first one, the dummy prefix, goes."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (one chunk each), by the library; each distinct fragment is encoded once."""
        split = [self.fragment.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list({f for s in split for f in s} - self.cache.keys())
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.cache.update((f, np.array(ids, np.uint16 if len(self.text) <= 65536 else np.uint32).tobytes()) for f, ids in zip(part, self.lib.encode(part, num_threads=1)))
        kind = np.uint16 if len(self.text) <= 65536 else np.uint32
        return [np.frombuffer(b"".join([self.cache[f] for f in s]), kind).astype(np.int32) for s in split]


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Chunk:
    """One chunk of a normalised text: [lo, hi) of ``s``, which also holds what pieces reach on both sides."""

    def __init__(self, p: Pieces, s: str, lo: int, hi: int, last: bool):
        self.p, self.s, self.lo, self.hi, self.last = p, s, lo, hi, last

    def entries(self) -> list[tuple[int, int]]:
        """All states (reach beyond lo, piece) that could hold at the cut before this chunk."""
        p, found = self.p, []
        for end in range(self.lo, min(len(self.s), self.lo + p.longest - 1) + 1):
            for start in range(max(0, end - p.longest), self.lo):
                t = p.token(self.s[start:end])
                if t is not None:
                    found.append((end - self.lo, t))
        return found

    def walk(self, entry: tuple[int, int], known: list[int | None] | None = None) -> tuple[list[int | None], bool]:
        """For each end position the piece of the one finite path there, from ``entry``; positions count from lo.

        Stops early, with True, once it agrees with ``known`` over the longest piece's length.
        """
        p, s, lo = self.p, self.s, self.lo
        stop = (self.hi if self.last else min(len(s), self.hi + p.longest - 1)) - lo
        limit = self.hi - lo
        reach: list[int | None] = [None] * (stop + 1)
        reach[entry[0]] = entry[1]
        agreed = 0
        ids, token, fits, longest, whole = p.id, p.token, p.fits, p.longest, p.whole
        begin = entry[0]  # no piece that ends here starts before
        for end in range(entry[0] + 1, stop + 1):
            if whole and s[lo + end - 1] == SPACE and s[lo + end - 2] != SPACE:
                begin = end - 1
            for start in range(max(begin, end - longest), min(end, limit)):
                a = reach[start]
                if a is None:
                    continue
                piece = s[lo + start : lo + end]
                b = ids.get(piece)
                if b is None:
                    if end - start > 1:
                        continue
                    b = token(piece)
                if fits(a, b):
                    reach[end] = b
                    break
            if known is not None:
                agreed = agreed + 1 if reach[end] == known[end] and reach[end] is not None else 0
                if agreed >= longest and end < limit:
                    reach[end + 1 :] = known[end + 1 :]
                    return reach, True
        return reach, False

    def length(self, t: int) -> int:
        return 1 if t < 0 else len(self.p.text[t])

    def trace(self, reach: list[int | None], entry: tuple[int, int], end: int) -> list[int]:
        tokens = []
        while end > entry[0]:
            t = reach[end]
            tokens.append(t)
            end -= self.length(t)
        return tokens[::-1]

    def transfer(self, first: bool) -> dict[tuple[int, int], dict[tuple[int, int], int]]:
        """(max, +) matrix: entry state -> exit state -> minus the number of pieces that start in this chunk."""
        matrix, known = {}, None
        size = self.hi - self.lo
        for entry in [START] if first else self.entries():
            if entry[0] > size:
                continue
            reach, _ = self.walk(entry, known)
            row = {}
            for over in range(0, 1 if self.last else len(reach) - size):
                t = reach[size + over]
                if t is not None and (over < self.length(t) or size + over == entry[0]):
                    row[over, t] = -len(self.trace(reach, entry, size + over))
            if row:
                matrix[entry] = row
                known = known or reach
        return matrix


def product(a: dict, b: dict) -> dict:
    """(max, +) product of two transfer matrices; associative."""
    out: dict = {}
    for i, row in a.items():
        new: dict = {}
        for k, w in row.items():
            for j, v in b.get(k, {}).items():
                new[j] = max(new.get(j, -np.inf), w + v)
        if new:
            out[i] = new
    return out


def boundary_states(matrices: list[dict]) -> list[tuple[int, int]]:
    """Entry state of every chunk on the one finite path: suffix products, then a step per chunk."""
    after: list[dict] = [{}] * len(matrices)
    after[-1] = {k: {"end": 0} for row in matrices[-1].values() for k in row}
    for k in range(len(matrices) - 1, 0, -1):
        after[k - 1] = product(matrices[k], after[k])
    states = [START]
    for k in range(len(matrices) - 1):
        row = matrices[k][states[-1]]
        states.append(max((w + after[k][j]["end"], j) for j, w in row.items() if j in after[k])[1])
    return states


def cuts(n: int, chunk: int) -> list[tuple[int, int]]:
    """[lo, hi) of the chunks of n characters; the last one takes what is left over."""
    count = max(1, n // chunk)
    return [(k * chunk, n if k == count - 1 else (k + 1) * chunk) for k in range(count)]


def _encoded_giants(docs: DataFrame, model: str, chunk: int) -> DataFrame:
    def split(batches):
        p = pieces(model)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = SPACE + text.replace(" ", SPACE)
                parts = cuts(len(s), chunk)
                for k, (lo, hi) in enumerate(parts):
                    low, high = max(0, lo - p.longest), min(len(s), hi + p.longest)
                    yield pa.RecordBatch.from_pylist([{"row": key, "part": k, "parts": len(parts), "lo": lo - low, "hi": hi - low, "s": s[low:high]}], schema=rows)

    rows = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("s", pa.string())])

    def transfers(batches):
        p = pieces(model)
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = Chunk(p, r["s"], r["lo"], r["hi"], r["part"] == r["parts"] - 1).transfer(r["part"] == 0)
                out.append({"row": r["row"], "part": r["part"], "m": np.array([(*i, *j, w) for i, row in m.items() for j, w in row.items()], np.int32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=matrix)

    matrix = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("m", pa.binary())])

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        matrices = []
        for m in t["m"].to_pylist():
            of: dict = {}
            for a, b, c, d, w in np.frombuffer(m, np.int32).reshape(-1, 5).tolist():
                of.setdefault((a, b), {})[c, d] = w
            matrices.append(of)
        states = boundary_states(matrices)
        nxt = [*states[1:], (0, -1)]
        return pa.table({"row": t["row"], "part": t["part"], "o": pa.array([s[0] for s in states], pa.int32()), "t": pa.array([s[1] for s in states], pa.int32()), "e": pa.array([s[0] for s in nxt], pa.int32())})

    def trace(batches):
        p = pieces(model)
        for b in batches:
            out = []
            for r in b.to_pylist():
                c = Chunk(p, r["s"], r["lo"], r["hi"], r["part"] == r["parts"] - 1)
                reach, _ = c.walk((r["o"], r["t"]))
                out.append({"row": r["row"], "part": r["part"], "ids": p.out(c.trace(reach, (r["o"], r["t"]), r["hi"] - r["lo"] + r["e"])).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=traced)

    traced = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])

    def assemble(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        ids = np.frombuffer(b"".join(t["ids"].to_pylist()), np.int32)
        return pa.table({"row": t["row"].slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    # a chunk costs about a second, so each is dealt on its own: adaptive execution would put such few bytes in one task
    spark = docs.sparkSession
    parts = docs.agg(F.sum(F.ceil(F.char_length("text") / chunk))).first()[0] or 1
    tasks = int(min(parts, max(2 * spark.sparkContext.defaultParallelism, -(-parts // CHUNKS_OF_TASK))))
    chunks = stage(docs.mapInArrow(split, "row long, part int, parts int, lo int, hi int, s string").repartition(tasks, "row", "part"), "chunks")
    states = chunks.mapInArrow(transfers, "row long, part int, m binary").groupBy("row").applyInArrow(combine, "row long, part int, o int, t int, e int")
    done = chunks.repartition(tasks, "row", "part").join(states.repartition(tasks, "row", "part"), ["row", "part"]).select("row", "part", "parts", "lo", "hi", "s", "o", "t", "e")
    return done.mapInArrow(trace, "row long, part int, ids binary").groupBy("row").applyInArrow(assemble, "row long, ids array<int>")


def encode(docs: DataFrame, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """``docs`` with a column ids array<int>: the pieces of ``text``, as the sentencepiece library gives them.

    With ``decoded`` there is also what :func:`decode` gives, in one pass over ordinary texts.

    A null or empty text has no ids. Texts of over ``giant`` characters take the parallel scan
    over chunks of ``chunk``. A space mark U+2581 in a text counts as a space, as in the library.
    Repeated rows stay; further columns are kept whatever their names; a column ``ids`` of the input is replaced.
    An empty table gives no rows.
    """
    lean(docs.sparkSession)
    docs = docs.drop("ids", "decoded") if decoded else docs.drop("ids")
    columns = docs.columns
    at = columns.index("text")

    def short(batches):
        p = pieces(model)
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.slice(k, 512)
                ids = p.encode_batch([t or "" for t in part.column(at).to_pylist()])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
                if decoded:
                    made.append(pa.array([p.decode(x) for x in ids], pa.string()))
                yield pa.record_batch([*part.columns, *made], names=schema.names)

    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), *[StructField("decoded", StringType())] * decoded])
    big = F.coalesce(F.char_length("text") > giant, F.lit(False))
    ordinary = docs.where(~big).mapInArrow(short, schema)
    giants = stage(docs.where(big).select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")), "giants")
    if giants.isEmpty():
        return ordinary
    found = _encoded_giants(giants.select("row", "doc.text"), model, chunk)
    done = giants.join(found, "row").select("doc.*", "ids")
    return ordinary.unionByName(decode(done, model) if decoded else done)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with a column decoded string, from its ids; null ids give null, an empty table no rows."""
    lean(encoded.sparkSession)
    columns = [c for c in encoded.columns if c != "decoded"]
    at = columns.index("ids")
    encoded = encoded.select(columns)

    def run(batches):
        p = pieces(model)
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.slice(k, 512)
                texts = [None if x.values is None else p.decode(x.values.to_numpy()) for x in part.column(at)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
