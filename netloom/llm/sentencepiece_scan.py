"""Operator 7, SentencePiece encoding and decoding; giant documents by a max-plus scan.

The model file is byte-pair encoding, whose result is not the best-scoring
segmentation, so a Viterbi search over piece scores would give wrong ids.
What makes a segmentation right is local: every two neighbouring pieces must
encode, as a string, to just these two. Taking 0 for a compatible pair of
neighbours and minus infinity for others, the right segmentation is the only
path of weight 0, and the (max, +) algebra applies as it stands.

A giant document is cut at fixed places into chunks. The state at a cut is the
piece that reaches over it. A chunk's transfer matrix says which entry states
lead to which exit states with weight 0; matrices are composed associatively in
a tree, which gives the true state at every cut, and each chunk is then traced
back by itself. Other documents are encoded by the library in batches.

Defined results: null text counts as empty and has no ids; spaces are kept;
characters without a piece become their bytes; texts of any length are read
whole; repeated rows give equal results, and giant copies are encoded once; a
text that holds the model's own space mark, U+2581, decodes with spaces in its
place, as by the library; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, durable, spread_join

SPACE = "▁"
GIANT = 1 << 16
CHUNK = 8_192
#: Chunks of a task; the number of tasks follows from it, so that Spark doesn't fold small tables into one.
TASK_CHUNKS = 8
#: Slices in which rows of one giant text, which may be many copies, fetch its ids.
RUNS = 64
COMPATIBLE_LIMIT = 1 << 20


class Pieces:
    """A model's pieces, its merges, and which pieces may stand next to each other."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.id = {self.library.id_to_piece(i): i for i in plain}
        self.score = {p: self.library.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.byte_id = {int(self.library.id_to_piece(i)[1:-1], 16): i for i in range(n) if self.library.is_byte(i)}
        self.raw = [b""] * n
        for p, i in self.id.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        self.known: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair merges of a short string: the best-scoring neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        if (found := self.known.get((a, b))) is None:
            found = self.merge(a + b) == [a, b]
            if len(self.known) >= COMPATIBLE_LIMIT:
                self.known.clear()
            self.known[a, b] = found
        return found

    def ends(self, text: str, at: int) -> list[int]:
        """Where the pieces that start at ``at`` end; a character without a piece is one of its own."""
        found = [e for e in range(at + 1, min(len(text), at + self.longest) + 1) if text[at:e] in self.id]
        return found if found and found[0] == at + 1 else [at + 1, *found]

    def ids(self, piece: str) -> list[int]:
        if (i := self.id.get(piece)) is not None:
            return [i]
        return [self.byte_id[b] for b in piece.encode()]


State = tuple[int, int]  # a piece's first and last + 1 position


def over(pieces: Pieces, text: str, cut: int) -> list[State]:
    """Pieces of ``text`` that reach over or up to ``cut`` and start before it."""
    return [(i, e) for i in range(max(0, cut - pieces.longest), cut) for e in pieces.ends(text, i) if e >= cut]


def forward(pieces: Pieces, text: str, entries: list[State | None], stop: int) -> tuple[dict[State, int], dict[State, State | None]]:
    """(entry bits that reach each piece which ends at or after ``stop``, predecessors). None is the document's start."""
    alive: dict[int, dict[int, int]] = {}
    back: dict[State, State | None] = {}
    for bit, entry in enumerate(entries):
        i, e = entry or (-1, 0)
        ending = alive.setdefault(e, {})
        ending[i] = ending.get(i, 0) | 1 << bit
    for at in range(min(alive, default=0), stop):
        ending = alive.pop(at, None)
        if not ending:
            continue
        for e in pieces.ends(text, at):
            own = text[at:e]
            for i, bits in ending.items():
                if i < 0 or pieces.compatible(text[i:at], own):
                    here = alive.setdefault(e, {})
                    here[at] = here.get(at, 0) | bits
                    back.setdefault((at, e), (i, at) if i >= 0 else None)
    return {(i, e): bits for e, ending in alive.items() for i, bits in ending.items() if 0 <= i < stop <= e}, back


def transfer(pieces: Pieces, text: str, entry: int, stop: int, first: bool) -> tuple[list[State | None], list[State], np.ndarray]:
    """A chunk's entry states, exit states and (max, +) matrix, 0 or minus infinity."""
    entries: list[State | None] = [None] if first else list(over(pieces, text, entry))
    exits = over(pieces, text, stop)
    reached, _ = forward(pieces, text, entries, stop)
    m = np.full((len(entries), len(exits)), -np.inf, np.float32)
    for j, state in enumerate(exits):
        bits = reached.get(state, 0)
        for i in range(len(entries)):
            if bits >> i & 1:
                m[i, j] = 0
    return entries, exits, m


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(1) if b.size and a.size else np.full((a.shape[0], b.shape[1]), -np.inf, np.float32)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices: pairs are composed first, then halves, as a scan."""
    if len(matrices) == 1:
        return matrices
    pairs = [compose(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
    even = prefixes(pairs)
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(even[k // 2] if k % 2 else compose(even[k // 2 - 1], matrices[k]))
    return out


def trace(pieces: Pieces, text: str, entry: State | None, leave: State) -> list[int]:
    """Ids of the pieces after ``entry`` up to ``leave``."""
    _, back = forward(pieces, text, [entry], leave[0] + 1)
    out, state = [], leave
    while state is not None and state != entry:
        out.append(text[state[0] : state[1]])
        state = back[state]
    return [i for p in reversed(out) for i in pieces.ids(p)]


def decode(pieces: Pieces, ids) -> str:
    """The text of some ids: bytes are joined, and the space before the first piece is dropped."""
    text = b"".join([pieces.raw[i] for i in ids]).decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


_PIECES: dict[int, Pieces] = {}


def loaded(data: bytes) -> Pieces:
    if (key := hash(data)) not in _PIECES:
        _PIECES[key] = Pieces(data)
    return _PIECES[key]


def _packed(states: list[State | None]) -> bytes:
    return np.array([s or (-1, 0) for s in states], np.int64).tobytes()


def _states(raw: bytes) -> list[State | None]:
    return [None if i < 0 else (i, e) for i, e in np.frombuffer(raw, np.int64).reshape(-1, 2).tolist()]


def giant_ids(giants: DataFrame, data: bytes, chunk: int) -> DataFrame:
    """key, ids (little-endian unsigned 32-bit) of distinct giant texts (key, text)."""
    longest = loaded(data).longest
    tasks = giants.agg(F.sum(F.ceil((F.char_length("text") + 1) / chunk))).first()[0]
    tasks = max(1, -(-(tasks or 0) // TASK_CHUNKS))
    # windows are cut where the text is read, out of about as many blocks as each block has chunks: only they are exchanged, and no
    # window is sought from the start of the whole text
    marked = giants.select("key", F.concat(F.lit(SPACE), F.translate("text", " ", SPACE)).alias("s")).withColumn("n", F.char_length("s"))
    marked = marked.withColumn("wide", (F.ceil(F.sqrt(F.col("n") / chunk)) * chunk).cast("int"))

    def block(j):
        lead = F.least(j * F.col("wide"), F.lit(longest)).cast("int")
        return F.struct((j * F.col("wide")).cast("int").alias("at"), lead.alias("lead"), F.col("s").substr((j * F.col("wide") - lead + 1).cast("int"), lead + F.col("wide") + longest).alias("text"))

    count = lambda n, size: F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    blocks = marked.select("key", "n", "wide", F.explode(F.transform(count(F.col("n"), F.col("wide")), block)).alias("b"))

    def window(i):
        first = F.col("b.at") + i * chunk
        begin, stop = F.greatest(F.lit(0), first - longest), F.least(F.col("n"), first + chunk)
        text = F.col("b.text").substr((begin - F.col("b.at") + F.col("b.lead") + 1).cast("int"), (stop + longest - begin).cast("int"))
        return F.struct(text.alias("window"), (first / chunk).cast("int").alias("k"), (first - begin).cast("int").alias("entry"), (stop - begin).cast("int").alias("stop"), begin.cast("int").alias("begin"))

    parts = blocks.select("key", F.explode(F.transform(count(F.least(F.col("wide"), F.col("n") - F.col("b.at")), F.lit(chunk)), window)).alias("w")).select("w.window", "key", "w.k", "w.entry", "w.stop", "w.begin")
    windows = durable(parts.repartition(tasks, "key", "k"), "chunks")

    def matrices():
        def work(columns):
            out = [[], [], []]
            for window, entry, stop, begin, k in zip(*columns, strict=True):
                a, b, m = transfer(loaded(data), window, entry, stop, k == 0)
                for column, value in zip(out, (_packed([s and (s[0] + begin, s[1] + begin) for s in a]), _packed([(i + begin, e + begin) for i, e in b]), m.tobytes()), strict=True):
                    column.append(value)
            return out, None

        return work

    binary = T.StructType([T.StructField(n, T.BinaryType()) for n in ("entries", "exits", "m")])
    windows = windows.repartition(tasks, "key", "k")
    transfers = arrow_map(windows, [F.col(c) for c in ("window", "entry", "stop", "begin", "k")], binary, matrices, carry=["key", "k"])

    def combine(key, table):
        rows = sorted(zip(table.column("k").to_pylist(), table.column("entries").to_pylist(), table.column("exits").to_pylist(), table.column("m").to_pylist(), strict=True))
        states = [(_states(a), _states(b)) for _, a, b, _ in rows]
        matrices = [np.frombuffer(m, np.float32).reshape(len(a), len(b)) for (a, b), (*_, m) in zip(states, rows, strict=True)]
        products = prefixes(matrices)
        leave = int(products[-1][0].argmax())
        out = []
        for at in range(len(rows) - 1, -1, -1):  # back along the path of weight 0
            enter = int((products[at - 1][0] + matrices[at][:, leave]).argmax()) if at else 0
            out.append((key[0].as_py(), rows[at][0], *(states[at][0][enter] or (-1, 0)), *states[at][1][leave]))
            leave = enter
        return pa.table({n: pa.array(c) for n, c in zip(("key", "k", "ei", "ee", "xi", "xe"), zip(*out, strict=True), strict=True)}).cast(pa.schema([("key", pa.string()), ("k", pa.int32()), *((n, pa.int64()) for n in ("ei", "ee", "xi", "xe"))]))

    cuts = transfers.groupBy("key").applyInArrow(combine, "key string, k int, ei long, ee long, xi long, xe long")

    def backtrace():
        def work(columns):
            out = []
            for window, begin, ei, ee, xi, xe in zip(*columns, strict=True):
                entry = None if ei < 0 else (ei - begin, ee - begin)
                out.append(np.array(trace(loaded(data), window, entry, (xi - begin, xe - begin)), "<u4").tobytes())
            return [out], None

        return work

    traced = arrow_map(windows.join(cuts.repartition(tasks, "key", "k"), ["key", "k"]), [F.col(c) for c in ("window", "begin", "ei", "ee", "xi", "xe")], T.StructType([T.StructField("ids", T.BinaryType())]), backtrace, carry=["key", "k"])

    def join(key, table):
        rows = sorted(zip(table.column("k").to_pylist(), table.column("ids").to_pylist(), strict=True))
        return pa.table({"key": [key[0].as_py()], "ids": pa.array([b"".join(x for _, x in rows)], pa.binary())})

    return traced.groupBy("key").applyInArrow(join, "key string, ids binary")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", *, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """id, text, ids (little-endian unsigned 32-bit integers) of each row."""
    with open(os.fspath(model), "rb") as f:
        data = f.read()
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    large = F.char_length("text") > giant

    def kernel():
        def work(columns):
            texts, ids = columns
            found = loaded(data).library.encode(texts, num_threads=1)
            return [ids, texts, [np.array(x, "<u4").tobytes() for x in found]], None

        return work

    schema = T.StructType([T.StructField("id", named.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("ids", T.BinaryType())])
    usual = arrow_map(named.where(~large), [F.col("text"), F.col("id")], schema, kernel)
    giants = durable(named.where(large).withColumn("key", F.sha2("text", 256)), "giants")
    distinct = durable(giants.groupBy("key").agg(F.first("text").alias("text")), "distinct")
    found = giant_ids(distinct, data, chunk)
    scanned = spread_join(giants, found, ["key"], F.xxhash64("id", F.monotonically_increasing_id()), RUNS).select("id", "text", "ids")
    return usual.unionByName(scanned).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_tokens, ids_crc32, and whether decoding the ids gives the text back."""
    with open(os.fspath(model), "rb") as f:
        data = f.read()
    coded = encode(docs, model, id_col, text_col, **options)

    def kernel():
        def work(columns):
            texts, ids = columns
            same = [decode(loaded(data), np.frombuffer(x, "<u4").tolist()) == t for t, x in zip(texts, ids, strict=True)]
            return [same], None

        return work

    counted = coded.select("text", "ids", F.col(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return arrow_map(counted, [F.col("text"), F.col("ids")], T.StructType([T.StructField("decoded_equal", T.BooleanType())]), kernel, carry=[id_col, "n_tokens", "ids_crc32"])
