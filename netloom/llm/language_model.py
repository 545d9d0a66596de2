"""Operator 2, scoring with a hashed maximum-entropy model.

P(token | history) = P(class | history) * P(token | class). Classes join a
group of words that occur in similar documents with a band of frequency; the
end of a text and unknown words have classes of their own. The class softmax is
log-linear in hashed features of the history: of its words the last one, the one
before it (a skip) and the two together; of its classes the last one, the last
two, skips over them, and the group three back. Within a class words have their
smoothed relative frequency, the closed form of a model with one bias a word.
Unknown words get the mass of words seen once, so the probabilities of all
tokens add up to one.

1. Texts become blocks: local word numbers, and the block's own word list, so
   that neither the corpus nor a task needs the whole vocabulary in memory.
2. Word lists are added up to the vocabulary; each block gets back the counts
   and classes of its own words only.
3. Class sequences of all training texts are counted by context. These counts
   are all that the likelihood depends on.
4. Training: each task adds up observed and expected counts over its contexts,
   tables of fixed size are summed by slices, and the driver takes a step.
   The features of words then get one step of iterative scaling over all training
   tokens, from the expectations of the model so far; their table grows with the
   number of tokens, up to ``WORD_BITS``.
5. Scoring: each token by its context's row and those of the words before it.

The groups of documents begin from about ``SAMPLE`` training texts and are moved
by passes over all of them; all counts cover every training text.

Defined results: null text counts as empty (only the end token); a null id is
learned from and not held out; texts of any length are scored whole; repeated
rows are learned and scored once each; with no training text every token is
unknown; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, sampled, slices, small_batches, trim
from .linear import matrix, squeezed, unit
from .pretok import CUT, Cached, Words, segments
from .pretok import groups as pieces

GROUPS, BANDS = 8, 8
END, UNKNOWN = GROUPS * BANDS, GROUPS * BANDS + 1
CLASSES = GROUPS * BANDS + 2
START = CLASSES
#: Contexts of classes; see ``contexts``.
CONTEXTS = (GROUPS + 3) * (CLASSES + 1) ** 2
#: Bits of the byte pairs by which texts fall into groups.
BITS = 11
#: Texts that give the first centres of document groups, passes over all training texts that move them, and lanes in which a pass adds up.
SAMPLE, PASSES, LANES = 600, 2, 64
BLOCK_BYTES = 1 << 22
#: Parquet's writer looks at its memory after 100 rows at first, which are gigabytes where a row is a block of texts.
FEW_ROWS = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: The most frequent words, whose counts every task gets; the others come by a join, each to the blocks that have it.
COMMON = 1 << 17
SLICE = 1 << 19
TABLE = 1 << 13
STEPS = 10
PENALTY = 0.1
SLICES = 16
#: The word table has a row for about ``ROW_TOKENS`` training tokens, 2**WORD_BITS at most, each of whose features is one of WORD_KINDS.
WORD_BITS, ROW_TOKENS, WORD_KINDS = 15, 2048, 3
#: What a weight of a word's feature takes both counts to have been more.
WORD_PRIOR = 1.0
#: Words are known to these features by a hash of 16 bits; before a text's first word is BEFORE.
BEFORE = 1 << 16


def byte_pairs(texts: list[bytes]) -> np.ndarray:
    """Counts of the hashed byte pairs of each text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(b) > 1:
            out[i] = np.bincount((((b[:-1] << np.uint32(8)) | b[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def raw_text() -> Column:
    """The bytes of ``text``; Python lower-cases the A-Z of bytes much faster than Spark does those of strings."""
    return F.col("text").cast("binary").alias("text")


def centres(texts: DataFrame) -> np.ndarray:
    """Centres of document groups: k-means on byte n-grams. A bounded sample of training texts gives the places to begin
    from; ``PASSES`` passes over every training text move them, each task adding up the texts nearest to each centre."""
    spark = texts.sparkSession
    learned = texts.where("NOT held AND length(text) > 0").select("id", raw_text())
    sample = sampled(learned, min(1.0, SAMPLE / max(1, texts.count())), "sample", "id")

    def run(batches):
        for batch in batches:
            for s in slices(batch, 0):
                yield pa.RecordBatch.from_pydict({"x": pa.array([squeezed(byte_pairs([t.lower()])[0]) for t in s.column(0).to_pylist()], pa.binary())})

    rows = sorted(bytes(r.x) for r in sample.select("text").mapInArrow(run, "x binary").collect())
    if not rows:
        return np.zeros((1, 1 << BITS), np.float32)
    x = matrix(rows, 1 << BITS)
    c = x[:1]
    while len(c) < min(GROUPS, len(x)):  # farthest first
        c = np.concatenate((c, x[[int((x @ c.T).max(1).argmin())]]))
    for _ in range(20):
        near = (x @ c.T).argmax(1)
        c = scaled(np.stack([x[near == g].mean(0) if (near == g).any() else c[g] for g in range(len(c))]))
    del x
    for _ in range(PASSES):
        now = spark.sparkContext.broadcast(c)

        def near_sums(batches, now=now):
            sums, n = np.zeros(now.value.shape), 0
            for batch in batches:
                for s in slices(batch, 0):
                    own = s.column(0).to_pylist()
                    for k in range(0, len(own), 128):
                        x = unit(byte_pairs([t.lower() for t in own[k : k + 128]]))
                        at = (x @ now.value.T).argmax(1)
                        for g in np.unique(at).tolist():
                            sums[g] += x[at == g].sum(0)
                    n += len(own)
            if n:
                lane = TaskContext.get().partitionId() % LANES
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(np.full(len(sums), lane)), pa.array([v.tobytes() for v in sums], pa.binary())], names=["grp", "lane", "total"])
            trim()

        def add(keys):
            def total(key, table):
                out = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("total"))
                return pa.table({n: [k.as_py()] for n, k in zip(keys, key, strict=True)} | {"total": pa.array([out.tobytes()], pa.binary())})

            return total

        first = learned.select("text").mapInArrow(near_sums, "grp long, lane long, total binary").groupBy("grp", "lane").applyInArrow(add(["grp", "lane"]), "grp long, lane long, total binary")
        moved = {r.grp: np.frombuffer(r.total, np.float64) for r in first.groupBy("grp").applyInArrow(add(["grp"]), "grp long, total binary").collect()}  # a row for each centre
        c = scaled(np.stack([moved[g] if g in moved and moved[g].any() else c[g] for g in range(len(c))]))
        now.unpersist()
    return c


def scaled(c: np.ndarray) -> np.ndarray:
    return (c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


BLOCKS = "block long, ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words array<string>, counts binary"


def blocks(texts: DataFrame, c: np.ndarray) -> DataFrame:
    """One row per block of about ``BLOCK_BYTES``: ids, folds and lengths of its texts, local numbers of their tokens
    (an end after each), its words, and the words' training counts by document group."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        fresh = lambda: (Cached(limit=1 << 31), [""], [], [], [], [], [])
        cache, words, ids, held, lengths, tokens, groups = fresh()
        size = 0

        def close():
            nonlocal number
            flat, n = np.concatenate(tokens), np.array(lengths)
            learned = np.repeat(~np.array(held, bool), n)
            group = np.repeat(np.array(groups, np.int8), n)
            counts = np.bincount(flat[learned].astype(np.int64) * GROUPS + group[learned], minlength=len(words) * GROUPS).astype(np.int32)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | number]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int64())), pa.array([flat.astype("<u4").tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([counts.tobytes()], pa.binary())],
                names=["block", "ids", "held", "lengths", "tokens", "words", "counts"],
            )

        for batch in batches:
            for s in slices(batch, 0, SLICE):
                own = [t.lower() for t in s.column(0).to_pylist()]
                parts = [(i, p) for i, t in enumerate(own) for p in ([t] if len(t) <= CUT else [p.encode() for p in segments(t.decode())])]
                found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for first, some in pieces([p for _, p in parts]):
                    w = Words(some)

                    def make(at, w=w):
                        words.extend(w.word(i).decode() for i in at.tolist())
                        return [[0]] * len(at)

                    found.append(cache.codes(w.h1, w.h2, make) + 1)
                    of.append(np.array([i for i, _ in parts[first : first + len(some)]], np.int64)[w.text])
                codes, of = np.concatenate(found), np.concatenate(of)
                n = np.bincount(of, minlength=len(own))
                flat = np.zeros(len(codes) + len(own), np.int32)
                flat[np.arange(len(codes)) + of] = codes
                tokens.append(flat)
                lengths += (n + 1).tolist()
                ids += s.column(1).to_pylist()
                held += s.column(2).to_pylist()
                for k in range(0, len(own), 128):
                    groups += (unit(byte_pairs(own[k : k + 128])) @ c.T).argmax(1).tolist()
                size += sum(len(p) for _, p in parts)
                if size >= BLOCK_BYTES:
                    yield close()
                    cache, words, ids, held, lengths, tokens, groups = fresh()
                    size = 0
        if ids:
            yield close()
        trim()

    return texts.select(raw_text(), "id", "held").mapInArrow(run, BLOCKS)


def group_rows(stored: DataFrame) -> DataFrame:
    """word, grp, n: training counts of each word of each block by document group, where there are any."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.frombuffer(batch.column(1)[i].as_buffer(), np.int32)
                at = np.flatnonzero(counts)
                for s in range(0, len(at), 1 << 16):
                    part = at[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.take(pa.array(part // GROUPS)), pa.array((part % GROUPS).astype(np.int32)), pa.array(counts[part].astype(np.int64))], names=["word", "grp", "n"])
        trim()

    return stored.select("words", "counts").mapInArrow(run, "word string, grp int, n long")


def vocabulary(stored: DataFrame) -> DataFrame:
    """word, c, grp of every training token; the end token is the empty word. A word's group is the one with most of
    its occurrences, the first of equals."""
    sums = group_rows(stored).groupBy("word", "grp").agg(F.sum("n").alias("n"))
    return sums.groupBy("word").agg(F.sum("n").alias("c"), F.max_by("grp", F.struct("n", -F.col("grp"))).alias("grp"))


def rare_rows(stored: DataFrame, common) -> DataFrame:
    """block, pos, word of the words of each block that are not among the common ones."""

    def run(batches):
        known = common.value
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(1)[i].values
                at = np.array([k for k, w in enumerate(words.to_pylist()) if w not in known], np.int32)
                for s in range(0, len(at), 1 << 16):
                    part = pa.array(at[s : s + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(0)[i].as_py())), part, words.take(part)], names=["block", "pos", "word"])
        trim()

    return stored.select("block", "words").mapInArrow(run, "block long, pos int, word string")


CODED = "id long, held boolean, n_tokens long, n_known long, base double, within double, classes binary, hashes binary"


def coded(stored: DataFrame, dictionary: DataFrame, common, n_train: int, v_train: int, class_size: np.ndarray) -> DataFrame:
    """Per text: counts, base score, log10 probability within classes, and the class and the hash of each token. ``class_size``: n + 0.5 V of each class."""
    floor = n_train + 0.5 * (v_train + 1)
    own_log = np.log10(np.maximum(class_size, 1e-9))

    def run(key, left, right):
        out = []
        if left.num_rows:
            words = right.column("pos").to_numpy()
            own, known = left.column("words")[0].as_py(), common.value
            found = [known.get(w, (0, UNKNOWN)) for w in own]
            c, cls = np.array([f[0] for f in found], float), np.array([f[1] for f in found], np.uint8)
            c[words] = right.column("c").to_numpy()
            cls[words] = right.column("cls").to_numpy()
            within = np.where(cls == UNKNOWN, 0.0, np.log10(c + 0.5) - own_log[cls])
            base = np.log10((c + 0.5) / floor)
            flat = np.frombuffer(left.column("tokens")[0].as_buffer(), "<u4")
            lengths = np.array(left.column("lengths")[0].as_py())
            first = np.cumsum(lengths) - lengths
            classes = cls[flat]
            known = np.add.reduceat((c[flat] > 0).astype(np.int64), first)
            hashes = np.array([zlib.crc32(w.encode()) & 0xFFFF for w in own], "<u2")[flat].tobytes()
            raw, ends = classes.tobytes(), np.cumsum(lengths).tolist()
            out = [left.column("ids")[0].values, left.column("held")[0].values, pa.array(lengths), pa.array(known), pa.array(np.add.reduceat(base[flat], first)), pa.array(np.add.reduceat(within[flat], first)), pa.array([raw[e - n : e] for e, n in zip(ends, lengths.tolist(), strict=True)], pa.binary()), pa.array([hashes[2 * (e - n) : 2 * e] for e, n in zip(ends, lengths.tolist(), strict=True)], pa.binary())]
        names = ["id", "held", "n_tokens", "n_known", "base", "within", "classes", "hashes"]
        return pa.table(dict(zip(names, out, strict=True))) if out else pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()), strict=True)})

    left = stored.select("block", "ids", "held", "lengths", "tokens", "words")
    return left.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(run, CODED)


def contexts(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Context number of each token: last class, the one before, and the group (or kind) of the third."""
    n = len(classes)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    padded = np.concatenate((np.full(3, START), classes.astype(np.int64)))
    c1, c2, c3 = (np.where(place >= k, padded[3 - k : 3 - k + n], START) for k in (1, 2, 3))
    third = np.where(c3 < END, c3 // BANDS, GROUPS + np.clip(c3 - END, 0, 2))
    return (third * (CLASSES + 1) + c2) * (CLASSES + 1) + c1


def word_rows(hashes: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the word table that the history of each token switches on: the last word, the one before it, both; hashed. A column each."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    padded = np.concatenate((np.full(2, BEFORE, np.uint64), hashes.astype(np.uint64)))
    last, other = (np.where(place >= k, padded[2 - k : 2 - k + n], np.uint64(BEFORE)) for k in (1, 2))
    out = np.empty((WORD_KINDS, n), np.uint16)
    for kind, value in enumerate((last, other, (last << np.uint64(17)) | other)):
        h = (value * np.uint64(WORD_KINDS) + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out[kind] = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)
    return out


def feature_rows(context: np.ndarray) -> np.ndarray:
    """Rows of the weight table that a context switches on: bias, last class, skip, third's group, pairs and the triple, hashed."""
    c1, rest = context % (CLASSES + 1), context // (CLASSES + 1)
    c2, third = rest % (CLASSES + 1), rest // (CLASSES + 1)
    zero = np.zeros_like(c1)
    out = []
    for kind, value in enumerate((zero, c1, c2, third, c2 * 100 + c1, third * 100 + c1, (third * 100 + c2) * 100 + c1)):
        h = (value.astype(np.uint64) * np.uint64(8) + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(64 - 13)).astype(np.int64))
    return np.stack(out, 1)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 0]].copy()
    for k in range(1, rows.shape[1]):
        z += weights[rows[:, k]]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def statistics(texts: DataFrame) -> DataFrame:
    """ctx, cls, n over the tokens of all training texts."""

    def run(batches):
        total = np.zeros(CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            for s in slices(batch, 0, 1 << 20):
                raw = s.column(0).to_pylist()
                classes = np.frombuffer(b"".join(raw), np.uint8)
                total += np.bincount(contexts(classes, np.fromiter(map(len, raw), np.int64, len(raw))) * CLASSES + classes, minlength=len(total))
        key = np.flatnonzero(total)
        for i in range(0, len(key), 1 << 16):
            own = key[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own // CLASSES), pa.array((own % CLASSES).astype(np.int32)), pa.array(total[own])], names=["ctx", "cls", "n"])

    return texts.where("NOT held").select("classes").mapInArrow(run, "ctx long, cls int, n long").groupBy("ctx", "cls").agg(F.sum("n").alias("n"))


def train(spark: SparkSession, stats: DataFrame) -> np.ndarray:
    """Weights after ``STEPS`` distributed gradient steps with momentum. A step divides the gradient, observed less
    expected counts, by the larger of the two and the number of features of a context, so that it cannot overshoot."""
    dealt = durable(stats.repartition("ctx"), "contexts")
    shares = np.full(CLASSES, 0.5)
    for r in dealt.groupBy("cls").agg(F.sum("n").alias("n")).collect():
        shares[r.cls] += r.n
    some = feature_rows(np.zeros(1, np.int64))
    k, bias = some.shape[1], some[0, 0]
    weights = np.zeros((TABLE, CLASSES), np.float32)
    weights[bias] = np.log(shares / shares.sum())
    weights[:, UNKNOWN] = -30.0 / k
    before = weights
    for number in range(STEPS):
        ahead = weights + number / (number + 3) * (weights - before)
        now = spark.sparkContext.broadcast(ahead.astype(np.float32))  # TABLE x CLASSES floats, whatever the corpus

        def add_up(batches, now=now):
            seen, made = np.zeros((TABLE, CLASSES), np.float32), np.zeros((TABLE, CLASSES), np.float32)
            any_rows = False
            for batch in batches:
                ctx, cls, n = (batch.column(i).to_numpy() for i in range(3))
                distinct, at = np.unique(ctx, return_inverse=True)
                for s in range(0, len(distinct), 1 << 14):
                    here = (at >= s) & (at < s + (1 << 14))
                    rows = feature_rows(distinct[s : s + (1 << 14)])
                    observed = np.zeros((len(rows), CLASSES), np.float32)
                    np.add.at(observed, (at[here] - s, cls[here]), n[here])
                    expected = observed.sum(1, keepdims=True) * np.exp(log_softmax(now.value, rows))
                    for j in range(k):
                        np.add.at(seen, rows[:, j], observed)
                        np.add.at(made, rows[:, j], expected)
                any_rows |= len(ctx) > 0
            if any_rows:
                for i, (a, b) in enumerate(zip(np.split(seen, SLICES), np.split(made, SLICES), strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["slice", "observed", "expected"])

        def total(key, table):
            add = lambda name: np.sum([np.frombuffer(x.as_buffer(), np.float32) for x in table.column(name)], 0, dtype=np.float64).astype(np.float32).tobytes()
            return pa.table({"slice": [key[0].as_py()], "observed": pa.array([add("observed")], pa.binary()), "expected": pa.array([add("expected")], pa.binary())})

        schema = "slice long, observed binary, expected binary"
        rows = sorted(dealt.select("ctx", "cls", "n").mapInArrow(add_up, schema).groupBy("slice").applyInArrow(total, schema).collect(), key=lambda r: r.slice)
        now.unpersist()
        if not rows:
            break
        observed, expected = (np.concatenate([np.frombuffer(r[name], np.float32) for r in rows]).reshape(TABLE, CLASSES) for name in ("observed", "expected"))
        step = (observed - expected - PENALTY * ahead) / (k * np.maximum(observed, expected) + 1)
        before, weights = weights, ahead + step
        weights[:, UNKNOWN] = -30.0 / k
    return weights.astype(np.float32)


def word_bits(n_train: int) -> int:
    return min(WORD_BITS, max(10, (n_train // ROW_TOKENS).bit_length()))


def word_weights(texts: DataFrame, spark: SparkSession, weights: np.ndarray, bits: int) -> np.ndarray:
    """The table of the words' features after one step of iterative scaling over all training tokens: the logarithm of observed
    to expected counts, by the number of features that a token has, which cannot lower the likelihood. A few tasks add up,
    so that what they hand on does not grow with the input."""
    now = spark.sparkContext.broadcast(weights)
    n = 1 << bits

    def run(batches):
        p = np.exp(log_softmax(now.value, feature_rows(np.arange(CONTEXTS))))
        seen, made, any_rows = np.zeros(n * CLASSES), np.zeros((n, CLASSES)), False
        for batch in batches:
            for s in slices(batch, 0, 1 << 17):
                raw = s.column(0).to_pylist()
                lengths = np.fromiter(map(len, raw), np.int64, len(raw))
                classes = np.frombuffer(b"".join(raw), np.uint8)
                rows = word_rows(np.frombuffer(b"".join(s.column(1).to_pylist()), "<u2"), lengths, bits)
                context = contexts(classes, lengths)
                for own in rows:
                    seen += np.bincount(own.astype(np.int64) * CLASSES + classes, minlength=len(seen))
                    for i in range(0, len(own), 1 << 17):
                        part = own[i : i + (1 << 17)]
                        order = np.argsort(part, kind="stable")
                        part = part[order]
                        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                        made[part[first]] += np.add.reduceat(p[context[i : i + (1 << 17)][order]], first, 0)
                any_rows = True
        if any_rows:
            for i, (a, b) in enumerate(zip(np.split(seen.astype(np.float32), SLICES), np.split(made.astype(np.float32).ravel(), SLICES), strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["slice", "observed", "expected"])
        trim()

    def step(key, table):
        observed, expected = (sum(np.frombuffer(x.as_buffer(), np.float32).astype(float) for x in table.column(name)) for name in ("observed", "expected"))
        own = (np.log((observed + WORD_PRIOR) / (expected + WORD_PRIOR)) / WORD_KINDS).astype(np.float32)
        return pa.table({"slice": [key[0].as_py()], "own": pa.array([own.tobytes()], pa.binary())})

    tasks = 2 * spark.sparkContext.defaultParallelism
    added = texts.where("NOT held").select("classes", "hashes").coalesce(tasks).mapInArrow(run, "slice long, observed binary, expected binary")
    rows = sorted(added.groupBy("slice").applyInArrow(step, "slice long, own binary").collect(), key=lambda r: r.slice)  # 2**WORD_BITS x CLASSES floats at most
    now.unpersist()
    table = np.concatenate([np.frombuffer(r.own, np.float32) for r in rows]).reshape(n, CLASSES) if rows else np.zeros((n, CLASSES), np.float32)
    table[:, UNKNOWN] = 0
    return table


def class_logs(base: np.ndarray, table: np.ndarray, context: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each token's class after its context and the words before it."""
    out = np.empty(len(context))
    for i in range(0, len(context), 1 << 12):
        z = base[context[i : i + (1 << 12)]]
        for own in rows:
            z += table[own[i : i + (1 << 12)]]
        z -= z.max(1, keepdims=True)
        mine = z[np.arange(len(z)), classes[i : i + (1 << 12)]]
        out[i : i + (1 << 12)] = mine - np.log(np.exp(z, out=z).sum(1))
    return out


def scored(texts: DataFrame, spark: SparkSession, weights: np.ndarray, table: np.ndarray, unknown: float, n_train: int) -> DataFrame:
    now = spark.sparkContext.broadcast((weights, table))
    bits = len(table).bit_length() - 1

    def run(batches):
        weights, table = now.value
        base = log_softmax(weights, feature_rows(np.arange(CONTEXTS)))
        for batch in batches:
            for s in slices(batch, 0, 1 << 18):
                raw = s.column(0).to_pylist()
                lengths = np.fromiter(map(len, raw), np.int64, len(raw))
                classes = np.frombuffer(b"".join(raw), np.uint8)
                rows = word_rows(np.frombuffer(b"".join(s.column(7).to_pylist()), "<u2"), lengths, bits)
                log_p = class_logs(base, table, contexts(classes, lengths), rows, classes) / np.log(10) + np.log10(1 - unknown)
                each = np.where(classes == UNKNOWN, np.log10(unknown), log_p)
                total = np.add.reduceat(each, np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays([*s.columns[1:5], pa.array(np.full(len(raw), n_train)), s.column(5), pa.array(total + s.column(6).to_numpy())], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.select("classes", "id", "held", "n_tokens", "n_known", "base", "within", "hashes").mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held: int = 1) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    key = F.col(f"`{id_col}`").cast("long")
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), key.alias("id"), F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(folds)) == held, F.lit(False)).alias("held"))
    small_batches(spark)
    stored = durable(blocks(texts, centres(texts)), "blocks", FEW_ROWS)
    words = durable(vocabulary(stored), "vocabulary")
    total = words.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1)).first()
    n_train, v_train, once = total[0] or 0, total[1], total[2]
    band = F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.floor((-F.log2(F.col("c") / F.lit(max(n_train, 1))) - 4) / 2)))
    cls = F.when(F.col("word") == "", F.lit(END)).otherwise(F.col("grp") * BANDS + band).cast("int")
    classed = words.select("word", "c", cls.alias("cls"))
    size = np.zeros(CLASSES)
    for r in classed.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        size[r.cls] = r.c + 0.5 * r.v
    top = classed.orderBy(F.desc("c"), "word").limit(COMMON).toArrow()
    common = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), zip(top.column("c").to_pylist(), top.column("cls").to_pylist(), strict=True), strict=True)))  # COMMON words at most
    dictionary = rare_rows(stored, common).join(classed, "word").select("block", "pos", "c", "cls")
    sequences = durable(coded(stored, dictionary, common, n_train, v_train, size), "sequences")
    weights = train(spark, statistics(sequences))
    table = word_weights(sequences, spark, weights, word_bits(n_train))
    return scored(sequences, spark, weights, table, (once + 1) / (n_train + 2), n_train).withColumnRenamed("id", id_col)
