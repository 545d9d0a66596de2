"""Operator 8, SimHash near-duplicates through BK-trees.

Fingerprints: each bit is set if it is set in over half of the XXH64 hashes of
a text's word shingles. Links: at most ``radius`` differing bits.

Only distinct fingerprints are compared. Two of them within radius r, cut into
r + k blocks, agree in k blocks at least, so every choice of k blocks gives a
table of buckets and every link lies in a bucket of some table: nothing is
missed. k grows with the number of fingerprints so that buckets stay small. A
bucket above ``SHARD`` fingerprints is dealt into shards, and each pair of its
shards is a task of its own. A task receives whole buckets (or shard pairs) and
builds a BK-tree for each, all trees of a batch at once: a child hangs on its
parent's edge for their Hamming distance, and a search from a node at distance
d follows the edges d - r to d + r only. A task passes on a spanning forest of
the links that it finds, never the pairs, so a group of n fingerprints costs
n - 1 rows. Connected components come from alternating large and small stars
over written tables; nothing is gathered on the driver.

Defined results: null text counts as empty; a text without words has
fingerprint zero, linked like any other; fewer words than a shingle make one
shingle of all words; repeated rows and equal texts share a fingerprint and so
a component; a null id is ignored by the smallest id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, durable, free_name, spread_join, trim

SHARD = 4096
BATCH = 1 << 16
#: Query-node pairs that a search may look at together.
FRONTIER = 1 << 22
#: Slices of a fingerprint that many rows share, when they fetch its component.
RUNS = 256


def shingle_hashes(text: str | None, words: int = 4) -> list[int]:
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased."""
    found = (text or "").encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    xx = xxhash.xxh64_intdigest
    return [xx(joined[s:e], 42) for s, e in zip(starts[: len(found) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4) -> DataFrame:
    """id, fp (the 64 bits as a long)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def kernel():
        def work(columns):
            texts, ids = columns
            out = np.zeros(len(texts), np.uint64)
            for i, text in enumerate(texts):
                h = np.array(shingle_hashes(text, words), np.uint64)
                if not len(h):
                    continue
                set_in = np.zeros(64, np.int64)
                for s in range(0, len(h), 1 << 15):
                    set_in += np.unpackbits(h[s : s + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[i] = np.packbits(2 * set_in > len(h), bitorder="little").view(np.uint64)[0]
            return [ids, pa.array(out.view(np.int64))], None

        return work

    return arrow_map(docs, [F.col(f"`{text_col}`"), F.col(f"`{id_col}`")], schema, kernel)


def tables(n: int, radius: int, bits: int = 64, load: int = 256) -> list[int]:
    """Bit masks of the bucket tables: k of radius + k blocks each, k the smallest that keeps buckets of random fingerprints under ``load``."""
    k = next((k for k in range(1 if radius <= 4 else 2, 5) if n / 2 ** (bits * k / (radius + k)) <= load), 4)
    edges = [round(i * bits / (radius + k)) for i in range(radius + k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(blocks, k)]
    assert len(masks) == comb(radius + k, k)
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """BK-trees of several groups in arrays; the first member of a group is its root."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp = fp
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.concatenate((first, [len(fp)])))
        self.root, self.size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        waiting = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        at = self.root[waiting]
        keys, children = [], []
        while len(waiting):
            key = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at]).astype(np.int64)
            found, place, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(waiting[place])
            at = waiting[place][back]
            rest = at != waiting
            waiting, at = waiting[rest], at[rest]
        edge, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, children))
        order = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[order], child[order]

    def within(self, query: np.ndarray, radius: int):
        """Pairs (query, node) at most ``radius`` apart, level by level."""
        q, node = query, self.root[query]
        while len(q):
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            yield q[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right") - low
            ends = np.cumsum(n)
            total = int(ends[-1])
            at = np.repeat(low - (ends - n), n) + np.arange(total)
            q, node = np.repeat(q, n), self.child[at]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member) after joining a and b, pair by pair."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def spanning_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint pairs that connect, within each group, what links of at most ``radius`` bits connect."""
    forest = Forest(group, fp)
    label = np.arange(len(fp))
    query = np.flatnonzero(forest.size > 1)
    block = np.cumsum(forest.size[query]) // FRONTIER
    for part in np.split(query, np.flatnonzero(np.diff(block)) + 1) if len(query) else []:
        for a, b in forest.within(part, radius):
            label = unite(label, a, b)
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[at], fp[label[at]]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """a, b: links between the distinct fingerprints ``fp`` of ``prints`` that connect what all links connect."""
    masks = tables(prints.count(), radius)
    choices = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(choices).alias("c")).select("fp", F.xxhash64("c.t", "c.key").alias("bucket"))
    large = rows.groupBy("bucket").count().where(F.col("count") > SHARD).select("bucket", F.ceil(F.col("count") / SHARD).cast("int").alias("shards"))
    own = F.pmod(F.xxhash64("fp"), F.col("shards").cast("long")).cast("int")
    pairs = F.when(F.col("shards").isNull(), F.array(F.col("bucket"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j))))
    grouped = rows.join(large, "bucket", "left").select("fp", F.explode(pairs).alias("g"))

    def run(batches):
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        empty = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def found(group, fp):
            a, b = spanning_links(group, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=empty)

        for batch in batches:
            group = np.concatenate((group, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
            if len(group) >= BATCH and group[0] != group[-1]:
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                yield found(group[:cut], fp[:cut])
                group, fp = group[cut:], fp[cut:]
        if len(group):
            yield found(group, fp)
        trim()

    return grouped.select("g", "fp").repartition("g").sortWithinPartitions("g", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (the smallest node reachable) for the ends of ``edges`` (a, b), by large and small stars."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = durable(small, label)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, radius: int = 4) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable by links) of each row."""
    prints = durable(fingerprints(docs, id_col, text_col, words=words), "fingerprints")
    distinct = durable(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(durable(links(distinct.select("fp"), radius), "links"))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = spread_join(rooted, smallest, ["root"], F.col("fp"), RUNS).select("fp", "component_id")
    return spread_join(prints, by_print, ["fp"], F.col("id"), RUNS).select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


#: MinHash bands and hashes of each: a pair of Jaccard similarity s has no band in common with probability (1 - s**8)**60, which is
#: 1.6e-5 at 0.8, 5e-9 at 0.85 and below 1e-14 from 0.9; pairs that only share a passage seldom have one: 0.2 at 0.5, 0.02 at 0.36.
BANDS, BAND_HASHES = 60, 8
#: Fixed rule of the hash functions x * MULTIPLIER + SHIFT modulo 2**64.
MULTIPLIER = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(BANDS * BAND_HASHES)], np.uint64)
SHIFT = np.array([pow(0xD1342543DE82EF95, 2 * i + 1, 1 << 64) for i in range(BANDS * BAND_HASHES)], np.uint64)
#: Rows of a key that are compared with all its later rows in the first round; ``GROWTH`` times as many in the next, when few rows are left.
PIVOTS, GROWTH = 8, 4
#: Ids that may be broadcast to fetch their texts.
FEW = 10_000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; a text without words has one of its own kind, 0."""
    return np.unique(np.array(shingle_hashes(text, words) or [0], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set's least hashes."""
    least = np.empty(len(MULTIPLIER), np.uint64)
    step = max(1, (1 << 15) // len(own))
    for i in range(0, len(least), step):
        least[i : i + step] = (own * MULTIPLIER[i : i + step, None] + SHIFT[i : i + step, None]).min(1)
    rows = least.reshape(BANDS, BAND_HASHES)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND_HASHES):
        key = (key ^ rows[:, j]) * MULTIPLIER[j]
        key ^= key >> np.uint64(31)
    return key


def bands(texts: DataFrame, words: int) -> DataFrame:
    """id, key, n: the band keys of each text and its number of distinct shingles."""

    def kernel():
        def work(columns):
            sets = [shingle_set(text, words) for text in columns[0]]
            keys = np.concatenate([band_keys(own) for own in sets])
            return [pa.array(keys.view(np.int64)), pa.array(np.repeat(np.fromiter(map(len, sets), np.int64, len(sets)), BANDS))], np.repeat(np.arange(len(sets)), BANDS).tolist()

        return work

    return arrow_map(texts, [F.col("text")], T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]), kernel, carry=["id"])


def near_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b) of ids those whose shingle sets have the similarity, checked exactly."""
    own = spread_join(pairs, texts.select(F.col("id").alias("b"), F.col("text").alias("own")), ["b"], F.col("a"), RUNS)
    both = spread_join(own, texts.select(F.col("id").alias("a"), F.col("text").alias("first")), ["a"], F.col("b"), RUNS)

    def kernel():
        def work(columns):
            mine, first, a, b = columns
            last: tuple[str | None, np.ndarray] | None = None
            rows = []
            for i, (t, u) in enumerate(zip(mine, first, strict=True)):
                if last is None or u != last[0]:
                    last = (u, shingle_set(u, words))
                x = shingle_set(t, words)
                shared = len(np.intersect1d(x, last[1], assume_unique=True))
                if shared >= similarity * (len(x) + len(last[1]) - shared) - 1e-9:
                    rows.append(i)
            return [[a[i] for i in rows], [b[i] for i in rows]], rows

        return work

    return arrow_map(both, [F.col("own"), F.col("first"), F.col("a"), F.col("b")], pairs.select("a", "b").schema, kernel)


class Comparison:
    """Which pairs of ids are near. Every pair is compared once; only the texts of new pairs are moved."""

    def __init__(self, texts: DataFrame, words: int, similarity: float):
        self.texts, self.words, self.similarity = texts, words, similarity
        self.tested: list[DataFrame] = []
        self.near: list[DataFrame] = []

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The near ones of ``pairs`` (a, b)."""
        known = None
        if self.tested:
            known = union(self.near).join(pairs.hint("merge"), ["a", "b"], "left_semi")
            pairs = durable(pairs.join(union(self.tested).hint("merge"), ["a", "b"], "left_anti"), "fresh")
        wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted.hint("merge")
        compared = durable(self.texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "compared")
        near = durable(near_pairs(pairs, compared, self.words, self.similarity), "near")
        self.tested.append(pairs)
        self.near.append(near)
        return near if known is None else durable(near.unionByName(known), "near")


def greedy(alive: DataFrame, compare: Comparison, similarity: float) -> DataFrame:
    """id, by: the rows of ``alive`` (key, id, n) that go if a row stays unless one that stays, ``by``, with a smaller id, is near it.

    Rows meet in keys; sizes n and m below the similarity of each other cannot be near. A round compares the smallest ids
    of each key with its later ones, so a key of n rows costs a multiple of n. A row that was a pivot of all its keys has
    met all its candidates; it stays once no undecided smaller id is near it, and rows near it go. Decided rows leave, and
    the smallest undecided row is decided in every round."""
    fits = lambda m, n: F.least(m, n) >= F.lit(similarity) * F.greatest(m, n) - 1e-9
    gone, n_pivots = [], PIVOTS
    while not alive.isEmpty():
        first = alive.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("rank") <= n_pivots)  # limited before the exchange, too
        pivots = first.groupBy("key").agg(F.collect_list(F.struct(F.col("id").alias("a"), F.col("n").alias("m"))).alias("pivots"), F.max("id").alias("bar"))
        ranked = durable(spread_join(alive, pivots, ["key"], F.col("id"), RUNS), "ranked")
        # a row meets a pivot once, in however many keys
        earlier = F.filter("pivots", lambda p: (p["a"] < F.col("id")) & fits(p["m"], F.col("n")))
        met = ranked.groupBy("id", "n").agg(F.array_distinct(F.flatten(F.collect_list(earlier))).alias("pivots"))
        pairs = durable(met.select(F.col("id").alias("b"), F.explode("pivots.a").alias("a")).select("a", "b").distinct(), "pairs")
        near = compare(pairs)
        state = durable(ranked.groupBy("id").agg(F.bool_or(F.col("id") > F.col("bar")).alias("late")), "undecided")
        waiting, open_ids = state.where("late").select("id"), state.select("id")
        while True:
            stay = durable(open_ids.join(near.select(F.col("b").alias("id")).unionByName(waiting), "id", "left_anti"), "stay")
            if stay.isEmpty():
                break
            go = durable(near.join(stay, near["a"] == stay["id"], "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("by")), "go")
            gone.append(go)
            decided = stay.unionByName(go.select("id"))
            open_ids = durable(open_ids.join(decided, "id", "left_anti"), "undecided")
            near = durable(near.join(decided, near["a"] == decided["id"], "left_anti").join(decided, near["b"] == decided["id"], "left_anti"), "near")
        alive = durable(ranked.join(open_ids, "id", "left_semi").select("key", "id", "n"), "alive")
        n_pivots *= GROWTH
    return durable(union(gone), "gone") if gone else alive.select("id", F.col("id").alias("by"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """``docs`` without near copies, with all columns. In the order of ids a row stays unless a row that stays has at
    least this Jaccard similarity to its set of word shingles: no two rows that stay are near, and whatever goes is
    near one that stays. Rows without an id stay; rows that share an id stay or go together, by their smallest text.

    First, SimHash: rows of a component of ``radius`` that are near its smallest id go with that row's word, which takes
    the many copies of large groups out of what follows. But most pairs of this similarity lie further apart than any
    radius that can be searched, so the rows left also meet in ``bands``, where one near pair in 60,000 at most has no key in
    common, are compared exactly, and are decided in the order of ids. Where a row that others went for has gone
    itself, those go on with the row that it went for, or come back, and the decisions are made again; if none has, they are
    those of the order of ids over all rows."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    found = near_duplicates(texts, "id", "text", words=words, radius=radius)
    linked = durable(found.where("component_id < id").select(F.col("component_id").alias("a"), F.col("id").alias("b")).distinct(), "linked")
    compare = Comparison(texts, words, similarity)
    copies = compare(linked)

    met = durable(bands(texts, words), "bands")
    shared_keys = durable(met.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("key"), "keys")
    every = durable(met.join(shared_keys.hint("merge"), "key", "left_semi"), "alive")
    while True:
        gone = greedy(every.join(copies.select(F.col("b").alias("id")), "id", "left_anti"), compare, similarity)
        lost = durable(copies.join(gone.withColumnRenamed("id", "a"), "a"), "lost")
        if lost.isEmpty():
            break
        # what went for such a row is mostly near the row that this one has gone for
        moved = compare(durable(lost.select(F.col("by").alias("a"), "b").distinct(), "pairs"))
        copies = durable(copies.join(lost.select("a", "b"), ["a", "b"], "left_anti").unionByName(moved), "copies")
    name = free_name(docs, "gone")
    gone = durable(gone.select("id").unionByName(copies.select(F.col("b").alias("id"))).distinct().withColumnRenamed("id", name), "gone")
    return docs.join(gone.hint("merge"), F.col(f"`{id_col}`") == F.col(name), "left_anti")
