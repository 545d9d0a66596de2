"""Near copies of the pipeline against all pairs."""

import random
from itertools import combinations

import pytest

pytest.importorskip("netloom.llm")

from netloom.llm.simhash import keep_one, shingle_hashes  # noqa: E402


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets_of(rows):
    return {i: set(shingle_hashes(t, 5)) for i, t in rows}


def greedy(sets):
    kept = []
    for i in sorted(sets):
        if not any(jaccard(sets[i], sets[j]) >= 0.8 for j in kept):
            kept.append(i)
    return kept


def kept_of(spark, rows):
    return sorted(r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def test_all_near_pairs_meet(spark):
    rng, rows = random.Random(1), []
    for g in range(40):  # pairs of similarity 0.8 to 0.95
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((2 * g, " ".join(words)))
        rows.append((2 * g + 1, " ".join(edited(rng, words, max(1, len(words) * (g % 3 + 1) // 100)))))
    sets = sets_of(rows)
    assert sum(jaccard(sets[a], sets[b]) >= 0.8 for a, b in combinations(sets, 2)) >= 30
    assert kept_of(spark, rows) == greedy(sets)


def test_groups_behind_a_stranger(spark):
    """A chain, and many copies that share a passage with a smaller id that is no copy of theirs."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(90)]
    chain = [[f"c{i}" for i in range(200)]]
    for _ in range(4):
        chain.append(edited(rng, chain[-1], 3))
    own = passage + [f"q{i}" for i in range(40)]
    rows = [(0, " ".join(passage + [f"r{i}" for i in range(40)]))]
    rows += [(10 + i, " ".join(edited(rng, own, 1))) for i in range(30)]
    rows += [(100 + i, " ".join(w)) for i, w in enumerate(chain)]
    rows += [(200, ""), (201, None), (202, " "), (203, "one two"), (204, "One  two")]
    assert kept_of(spark, rows) == greedy({i: s or {0} for i, s in sets_of(rows).items()})


def test_no_near_pair_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets = {i: s or {0} for i, s in sets_of((r.doc_id, r.text) for r in docs.collect()).items()}
    kept = [r.doc_id for r in keep_one(docs).collect()]
    assert not [(a, b) for a, b in combinations(kept, 2) if jaccard(sets[a], sets[b]) >= 0.8]


def test_copies_of_uneven_length(spark):
    """Parts of a text at the border of the similarity, in more copies than a round has pivots."""
    words = [f"u{i}" for i in range(104)]
    rows = [(i, " ".join(words[: 104 - i])) for i in range(0, 60, 3)] + [(100 + i, " ".join(words[i:])) for i in range(1, 40, 2)]
    assert kept_of(spark, rows) == greedy(sets_of(rows))
