"""The pipeline's stages against a plain reading of what each should keep."""

import pytest

pytest.importorskip("netloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from netloom.llm.common import durable  # noqa: E402
from netloom.llm.simhash import shingle_hashes  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    last: dict[str, int] = {}
    for i, t in kept["quality_rules"].items():
        last[lower(t)] = max(i, last.get(lower(t), -1))
    assert set(kept["exact_dedup"]) == set(last.values())
    gone = set(kept["exact_dedup"]) - set(kept["simhash_near_dedup"])
    sets = {i: set(shingle_hashes(t, 5)) for i, t in kept["exact_dedup"].items()}
    for i in gone:  # whatever goes has a near copy that stays
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept["simhash_near_dedup"])
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(kept["simhash_near_dedup"])


PROSE = "the river bends along old stone walls and many people walk there on quiet evenings with their dogs and talk about the day number {} in the village near {} hills"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, and names that the stages use themselves."""
    rows = [(i, PROSE.format(i, i * 7), "en", i % 2) for i in range(40)]
    rows += [(7, PROSE.format(7, 49), "en", 1), (7, PROSE.format(7, 49), "en", 1), (None, PROSE.format("x", "y"), "en", 0), (None, "Only this row says so, " + PROSE.format("u", "v"), None, None)]
    rows += [(100, None, "en", None), (101, "", None, 1), (None, None, None, None), (102, PROSE.format(1, 2) * 3000, "en", 1), (103, PROSE.format(1, 7).upper(), "en", 0), (104, "1234 5678", "en", 0)]
    names = "doc_id long, text string, lang string, __lang int, __score int, __kept int, verdict_kept int, __gone int, gone int, row int, lang_pred int, score int, source string, n_chars long"
    return spark.createDataFrame([(*r, *[1] * 8, "s", 1) for r in rows], names)


def test_stages_on_awkward_rows(spark, sf, awkward):
    from collections import Counter

    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, awkward, sf)
        assert found.columns == awkward.columns and found.schema == awkward.schema
        kept[name] = Counter((r.doc_id, r.text) for r in found.collect())
        assert stage(spark, awkward.limit(0), sf).collect() == []
    everything = Counter((r.doc_id, r.text) for r in awkward.collect())
    assert all(not c - everything for c in kept.values())
    assert {t for _, t in kept["language_id"]} == {t for _, t in everything if t and any(map(str.isalpha, t))}
    assert not {None, "", "1234 5678"} & {t for _, t in kept["quality_rules"]}
    lower = lambda t: (t or "").lower()  # noqa: E731  the texts are ASCII
    assert {lower(t) for _, t in kept["exact_dedup"]} == {lower(t) for _, t in everything} and max(Counter(lower(t) for _, t in kept["exact_dedup"].elements()).values()) == 1
    assert kept["exact_dedup"][7, PROSE.format(7, 49)] == 1 and (103, PROSE.format(1, 7).upper()) in kept["exact_dedup"]
    assert sum(n for (i, _), n in kept["simhash_near_dedup"].items() if i is None) == 3
    pieces = pipeline.STAGES[-1][1](spark, awkward, sf).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(i for (i, _), n in everything.items() for _ in range(n))
    assert pipeline.STAGES[-1][1](spark, awkward.limit(0), sf).collect() == []
