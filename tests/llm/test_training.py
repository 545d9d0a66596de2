"""What the fitted models learn from, on tables where a shortcut shows."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("netloom.llm")

from netloom.llm import language_id, language_model, quality  # noqa: E402
from netloom.llm.common import durable  # noqa: E402

RUN = "a" * 200_000  # its hashed counts are beyond half precision
GOOD = "the river bends along old stone walls and {} people walk there on quiet evenings with their dogs and talk about the day number {} in the village"
BAD = "buy cheap {} pills online now best price casino bonus click here win money fast free offer limited deal order today discount code {} xxx hot"
NORDIC = "det er en lille by ved havet og {} mennesker bor der om vinteren nummer {}"


@pytest.fixture(scope="module")
def long_run(spark):
    rows = [(i, (GOOD if i % 2 else BAD).format(i * 7, i), "en") for i in range(60)] + [(100 + i, NORDIC.format(i, i * 3), "fr") for i in range(60)]
    rows += [(200 + i, RUN, "en") for i in range(8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_long_run_language(long_run):
    got = language_id.identify(long_run).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == ("fr" if 100 <= r.doc_id < 200 else "en") for r in got)


def test_long_run_quality(spark, long_run):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(200 + i, 0) for i in range(8)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(long_run, labels).collect()}
    assert all(0 <= r.p_quality <= 1 for r in got.values())
    assert all(got[i].kept == bool(i % 2) for i in range(60))


def test_long_run_groups(long_run):
    texts = long_run.selectExpr("text", "doc_id id", "false held")
    c = language_model.centres(texts)
    assert np.isfinite(c).all() and len(c) == language_model.GROUPS
    assert all(np.isfinite(r.score) for r in language_model.score_texts(long_run).collect())


def test_model_against_its_base(spark):
    """On held-out texts the model gives each token more than the relative frequencies do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    r = language_model.score_texts(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert r.n > 1000 and r.s / r.n > r.b / r.n + 0.3


def test_class_probabilities_add_up():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(language_model.TABLE, language_model.CLASSES)).astype(np.float32)
    contexts = language_model.contexts(rng.integers(0, language_model.CLASSES, 500).astype(np.uint8), np.array([200, 300]))
    p = np.exp(language_model.log_softmax(weights, language_model.feature_rows(contexts)).astype(np.float64))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_words_before_a_token_count(spark):
    """Two words of one class are followed by different classes: the model tells them apart by the word."""
    rows = [(i, " ".join(f"s{i}x{j} t{i}x{j} red the v{i}x{j} w{i}x{j} blue u{i}x{j}" for j in range(6))) for i in range(300)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    docs = spark.createDataFrame([*rows, (held[0], "red the"), (held[1], "blue the")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_texts(docs).where(f"doc_id IN ({held[0]}, {held[1]})").collect()}
    assert got[held[0]].held_out and got[held[1]].held_out
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 0.05


def test_word_features_add_up():
    rng = np.random.default_rng(5)
    n, bits = language_model.CLASSES, 10
    base = language_model.log_softmax(rng.normal(size=(language_model.TABLE, n)).astype(np.float32), language_model.feature_rows(np.arange(50)))
    table = rng.normal(size=(1 << bits, n)).astype(np.float32)
    rows = np.repeat(language_model.word_rows(np.array([7], "<u2"), np.array([1]), bits), n, 1)
    p = np.exp(language_model.class_logs(base, table, np.full(n, 9), rows, np.arange(n)))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    after = language_model.word_rows(np.array([7, 8, 7, 7, 8], "<u2"), np.array([2, 3]), bits)
    assert (after[:, 0] == after[:, 2]).all() and (after[:, 1] == after[:, 3]).all() and (after[:, 1] != after[:, 4]).any()


def test_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    """A block is a row of megabytes; the writer must not hold a hundred of them."""
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 1 << 17)
    texts = spark.range(40).selectExpr("id", "array_join(transform(sequence(1, 20000), x -> hex(xxhash64(id, x))), ' ') text", "false held").coalesce(1)
    stored = durable(language_model.blocks(texts, np.zeros((1, 1 << language_model.BITS), np.float32)), "blocks", language_model.FEW_ROWS | {"parquet.block.size": str(1 << 20)})
    for path in stored.inputFiles():
        meta = pq.read_metadata(path.removeprefix("file:"))
        assert meta.num_rows >= 40 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 10
