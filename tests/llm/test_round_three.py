"""Hard negatives, url filter and tokenizer alignment against brute force and SQL, with awkward rows."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

pytest.importorskip("netloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from netloom.llm import alignment, exact_dedup, hard_negatives, queries, url_filter  # noqa: E402
from netloom.llm.linear import calibrate, probability  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, vec binary, rid string"


def mined(rows):
    """Plain reading of what op11 asks for."""
    known = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for at, (i, v, label) in enumerate(known):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for k, (j, w, other) in enumerate(known) if k != at)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(t, k) for t, k, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit)]
    return sorted(out)


def mine(df):
    label = F.col("label").cast("long")
    found = hard_negatives.hard_negatives(df, "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label), F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).astype(np.float32)], int(rng.integers(0, 3)), b"", "x") for i in range(600)]
    rows += [(1000 + i, rows[5][1], i % 2, None, None) for i in range(30)]  # copies: ties
    rows += [(100, rows[7][1], 1, None, None), (2000, None, 1, None, None), (2001, rows[0][1], None, None, None), (None, rows[0][1], 1, None, None)]
    rows += [(2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, None, None), (2200, [float("nan")] * 6, 1, None, None), (2300, [float("inf")] * 6, 1, None, None), (2400, [], 1, None, None), (2500, [0.5, -0.25], 2, None, None)]
    assert mine(spark.createDataFrame(rows, VECTORS)) == mined(rows)
    assert mine(spark.createDataFrame([], VECTORS)) == []


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "COMPONENTS", 60)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "ANCHOR_LEAF", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 3
    rows = [(i * 20, [float(x) for x in (centres[i % 6] + rng.normal(size=4) * 0.2).astype(np.float32)], i % 4, None, None) for i in range(300)]
    assert mine(spark.createDataFrame(rows, VECTORS)) == mined(rows)


def test_pruning_leaves_out_nodes():
    rng = np.random.default_rng(1)
    x = np.rint(np.concatenate([rng.normal(size=(500, 8)) * 3 + c for c in (100, -100)]))
    tree = hard_negatives.Tree(x, 50)
    least, most = tree.bounds(np.full(1000, 50_000.0), np.full(1000, 1e9))
    leaves = int((tree.first < 0).sum())
    assert len(hard_negatives.leaf_pairs(tree, tree, least, most)) == leaves**2 / 2  # only pairs on one side


URLS = ["http://A.Example.com/EN/x", "https://example.com/en/", "http://www.example.com/en/1", "http://x.www.example.com/en/1?q=/en/", "ftp://net/es/9", "a.net/fr/", None, "", "http://", "://", "http://a.net/fr/#x", "http://a.net?x=/fr/", "http://notnet/fr/", "http://spam.example.org/" + "é𝄞" * 3000, "http://online-casino.example.org/en/1", "http://h\nost.org/p\nath", "x://y://z.com/a", "http://com/", "http://com", "http://a.com:80/x"]


def test_url_filter_against_sql(spark):
    rows = [(i, u, "a", "b", i) for i, u in enumerate(URLS)] + [(3, URLS[2], "a", "b", 1), (None, URLS[4], None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, b long")
    found = url_filter.judge_urls(df, url_filter.train(url_filter.labelled_urls(spark)), url_filter.RULES, carry=["page_id"])
    got = found.collect()
    con = duckdb.connect()
    pages = df.select("page_id", "url").toPandas().astype({"page_id": "Int64"})
    con.register("pages", pages)
    want = con.execute(url_filter.ORACLE_SQL).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert [r.verdict for r in got if r.host == "online-casino.example.org"] == ["block"]
    assert not found.where("page_id = 99").count() and len(got) == len(rows)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_url_filter_without_labels(spark):
    one = spark.createDataFrame([("http://x.org/", 1)], "url string, y int")
    assert url_filter.train(one) is None and url_filter.train(one.limit(0)) is None
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty, None, url_filter.RULES, carry=["page_id"]).collect() == []


TEXTS = ["Hello world, this isn't a test of 1234 numbers!", "", None, "<|endoftext|> and <s> </s> <0x41> <unk>", "  two  spaces\n\n\tand tabs ", "naïve café 東京タワー 🙂 Ελλάδα Привет", "▁ under", "a" * 9000, " " * 3000, "x\u00a0y\u3000z\u200b", "Hello world, this isn't a test of 1234 numbers!", "\x00\x1f", "e\u0301 ﬁ ①"]


def aligned_by_hand(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from netloom.llm.bpe import byte_alphabet

    letters = byte_alphabet()
    per, counts = [], Counter()
    for i, text in rows:
        ends, parts = [], []
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        for k, own in enumerate(ids):
            spelled = [bytes(letters[c] for c in a.id_to_token(t)) if k == 0 else bytes([int(b.id_to_piece(t)[3:-1], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in own]
            parts.append(b"".join(spelled))
            ends.append(np.cumsum([len(s) for s in spelled]).tolist())
        if not text or {*parts} != {(" " + text).encode()}:
            per.append((i, 0, 0, 0, [], ""))
            continue
        both = sorted({*ends[0]} & {*ends[1]})
        links = [(ids[0][ends[0].index(e)], ids[1][ends[1].index(e)]) for e in both]
        groups, last = [], 0
        for e in both:
            groups.append("|".join(",".join(str(t) for t, x in zip(own, at, strict=True) if last < x <= e) for own, at in zip(ids, ends, strict=True)))
            last = e
        counts.update(links)
        per.append((i, len(ids[0]), len(ids[1]), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted((i, x, y, g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), h) for i, x, y, g, links, h in per)


def align(df):
    found = alignment.alignment(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return sorted(tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_alignment(spark, sf, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_CHARS", 20_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = docs + [(10_000 + i, t) for i, t in enumerate(TEXTS)] + [(10_000, TEXTS[0])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, batch int, pairs string").repartition(3)
    got = align(df)
    assert got == aligned_by_hand(rows)
    assert sum(r[1] > 0 for r in got) > 60
    assert align(df.limit(0)) == []


def test_queries_are_registered():
    assert {"op11_hard_negatives", "op12_url_filter", "op13_tokenizer_alignment"} <= set(queries.QUERIES)


@pytest.mark.parametrize("n", [1, 8, 200])
def test_calibration(n):
    rng = np.random.default_rng(n)
    y = np.concatenate((-np.ones(n), np.ones(n)))
    apart = y * 8 + rng.normal(size=2 * n) * 0.1
    p = probability(apart, *calibrate(apart, y))
    assert (p[y < 0] < 0.5).all() and (p[y > 0] > 0.5).all()
    z = rng.normal(size=2000) * 3
    a, b = calibrate(z, np.where(rng.random(2000) < 1 / (1 + np.exp(-(0.7 * z - 1))), 1.0, -1.0))
    assert abs(a - 0.7) < 0.15 and abs(b + 1) < 0.3
    for margin, labels in ((np.ones(2 * n), y), (-apart, y), (apart, np.ones(2 * n))):
        with pytest.warns(RuntimeWarning):
            assert calibrate(margin, labels) == (1.0, 0.0)


def test_keep_one_loses_no_text(spark):
    rows = [(None, "same", 1), (7, "same", 2), (None, "unique with no id", 3), (5, "A", 4), (9, "a", 5), (5, "only copy", 6), (3, "twice", 7), (3, "twice", 8), (None, None, 9), (None, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int").withColumn("row", F.lit("x"))
    for keep, want in (("max", {2, 3, 5, 6}), ("min", {2, 3, 4, 6})):
        got = exact_dedup.keep_one(df, keep=keep).collect()
        assert {r.gone for r in got} - {7, 8, 9, 10} == want and len(got) == 6
        assert {r.text for r in got} - {"A", "a"} == {"same", "unique with no id", "only copy", "twice"} | ({None} & {r.text for r in got} or {""})
    assert exact_dedup.keep_one(df.limit(0)).collect() == []
