"""Training-data operators against brute force and on edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("netloom.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from netloom.llm import bpe, exact_dedup, html_extract, language_id, language_model, packing, quality, sentencepiece_scan, simhash, token_counts, token_files  # noqa: E402

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LONG = "lorem ipsum dolor " * 4000
TEXTS = [None, "", " ", "The cat", "the CAT", "the cat", "a\n\n b  c\t", "x<|endoftext|>y", "éü ΑΣ 日本 \x85 z", LONG, LONG, "one two three four five six seven eight nine ten", "  ", "a" * 5000]
SCHEMA = "doc_id long, text string, lang string, __run string, digest int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts(docs, nothing):
    lib = Tokenizer.from_file(BYTE)
    got = by_id(token_counts.token_counts(docs, BYTE))
    for i, t in enumerate(TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)
    assert token_counts.token_counts(nothing, BYTE).collect() == []


def test_packing(docs, nothing):
    lib = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs, WORD, capacity=64).collect()
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    seen, bins = Counter(), {}
    for r in rows:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.start == r.piece * 64
        seen[r.doc_id] += r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in want.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(seen.values()) // 64) + 1
    assert packing.pack_documents(nothing, WORD).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_limits(rule):
    lengths = np.random.default_rng(1).integers(1, 60, 300)
    bins, _ = packing.vector_best_fit(lengths, (100.0, 3.0, 5000.0), (1.0, 0.1, 0.1), rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 5000


@pytest.mark.parametrize(("limits", "most"), [({"max_docs": 2}, 2), ({"max_attention": 900}, 2), ({"max_attention": 400}, 1), ({}, 3)])
def test_limits_bind(spark, limits, most):
    """Twelve documents of 21 tokens for sequences of 64: three fit by tokens, fewer by pieces or by attention; a piece alone always does."""
    df = spark.range(12).selectExpr("id doc_id", "repeat('the ', 20) text")
    bins = Counter(r.sequence_id for r in packing.pack_documents(df, WORD, capacity=64, **limits).collect())
    assert set(bins.values()) == {most} and len(bins) == 12 // most


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c"), (5, "x y"), (5, "one two three"), (None, None), (3, ""), (5, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = sorted(token_files.round_trip(df, WORD).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, None, 3, 5, 5, 5]
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(6)]
    packed = packing.pack_documents(df, WORD).collect()
    assert sorted((r.doc_id or 0, r.length) for r in packed) == sorted((r.doc_id or 0, r.n_tokens) for r in ordered)
    assert len({(r.sequence_id, r.offset) for r in packed}) == 6
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(df).collect()) == [(0, 0), (0, 3), (3, 3), (5, 5), (5, 5), (5, 5)]
    assert sorted((r.doc_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()) == [(0, 1, True), (0, 2, False), (3, 2, True), (5, 1, True), (5, 2, True), (5, 2, True)]


def test_token_files(docs, nothing):
    lib = Tokenizer.from_file(WORD)
    got, start = by_id(token_files.round_trip(docs, WORD)), 0
    for i, t in enumerate(TEXTS):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.round_trip(nothing, WORD).collect() == []
    ids = np.array([5, 70000, 5, 1 << 25, 9], np.int64)
    assert token_files.decode_file(token_files.encode_file([3, None], np.array([2, 3]), ids))[2].tolist() == ids.tolist()


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup(docs, nothing, fan_in):
    got = by_id(exact_dedup.exact_dedup(docs, fan_in=fan_in))
    for i, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if lowered(u) == lowered(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
    assert exact_dedup.exact_dedup(nothing).collect() == []
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)


def brute_print(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, nothing):
    got = by_id(simhash.near_duplicates(docs))
    prints = [brute_print(t) for t in TEXTS]
    assert [got[i].fingerprint for i in range(len(TEXTS))] == [f"{p:016x}" for p in prints]
    label = list(range(len(TEXTS)))
    for _ in label:
        for i in label:
            for j in range(len(label)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    label[i] = min(label[i], label[j])
    assert [got[i].component_id for i in range(len(TEXTS))] == label
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("radius", [2, 4, 7])
def test_links_lose_none(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "SHARD", 16)  # hot buckets are dealt into shard pairs
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(25):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 9)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, radius).collect()]
    assert all((a ^ b).bit_count() for a, b in found)

    def groups(pairs):
        label = {f: f for f in fps}
        for _ in range(len(fps)):
            moved = False
            for a, b in pairs:
                m = min(label[a], label[b])
                moved |= label[a] != m or label[b] != m
                label[a] = label[b] = m
            if not moved:
                break
        return label

    assert groups(found) == groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius])


def test_language(spark, sf, docs, nothing):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)
    own = by_id(language_id.identify(docs))
    assert own[0].lang_pred == own[1].lang_pred == own[2].lang_pred == "und"
    assert language_id.identify(nothing).collect() == []


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (5, 1)], "doc_id long, quality int")
    got = by_id(quality.quality(docs, labels))
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert got[i].base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and got[i].kept == (not got[i].base_failed)
    assert quality.quality(nothing, labels).collect() == []


def test_quality_counts():
    text = "a # b $$ c\n\nx y\n \nx y\nx y\t\n&|<>\nx y\n" + "one two three four five six seven eight nine " * 2
    values, _ = quality.measure(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert values[:4] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)))
    assert values[2:] == (7, 2, 18)


def test_quality_on_held_out_labels(spark):
    """Of labelled rows that the model has not seen, it keeps nearly all good ones and few bad ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL")
    model = quality.train(docs, labels.where("doc_id % 4 <> 1"))
    unseen = docs.join(labels.where("doc_id % 4 = 1").select("doc_id", "quality"), "doc_id")
    rows = quality.judge(unseen, model, carry=["doc_id", "quality"]).where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert len(good) > 500 and sum(good) >= 0.99 * len(good) and len(bad) > 30 and sum(bad) <= 0.1 * len(bad)


def test_language_model(docs, nothing):
    got = by_id(language_model.score_texts(docs))
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), ""] for i, t in enumerate(TEXTS)}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (i in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert got[i].score < 0
    assert language_model.score_texts(nothing).collect() == []


def test_sentencepiece(docs, nothing):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = by_id(sentencepiece_scan.round_trip(docs, PIECE, giant=40, chunk=37))
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].decoded_equal) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert sentencepiece_scan.round_trip(nothing, PIECE).collect() == []


def test_sentencepiece_windows(spark):
    """Many blocks of chunks, with characters of any width, give what the library gives."""
    text = " ".join(f"wörd{i % 7} 🙂🙂 {'unbrokenletters' * (i % 5)} 語{i}" for i in range(1500))
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = spark.createDataFrame([(1, text), (2, text[:5001])], "doc_id long, text string")
    got = by_id(sentencepiece_scan.round_trip(docs, PIECE, giant=5000, chunk=300))
    for i, t in ((1, text), (2, text[:5001])):
        ids = lib.encode(t)
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].decoded_equal) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_html(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><div class='cookie-banner'><p>We use cookies on this page today.</p></div><article><h1>A &amp; B</h1><p>First  line<br>goes on here for a while.<p>Second one is here.</article><div class=comments><p>I like this very much, thanks.</p></div><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", ""), (4, "x", "<script>var a='<p>no</p>'</script>"), (5, "y", "<article><p>cut off in the mid")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.main_text(df).collect()}
    assert got[1].text == "A & B\nFirst line goes on here for a while.\nSecond one is here."
    assert got[2].text == got[3].text == got[4].text == "" and got[5].text == "cut off in the mid" and got[5].n_chars == 18


def test_proof():
    _, whole = bpe.vocabulary(BYTE)
    lib = Tokenizer.from_file(BYTE)
    assert all(len(lib.encode(t.decode(), add_special_tokens=False).ids) == 1 for t in list(whole)[1000:1200] if t.isascii() and not t.isspace())
