"""Packing, models, archives and search: exact round trips, brute force, held-out scores."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from helpers import same_rows
from llm_helpers import make
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import language_id, packing, quality_model, topk, warc



@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_file())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_are_text_ids(text):
    from tokenizers import Tokenizer

    global _encoder
    try:
        _encoder
    except NameError:
        _encoder = Tokenizer.from_file(packing.tokenizer_file())
    ids = packing._tokenizer(packing.tokenizer_file()).encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == _encoder.encode(text, add_special_tokens=False).ids


def test_words_with_markers(encoder):
    words = packing._tokenizer(packing.tokenizer_file())
    assert words.marker is not None
    parts = [words.marker[1], words.marker[1][:-1], words.marker[1][1:], "<|endoftext|>", "<", "|>", "a", " ", "\u0301", "İ"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(parts, 40)) for _ in range(200)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in words.encode(texts)]
    assert got == [encoder.encode(t, add_special_tokens=False).ids for t in texts]


def check_pieces(rows, got, encoder, capacity):
    want = {i: np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, _ in rows}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert (zlib.crc32(ids.tobytes()), len(want[r.doc_id])) == (r.ids_crc32, r.doc_tokens)
    for own, key, size in ((pieces, "start", None), (sequences, "offset", capacity)):
        for k, rs in own.items():
            at = 0
            for r in sorted(rs, key=lambda r: r[key]):
                assert r[key] == at
                at += r.length
            assert at <= size if size else at == len(want[k])
    assert set(pieces) == set(want)
    return sequences


def test_packing(spark, corpus, encoder):
    for capacity in (4096, 64):
        got = packing.pack(make(spark, corpus), capacity=capacity).collect()
        sequences = check_pieces(corpus, got, encoder, capacity)
        tokens = sum(r.length for r in got)
        assert len(sequences) <= tokens / capacity * 1.2 + 2
        for rs in sequences.values():
            n = sum(r.length for r in rs)
            assert {r.sequence_tokens for r in rs} == {n} and {r.padded_to for r in rs} == {n if n & (n - 1) == 0 else capacity}


def test_packing_places_and_edges(spark, corpus, encoder, tmp_path):
    assert packing.pack(make(spark, [])).count() == 0
    make(spark, corpus).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    check_pieces(corpus, packing.pack(docs, place=packing.written_place(docs)).collect(), encoder, 4096)
    assert packing.written_place(make(spark, corpus)) is None


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 60, 64) * (rng.random(64) < 0.6)
    check_patterns(np.flatnonzero(demand) + 1, demand[demand > 0], 64)
    assert packing.cutting_stock(np.zeros(0, int), np.zeros(0, int), 8) == ([], 0.0)


def check_patterns(sizes, demand, capacity):
    patterns, bound = packing.cutting_stock(sizes, demand, capacity)
    assert (sum(times * column for times, column in patterns) == demand).all()
    assert all(column @ sizes <= capacity and times > 0 for times, column in patterns)
    used = sum(times for times, _ in patterns)
    assert demand @ sizes / capacity <= bound + 1e-4 and bound - 1e-6 <= used <= bound * 1.01 + 2
    return used, bound


def lengths(folder):
    """Pieces of each length, 1 to 4096, of a documents table."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist()
    counts = np.zeros(4096, np.int64)
    for ids in packing._tokenizer(packing.tokenizer_file()).encode(texts):
        full, rest = divmod(len(ids) // 4 + 1, 4096)
        counts[4095] += full
        if rest:
            counts[rest - 1] += 1
    return counts


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_cutting_stock_of_documents(scale):
    counts = lengths(f"/root/testdata/{scale}")
    classes, sizes = packing.length_classes(counts, packing.CLASSES)
    seen = np.flatnonzero(counts)
    assert (sizes[classes[seen]] >= seen + 1).all() and len(sizes) <= packing.CLASSES
    demand = np.bincount(classes[seen], counts[seen]).astype(int)
    used, bound = check_patterns(sizes, demand, 4096)
    assert used <= sum(times for times, _ in packing._longest_first(sizes, demand, 4096))
    assert used * 4096 <= 1.01 * (counts @ np.arange(1, 4097)) + 2 * 4096


@pytest.mark.parametrize("noise", [1e-15, 1e-12, 1e-9, "singular"])
def test_cutting_stock_with_a_noisy_inverse(monkeypatch, noise):
    counts = lengths("/root/testdata/sf0.01")
    classes, sizes = packing.length_classes(counts, 256)
    demand = np.bincount(classes[classes >= 0], counts[classes >= 0]).astype(int)
    exact, rng, calls = np.linalg.inv, np.random.default_rng(2), [0]

    def inv(a):
        calls[0] += 1
        if noise == "singular":
            if calls[0] % 5 == 3:
                raise np.linalg.LinAlgError("Singular matrix")
            return exact(a)
        return exact(a) * (1 + noise * rng.standard_normal(a.shape))

    monkeypatch.setattr(np.linalg, "inv", inv)
    monkeypatch.setattr(packing, "FRESH", 7)
    check_patterns(sizes, demand, 4096)
    assert calls[0] > 5


def test_short_texts_fill_their_sequences():
    for sizes, demand in (([9], [100_000]), (list(range(9, 41)), [997 + 31 * k for k in range(32)])):
        sizes, demand = np.array(sizes), np.array(demand)
        used, _ = check_patterns(sizes, demand, 4096)
        assert used <= demand @ sizes / 4096 * 1.003 + 1


def test_archives(spark, data, duck, tmp_path):
    same_rows(warc.op8_warc(spark, data), duck, warc.OP8_SQL)
    rows = [(7, "http://a/1", "x"), (3, "http://a/2\r\nEvil: 1", "x"), (9, None, None), (8, "u", ""), (1, "u", "WARC/1.1\r\n\r\nbody\r\n\r\n"), (None, "n", "x"), (3, "http://a/2\r\nEvil: 1", "x"), (20, "big", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    seen = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str)
    kinds = {7: ("revisit", 3), 3: ("response", None), 9: ("revisit", 8), 8: ("response", None), 1: ("response", None), None: ("response", None), 20: ("response", None)}
    assert seen == sorted(((i, len((h or "").encode()), *kinds[i]) for i, _, h in rows), key=str)
    digest = {r.page_id: r.payload_digest for r in got}
    assert all(digest[i] == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, _, h in rows)
    warc.write_archives(pages, str(tmp_path / "large"), least_bytes=2)
    assert {r.page_id for r in warc.read_archives(spark, str(tmp_path / "large")).collect() if r.record_type == "revisit"} == set()
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def brute_top(rows, asked, k):
    def ints(v):
        return [int(np.floor(256 * float(x))) for x in v]

    sound = [(i, ints(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sound:
        if q in asked:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in sound if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark, data, duck):
    same_rows(topk.op10_topk(spark, data), duck, topk.OP10_SQL)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(12)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (None, [1.0]), (204, []), (205, [1e6, -1e6]), (206, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("score", F.lit("clash"))
    for k in (1, 5, 100):
        asked = {0, 50, 100, 204, 205}
        got = sorted(tuple(r) for r in topk.top_k(frame, frame.where(F.col("vec_id").isin(*asked)), k).collect())
        assert got == brute_top(rows, asked, k)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_top_k_makes_fewer_products(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 48))
    near = [(i, (centres[i % 30] + rng.normal(size=48) * 0.4).tolist()) for i in range(3000)]
    flat = [(i, rng.normal(size=48).tolist()) for i in range(3000)]
    for rows, most in ((near, 0.6), (flat, 1.0)):
        frame, made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), []
        asked = {i for i, _ in rows if i % 50 == 0}
        got = topk.top_k(frame, frame.where("vec_id % 50 = 0"), products=made).collect()
        assert len(made) == 2 and sum(made) < most * len(asked) * len(rows) * 48
        few = {0, 950, 2950}
        assert sorted(tuple(r) for r in got if r.query_id in few) == brute_top(rows, few, 5)


def test_quality_model_held_out(spark):
    docs, labels = "/root/testdata/sf0.01/documents.parquet", "/root/testdata/sf0.01/labels.parquet"
    got = quality_model.op6_quality_model(spark, "/root/testdata/sf0.01")
    marked = got.join(spark.read.parquet(labels), "doc_id").where("held_out").collect()
    assert got.count() == spark.read.parquet(docs).count()
    assert np.mean([r.predicted == r.quality for r in marked]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())


def brute_features(text):
    words = (text or "").encode().split()
    codes = quality_model.codes_of(words)
    singles = [s for w in words for s in quality_model.features(w)]
    pairs = [int(quality_model.pair_slots(codes[k : k + 2])[0]) for k in range(len(words) - 1)]
    return singles + pairs + [quality_model.AGAIN for k in range(len(words) - 1) if words[k] == words[k + 1]]


def brute_chance(model, text):
    """The softmax of the mean vector, feature by feature."""
    found = brute_features(text)
    mean = sum((model.vectors[s] for s in found), np.zeros(quality_model.DIMS)) / max(1, len(found))
    p = np.exp(model.output @ mean + model.bias)
    return p[1] / p.sum()


def test_quality_gradients_and_scores(spark, monkeypatch):
    good, bad = "the cat sat on the mat and the dog", "mat the the dog sat cat on and the"
    model = quality_model.Model().fit([good, bad, "some more words", good + " again"] * 5, [1, 0, 1, 0] * 5)
    slots, share = quality_model._bag(good.encode().split(), {})
    assert dict(zip(slots.tolist(), share, strict=True)) == pytest.approx({s: brute_features(good).count(s) / len(brute_features(good)) for s in brute_features(good)})

    def loss(label):
        return -np.log(model.chances(slots, share)[label])

    for label in (0, 1):
        by_vectors, by_output, by_bias = model.gradients(slots, share, label)
        for array, at, slope in ((model.vectors, (slots[3], 2), by_vectors[3, 2]), (model.vectors, (slots[-1], 7), by_vectors[-1, 7]), (model.output, (1, 4), by_output[1, 4]), (model.bias, (0,), by_bias[0])):
            had, step = array[at], 1e-6
            array[at] = had + step
            above = loss(label)
            array[at] = had - step
            below = loss(label)
            array[at] = had
            assert (above - below) / (2 * step) == pytest.approx(slope, abs=1e-7)

    monkeypatch.setattr(quality_model, "MEMO_WORDS", 3)
    texts = [good, bad, None, " ", "one", "long " * 90_000, good]
    docs = make(spark, [(k, t, "s") for k, t in enumerate(texts)]).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    assert got == {k: pytest.approx(brute_chance(model, t), abs=1e-9) for k, t in enumerate(texts)}
    assert got[0] == got[6] and got[0] - got[1] > 1e-3  # the order of words counts


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "SAMPLE_ROWS", 6)
    docs = make(spark, [(k % 3, f"text {k}", "s") for k in range(60)])
    seen = []
    monkeypatch.setattr(quality_model.Model, "fit", lambda self, texts, labels: seen.append(len(texts)) or self)
    quality_model.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, quality int"))
    assert seen[0] <= 6


def test_quality_model_edges(spark):
    docs = make(spark, [(1, None, "s"), (2, "", "s"), (3, "good words", "s"), (3, "good words", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.score(docs, quality_model.fit(docs, none)).collect()} == {0.5}
    one_class = spark.createDataFrame([(3, 1), (1, None), (2, 7)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_model.score(docs, quality_model.fit(docs, one_class)).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert quality_model.score(docs.limit(0), quality_model.Model()).count() == 0


def brute_fusion(rows, n):
    out = []
    sums = {}
    for host, declared, p in rows:
        parts = host.split(".")
        keys = [("host", host), ("domain", ".".join(parts[-2:]) if len(parts) > 1 else host), ("suffix", parts[-1] if "." in host else ""), ("declared", declared), ("all", "")]
        for k in keys:
            sums[k] = sums.get(k, np.zeros(n)) + np.array(p)
        out.append((keys, np.array(p)))
    result = []
    for keys, p in out:
        c = {k: np.maximum(sums[k, v] - p, 0) for k, v in keys}
        base = (c["all"] + 1) / (c["all"].sum() + n)
        prior = base
        for level in ("suffix", "domain", "host"):
            prior = (c[level] + 5 * prior) / (c[level].sum() + 5)
        said = (c["declared"] + 5 * base) / (c["declared"].sum() + 5) / base
        post = prior * said * p
        result.append(post / post.sum())
    return result


def test_language_fusion(spark):
    rng = np.random.default_rng(5)
    rows = [(k, str(rng.choice(["a.x.de", "b.x.de", "c.fr", "", "solo"])), str(rng.choice(["", "de", "fr"])), rng.dirichlet(np.ones(3)).tolist()) for k in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, host string, declared string, text_p array<double>")
    names = ["de", "en", "fr"]
    got = {r.page_id: (r.lang, r.confidence) for r in language_id.fuse(frame, names).collect()}
    for (k, *_), p in zip(rows, brute_fusion([r[1:] for r in rows], 3), strict=True):
        assert got[k] == (names[int(p.argmax())], pytest.approx(p.max()))


def test_language_pages(spark, data):
    got = language_id.op9_language_id(spark, data)
    url = spark.read.parquet(f"{data}/pages.parquet").select("page_id", F.regexp_extract("url", "//[^/]*/([a-z]+)/", 1).alias("path"))
    rows = got.join(url, "page_id").collect()
    assert np.mean([r.lang == r.path for r in rows]) > 0.97
    docs = make(spark, [(1, "the cat", "s")])
    pages = spark.createDataFrame([(1, None, None), (None, "http://h.de/x", "")], "page_id long, url string, html string")
    assert language_id.identify(pages, docs).count() == 2
    assert [r.lang for r in language_id.identify(pages, docs.limit(0)).collect()] == [None, None]
