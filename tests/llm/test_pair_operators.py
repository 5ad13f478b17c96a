"""Jaccard join, passage removal, vector search, near-duplicate vectors, language model, pipeline: brute force and edges."""

import hashlib
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from granthi.llm import attention_lm, common, components, embedding_dups, jaccard_join, substring_dedup, top_products

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "b", 0), (3, "the end of it", "en", "a", 3), (3, "the end of it", "en", "a", 3),
       (None, "no id here", None, "b", 4), (5, "long " * 70000, "en", None, 5), (6, "the end of it", "fr", "a", 6)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def near_copies(seed, n):
    """Random texts with exact copies, near copies and shared passages."""
    g = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [g.choices(words, k=60) for _ in range(4)]
    texts = []
    for _ in range(n):
        if texts and g.random() < 0.4:
            text = list(g.choice(texts))
            for _ in range(g.randint(0, 4)):
                if text:
                    text[g.randrange(len(text))] = g.choice(words)
        else:
            text = g.choices(words, k=g.choice([0, 1, 3, 5, 19, 20, 21, 90, 160]))
            if g.random() < 0.4:
                at = g.randint(0, len(text))
                text[at:at] = g.choice(shared)
        texts.append(text)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


def shingles(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_jaccard_join_equals_brute_force(spark):
    docs = near_copies(1, 500)
    sets = {i: shingles(t) for i, t in docs}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = Counter(x for p in pairs for x in p)
    want = classes(pairs, sets)
    got = jaccard_join.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, want[i], links[i]) for i in sets}


def test_jaccard_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(base[:i % 60] + [f"x{i}"] + base[i % 60 + 1:])) for i in range(50)]
    sets = {i: shingles(t) for i, t in docs}
    links = {a: sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    got = jaccard_join.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == links and {r.class_id for r in got} == {0}


def test_jaccard_edges(odd):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.similar_documents(odd).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 2), (3, 3, 2), (5, 5, 0), (6, 3, 2), (None, None, 0)], key=str)
    assert jaccard_join.similar_documents(odd.limit(0)).count() == 0


def test_prefixes_are_shortened_until_the_recall():
    for s in (0.5, 0.8, 0.95):
        d = jaccard_join.depth_for(s)
        assert d == 1 or 1 - (1 - s ** d) ** jaccard_join.TREES >= jaccard_join.RECALL
        assert d == jaccard_join.DEPTH or 1 - (1 - s ** (d + 1)) ** jaccard_join.TREES < jaccard_join.RECALL


def removed(docs):
    seen, out = {}, {}
    for i, text in sorted(docs):
        words = text.split()
        for p in range(len(words) - 19):
            seen.setdefault(tuple(words[p:p + 20]), (i, p))
    for i, text in docs:
        words = text.split()
        gone = set()
        for p in range(len(words) - 19):
            if seen[tuple(words[p:p + 20])] < (i, p):
                gone |= set(range(p, p + 20))
        out[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


def test_passages_equal_brute_force(spark):
    docs = near_copies(2, 300) + [(5000, "a b " * 200), (5001, " ".join(f"q{i % 37}" for i in range(300)))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == removed(docs)


def test_cover_has_every_difference():
    cover = substring_dedup.COVER
    assert {(a - b) % substring_dedup.PERIOD for a in cover for b in cover} == set(range(substring_dedup.PERIOD))


def test_places_beyond_the_last(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LAST_PLACE", 63)
    docs = near_copies(3, 60)
    batch = spark.createDataFrame(docs, "doc_id long, text string").toArrow().combine_chunks().to_batches()[0]
    places = np.concatenate([np.asarray(b.column(0)) & 63 for b in substring_dedup._anchors(batch)])
    assert places.max() == 63


def test_passage_edges(odd):
    got = substring_dedup.remove_repeats(odd, keep=("source",)).collect()
    assert len(got) == len(ODD) and {r.n_removed for r in got if r.doc_id != 5} == {0}
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_words, long.n_removed) == (70000, 69999)  # all but the first word lie in a window that starts again
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def random_vectors(seed, n=400, dims=24):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dims))
    for i in range(0, n, 4):  # near and exact copies
        x[i + 1] = x[i] + g.normal(size=dims) * 0.08
        x[i + 2] = x[i] if i % 8 else 2 * x[i]
    x *= np.exp(g.normal(size=(n, 1)))
    return x.astype(np.float32)


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_products, "BUCKET", 32)
    monkeypatch.setattr(top_products, "QUERY_BLOCK", 5)
    monkeypatch.setattr(top_products, "PILOT_ROWS", 60)
    x = random_vectors(7)
    q = np.floor(256 * x.astype(np.float64))
    score = q @ q.T
    want = set()
    for i in range(0, len(x), 20):
        best = sorted((-score[i, j], j) for j in range(len(x)) if j != i)[:5]
        want |= {(i, r + 1, j, int(-s)) for r, (s, j) in enumerate(best)}
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    got = {tuple(r) for r in top_products.top_products(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == want


def odd_vectors(spark):
    return spark.createDataFrame([
        (0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], None), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1),
        (6, [2.0, 0.0], 2), (6, [2.0, 0.0], 2), (None, [1.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1), (8, [], 1), (9, [-1.0, 0.0], 1)], VECTORS)


def test_top_products_edges(spark):
    got = sorted(tuple(r) for r in top_products.top_products(odd_vectors(spark), F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 6, 512 * 256), (0, 2, 6, 512 * 256), (0, 3, 2, 0), (0, 4, 9, -256 * 256)]
    assert top_products.top_products(odd_vectors(spark).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dups, "BLOCK", 16)
    x = random_vectors(8).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = common.local_components(linked)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))], VECTORS)
    got = {r.vec_id: r for r in embedding_dups.near_duplicates(df).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.97 * linked.sum()
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.97
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_near_vectors_recall_at_the_threshold():
    g = np.random.default_rng(3)
    x, z = g.normal(size=(2, 2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
    hashes, tables = embedding_dups.plan(50_000, 64)
    a, b = (embedding_dups.bucket_keys(v, hashes, tables) for v in (x, y))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.95


def test_near_vector_edges(spark):
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dups.near_duplicates(odd_vectors(spark)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 7, 8, 9)]
    assert got == sorted([(0, 2, 0, True), (6, 2, 0, False), (6, 2, 0, False), (None, 0, None, False), *alone], key=str)
    assert embedding_dups.near_duplicates(odd_vectors(spark).limit(0)).count() == 0


def test_components(spark):
    g = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(300, 400)] + [(g.randint(0, 90), g.randint(0, 90)) for _ in range(60)]
    want = classes(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    got = components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def scored(spark, sf):
    return entry.queries()["op9_lm_score"](spark, sf).toPandas()


def test_base_scores_equal_definition(spark, sf, scored):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = {r.doc_id: [*(r.text or "").encode().translate(lower).split(), None] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in scored.itertuples():
        words = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0


def test_model_learns_held_out_words(scored):
    held = scored[scored.held_out]
    per_word = held.score.sum() / held.n_tokens.sum()
    assert per_word > -5.5  # ids drawn evenly would give about -10 a word


def test_each_token_is_scored_once_with_its_context():
    g = np.random.default_rng(1)
    model = attention_lm.AttentionModel(50)
    model.emit = g.dirichlet(np.ones(50), attention_lm.STATES).T.astype(np.float32)
    ids = g.integers(3, 50, 150).astype(np.int32)
    s = attention_lm.Stream(np.zeros(3, np.uint64), np.array([0, 70, 71]), ids, np.array([0, 1, 2, 3]), np.array([0, 70, 71, 150]))
    windows = attention_lm.Windows(s, 1)
    got, _ = model.log_probabilities(windows, np.full(150, -1, np.int32))
    for begin, end in ((0, 70), (70, 71), (71, 150)):
        for place in range(begin, end):
            first = begin + (place - begin) // attention_lm.SCORED * attention_lm.SCORED
            w = [begin + k * attention_lm.SCORED for k in range(9)].index(first)
            which = np.flatnonzero(windows.start == first)
            inputs, own, targets, _ = windows.take(which)
            row = place - first
            inputs, own = inputs.copy(), own.copy()
            inputs[:, attention_lm.CONTEXT + row + 1:] = 0  # what comes later must not matter
            states, _ = model.forward(inputs, own)
            assert got[place] == pytest.approx(float(np.log(states[0, row] @ model.emit[ids[place]])), abs=1e-4) and w >= 0


def test_gradients_agree_with_differences():
    g = np.random.default_rng(2)
    model = attention_lm.AttentionModel(20)
    model.emit = g.dirichlet(np.ones(20), attention_lm.STATES).T.astype(np.float32)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids = g.integers(0, 20, 64).astype(np.int32)
    s = attention_lm.Stream(np.zeros(1, np.uint64), np.array([0]), ids, np.array([0, 1]), np.array([0, 64]))
    inputs, own, targets, scored = attention_lm.Windows(s, 1).take(np.array([0, 1]))

    def loss():
        states, kept = model.forward(inputs, own)
        joint = states * model.emit[targets]
        return -np.log(joint.sum(axis=-1))[scored].sum(), states, joint, kept

    _, states, joint, kept = loss()
    grads = model.gradients(inputs, kept, np.where(scored[:, :, None], states - joint / joint.sum(axis=-1, keepdims=True), 0))
    for name in ("query", "key", "value", "mixed", "own", "states", "place", "embed"):
        at = tuple(g.integers(0, n) for n in model.weights[name].shape) if name != "embed" else (ids[3], 5)
        before = model.weights[name][at]
        model.weights[name][at] = before + 1e-4
        up = loss()[0]
        model.weights[name][at] = before - 1e-4
        down = loss()[0]
        model.weights[name][at] = before
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-3)


def test_output_tables_take_every_token_with_its_context():
    g = random.Random(4)
    texts = [" ".join(g.choices(["tree", "of", "the", "house", "unbelievable"], k=k)) for k in (700, 30, 1)] + [None]
    coder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = attention_lm.AttentionModel(coder.get_piece_size())
    model.emit = np.random.default_rng(4).dirichlet(np.ones(len(model.emit)), attention_lm.STATES).T.astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(4), pa.int64())], ["text", "h"])
    sent = SimpleNamespace(value=(model, coder.serialized_model_proto(), np.zeros(0, np.uint64)))
    got = np.zeros(model.emit.shape)
    for part in attention_lm._gather(sent, len(model.emit))(iter([batch])):
        got[np.asarray(part.column(0))] += np.asarray(part.column(1).flatten()).reshape(-1, attention_lm.STATES)
    s = attention_lm.stream(common.text_bytes(batch.column(0)), coder)
    windows = attention_lm.Windows(s, coder.bos_id())
    inputs, own, targets, scored = windows.take(np.arange(len(windows.start)))
    joint = model.forward(inputs, own)[0] * model.emit[targets]
    want = np.zeros(model.emit.shape)
    np.add.at(want, targets[scored], (joint / joint.sum(axis=-1, keepdims=True))[scored])
    assert got.sum(axis=1) == pytest.approx(np.bincount(s.ids, minlength=len(got)), abs=1e-2)
    assert got == pytest.approx(want, abs=1e-2)


def test_weights_and_share_come_from_all_training_documents(spark, monkeypatch):
    texts = [" ".join(random.Random(i).choices(["tree", "of", "the", "house", f"w{i}"], k=40 + i)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    starts, fit = [], attention_lm.AttentionModel.fit

    def started(self, windows, **more):
        fit(self, windows, rounds=20)
        starts.append((len(windows.start), {k: v.copy() for k, v in self.weights.items()}))

    monkeypatch.setattr(attention_lm.AttentionModel, "fit", started)
    monkeypatch.setattr(attention_lm, "SAMPLE_DOCS", 4)
    learned = attention_lm.fit(docs, F.lit(True), MODEL)
    sample, start = starts[0]
    coder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    s = attention_lm.stream(common.text_bytes(pa.array(texts)), coder)
    windows = attention_lm.Windows(s, coder.bos_id())
    assert sample < len(windows.start) / 2
    # Ids that only documents outside the sample hold have moved, and so has every dense weight.
    moved = (learned.model.weights["embed"] != start["embed"]).any(axis=1)
    assert moved[np.unique(windows.inputs)].all()
    for name in ("query", "key", "value", "mixed", "own", "states", "place"):
        assert (learned.model.weights[name] != start[name]).any() and np.abs(learned.model.weights[name] - start[name]).max() < 0.1
    assert learned.model.share == pytest.approx(len(s.hashes) / (len(s.hashes) + learned.distinct))


def test_model_edges(odd):
    learned = attention_lm.fit(odd, F.col("doc_id") < 6, MODEL)
    rows = attention_lm.score(odd, learned).collect()
    assert len(rows) == len(ODD) and all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2))
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    nothing = attention_lm.fit(odd.limit(0), F.lit(True), MODEL)
    rows = attention_lm.score(odd, nothing).collect()
    assert {r.base_score for r in rows} == {0.0} and all(math.isfinite(r.score) for r in rows)
    assert attention_lm.score(odd.limit(0), learned).count() == 0


def test_pipeline_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "jaccard_join", "substring_dedup", "mixing", "sentencepiece"]
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        outs[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before = {r.doc_id: r.text for r in outs["language_id"]}
    sets = {i: shingles(t) for i, t in before.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in outs["jaccard_join"]} == set(classes(pairs, sets).values())
    kept = [(r.doc_id, r.text) for r in outs["jaccard_join"]]
    want = {i: k for i, (n, gone, k) in removed(kept).items() if gone < n}
    assert {r.doc_id: " ".join(r.text.split()) for r in outs["substring_dedup"]} == want
    assert {r.doc_id for r in outs["mixing"]} <= set(want) and len(outs["sentencepiece"]) == len(outs["mixing"])
    words = sum(len(t.split()) for t in want.values())
    mixed = sum(len(r.text.split()) for r in outs["mixing"])
    longest = max(len(t.split()) for t in want.values())
    assert abs(mixed - 1.5 * words) <= 20 * longest
    final = entry.queries()["pipeline"](spark, sf)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, outs["sentencepiece"]))


def test_pipeline_edges(spark, odd, sf):
    for docs in (odd, odd.limit(0), odd.withColumns({"size": F.lit(1), "order": F.lit("x"), "lang_pred": F.lit(1), "__text": F.lit(2)})):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        digests = {r.decoded_sha256 for r in docs.collect()}
        assert hashlib.sha256(b"").hexdigest() not in digests
