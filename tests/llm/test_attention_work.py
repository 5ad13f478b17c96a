"""What a task of the language model does once instead of once a step, against plain ways."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from granthi.llm import attention_lm

MODEL = public_tokenizers.path("piece_bpe_32k.model")


class Counting:
    """A coder that notes the words it encodes."""

    def __init__(self):
        self.coder, self.seen = sentencepiece.SentencePieceProcessor(model_file=MODEL), []

    def encode(self, words, num_threads=1):
        self.seen += words
        return self.coder.encode(words, num_threads=num_threads)

    def __getattr__(self, name):
        return getattr(self.coder, name)


def test_a_task_encodes_each_word_once(monkeypatch):
    texts = ["The tree of the house", "the House of a tree", None, "a tree, a house " * 20, ""]
    coder = Counting()
    plain = [attention_lm.stream([np.frombuffer((t or "").encode(), np.uint8)], coder.coder).ids for t in texts]
    monkeypatch.setattr(attention_lm, "STEP", 8)  # a text is a step
    monkeypatch.setattr(attention_lm, "_coder", lambda proto: coder)
    streams, stream = [], attention_lm.stream
    monkeypatch.setattr(attention_lm, "stream", lambda *a: streams.append(stream(*a)) or streams[-1])
    model = attention_lm.AttentionModel(coder.get_piece_size())
    sent = SimpleNamespace(value=(model, b"", np.zeros(0, np.uint64)))
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"]) for part in (texts[:2], texts[2:])]
    list(attention_lm._gather(sent, len(model.emit))(iter(batches)))
    assert sorted(coder.seen) == sorted({w for t in texts for w in (t or "").lower().split()})
    assert np.concatenate([s.ids for s in streams]).tolist() == np.concatenate(plain).tolist()


def test_forgotten_words_are_encoded_again(monkeypatch):
    texts = [np.frombuffer(t.encode(), np.uint8) for t in ("a tree of a house", "a tree", "house of tree")]
    coder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = attention_lm.stream(texts, coder)
    monkeypatch.setattr(attention_lm, "KEPT_IDS", 2)
    spelled = attention_lm.Spelled(coder)
    got = [attention_lm.stream([t], spelled) for t in texts]
    assert np.concatenate([s.ids for s in got]).tolist() == want.ids.tolist()


def test_sums_by_id():
    g = np.random.default_rng(5)
    for n in (0, 1, 7, 500):
        ids, rows = (40 * g.random(n) ** 3).astype(np.int32), g.integers(0, 9, (n + 3, 4)).astype(np.float32)
        which = g.permutation(n + 3)[:n]
        want = np.zeros((40, 4), np.float32)
        np.add.at(want, ids, rows[which])
        different, sums = attention_lm.summed_by(ids, rows, which)
        got = np.zeros((40, 4), np.float32)
        got[different] = sums
        assert len(set(different.tolist())) == len(different) and got.tolist() == want.tolist()


def test_word_hashes_depend_on_the_bytes_alone():
    g = np.random.default_rng(6)
    words = {g.integers(97, 100, n).astype(np.uint8).tobytes() for n in [*range(1, 40), 127, 128, 129, 1000] for _ in range(20)}
    words |= {b"a", b"a\0", b"\0", b"\0" * 8, b"\0" * 9, "été".encode()}
    seen = {}
    for pad in range(9):
        for word in words:
            data = np.frombuffer(b" " * pad + word + b"zz", np.uint8)
            h = int(attention_lm.hash_of_words(data, np.array([pad]), np.array([pad + len(word)]))[0])
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(words)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    assert attention_lm.hash_of_words(data, ends - [len(w) for w in words], ends).tolist() == [seen[w] for w in words]


def test_a_unit_counts_for_the_id_it_starts_with():
    coder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "the tree of the house and the trees of unbelievable houses " * 30
    model = attention_lm.AttentionModel(coder.get_piece_size())
    model.emit = np.random.default_rng(4).dirichlet(np.ones(len(model.emit)), attention_lm.STATES).T.astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    hashes = attention_lm.hashed_words([np.frombuffer(text.encode(), np.uint8)])[3]

    def sums(tops):
        size = len(model.emit) + len(tops)
        out = np.zeros((size, attention_lm.STATES))
        sent = SimpleNamespace(value=(model, coder.serialized_model_proto(), tops))
        for part in attention_lm._gather(sent, size)(iter([batch])):
            out[np.asarray(part.column(0))] += np.asarray(part.column(1).flatten()).reshape(-1, attention_lm.STATES)
        return out

    tops = np.unique(hashes)[:4]
    alone, both = sums(np.zeros(0, np.uint64)), sums(tops)
    assert both[: len(alone)] == pytest.approx(alone, abs=1e-3)
    assert both[len(alone):].sum(axis=1) == pytest.approx([(hashes == t).sum() for t in tops], abs=1e-2)
