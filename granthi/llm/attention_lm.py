"""Scoring of texts by a small causal self-attention model over subword ids, trained in numpy.

Model. One attention head over windows of ``CONTEXT + SCORED`` inputs, a hidden layer, and ``STATES`` mixture weights g at each
place; the next id has probability sum_k g_k B[k, id]. B has a distribution over all ids per state, so a token costs
a few hundred operations whatever the vocabulary. A word's probability is the product over its ids, mixed with the share
of the word among all training tokens if it is a frequent one (``share`` times that, 1 - share times the model).

Learning. A start is fitted by Adam on a hash-chosen sample of at most about ``SAMPLE_DOCS`` training documents, so that all tasks mean
the same by a state. From it each task goes on over every window of its training documents once, and the weights of the tasks are
averaged, each as often as it has windows. The same pass sums the expected states of ids and words over every window, each id with the
context with which it would be scored, per task and then over tasks: B and W. Word counts and the share of the units (the frequent
words' part of all training tokens, with room for new words) cover the corpus as well. The averaged weights depend on how rows are dealt to tasks.

Scoring. Windows overlap by ``CONTEXT`` inputs and each token is scored once, in the window where it has at least that
much of its text before it (or the text's beginning). Masked attention runs over many windows at once.

Counts. Words are counted by 64-bit hash, summed per step before they are shuffled. Words with at least
1 / ``FREQUENT`` of all tokens are at most ``FREQUENT`` many, so their table goes to all tasks; the others of a document meet their
counts in a join on the hash.

Null is the empty text: its one token is the end. Without training documents every id is equally likely.
Rows are independent; repeated rows are scored each. Rows with a null id are scored and not learned from.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthi.llm.common import U64, map_batches, mix, steps, text_bytes, word_hashes, word_spans
from granthi.session import materialise

CONTEXT, SCORED = 16, 32
WIDTH, HIDDEN, STATES = 16, 32, 64
SAMPLE_DOCS = 600
TRAIN_STEPS = 400
ROUND = 1024
RATE = 0.003
FREQUENT = 1 << 20
TOP = 1 << 14
STEP = 3 << 20
CHUNK = 128
LONG = 128
KEPT_IDS = 1 << 22
END_HASH = U64(0x9AE16A3B2F90404F)

_CAUSAL = (np.arange(CONTEXT + SCORED)[None, :] <= CONTEXT + np.arange(SCORED)[:, None]).astype(np.float32)


@dataclass
class Stream:
    """Words of texts as ids. Each text's words are followed by its end."""

    hashes: np.ndarray  # of each word or end
    word_starts: np.ndarray  # where each word's ids begin in ``ids``
    ids: np.ndarray
    text_words: np.ndarray  # where each text's words begin in ``hashes`` (one more than texts)
    text_ids: np.ndarray  # where each text's ids begin in ``ids`` (one more than texts)


def lower(data: np.ndarray) -> np.ndarray:
    return data + (((data - np.uint8(0x41)) < 26).view(np.uint8) << 5)


def hash_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: eight bytes at a time, and by prefix sums where a span is ``LONG`` or more."""
    lanes = np.append(data, np.zeros(16 - len(data) % 8, np.uint8)).view(U64)
    lengths = ends - starts
    out = mix(lengths.astype(U64) + U64(1))
    short = np.flatnonzero(lengths < LONG)
    done = 0
    while len(short):
        at = starts[short] + done
        lane, shift = at >> 3, (at & 7).astype(U64) << U64(3)
        eight = lanes[lane] >> shift
        later = shift > 0
        eight[later] |= lanes[lane[later] + 1] << (U64(64) - shift[later])
        left = lengths[short] - done
        cut = left < 8
        eight[cut] &= (U64(1) << (left[cut].astype(U64) << U64(3))) - U64(1)
        out[short] = mix(out[short] ^ mix(eight + U64(done + 1)))
        done += 8
        short = short[left > 8]
    far = np.flatnonzero(lengths >= LONG)
    if len(far):
        stops = np.cumsum(lengths[far])
        out[far] = word_hashes(np.concatenate([data[a:b] for a, b in zip(starts[far], ends[far])]), stops - lengths[far], stops)
    return out


def hashed_words(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, first word of each text) with A-Z lower-cased."""
    blank = np.array([0x20], np.uint8)
    data = lower(np.concatenate([part for t in texts for part in (t, blank)]))
    starts, ends = word_spans(data)
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    return data, starts, ends, hash_of_words(data, starts, ends), firsts.astype(np.int64)


class Spelled:
    """Ids of the words met so far, so that a task encodes a word once; beyond ``KEPT_IDS`` ids it begins anew."""

    def __init__(self, coder: sentencepiece.SentencePieceProcessor) -> None:
        self.coder = coder
        self.forget()

    def forget(self) -> None:
        """Only the end is known."""
        self.hashes, self.begin, self.count = np.array([END_HASH]), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([self.coder.eos_id()], np.int32)

    def learn(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode those of the different words that are new."""
        if len(self.flat) > KEPT_IDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        new = np.flatnonzero(self.hashes[at] != hashes)
        if not len(new):
            return
        pieces = self.coder.encode([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())], num_threads=1)
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(pieces), np.int32, count.sum())])
        both = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(both, kind="stable")
        self.hashes = both[order]
        self.begin, self.count = np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids begin in ``flat``, how many) of known words."""
        at = np.searchsorted(self.hashes, hashes)
        return self.begin[at], self.count[at]


def stream(texts: list[np.ndarray], coder: sentencepiece.SentencePieceProcessor | Spelled) -> Stream:
    """Every distinct word is encoded once; occurrences are gathered."""
    spelled = coder if isinstance(coder, Spelled) else Spelled(coder)
    data, starts, ends, hashes, firsts = hashed_words(texts)
    different, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    spelled.learn(different, data.tobytes(), starts[at], ends[at])
    begin, lengths = spelled.find(np.append(different, END_HASH))
    word = np.insert(inverse, firsts[1:], len(different))
    count = lengths[word]
    word_starts = np.concatenate([[0], np.cumsum(count)])
    ids = spelled.flat[np.repeat(begin[word] - word_starts[:-1], count) + np.arange(word_starts[-1])]
    text_words = firsts + np.arange(len(firsts))
    return Stream(np.insert(hashes, firsts[1:], END_HASH), word_starts[:-1], ids, text_words, word_starts[text_words])


class Windows:
    """All windows of a stream: where their scored part begins, and their text's first and last place."""

    def __init__(self, s: Stream, bos: int) -> None:
        begin, end = s.text_ids[:-1], s.text_ids[1:]
        n = -(-(end - begin) // SCORED)
        self.text = np.repeat(np.arange(len(n)), n)
        self.number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.begin, self.end = begin[self.text], end[self.text]
        self.start = self.begin + self.number * SCORED
        self.inputs = np.concatenate([[bos], s.ids[:-1]]).astype(np.int32)
        self.inputs[begin[begin < len(s.ids)]] = bos
        self.targets = s.ids

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, input is of the text, targets, target is of the text) of some windows."""
        place = self.start[which][:, None] + np.arange(-CONTEXT, SCORED)
        own = (place >= self.begin[which][:, None]) & (place < self.end[which][:, None])
        place = np.clip(place, 0, len(self.targets) - 1)
        return self.inputs[place], own, self.targets[place[:, CONTEXT:]], own[:, CONTEXT:]


def summed_by(ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different ids, sum of their rows). Each id stands for the row at its place, or for that in ``which``.

    Rows of an id are added in pairs, then pairs of pairs, all ids at a time.
    """
    n = len(ids)
    key = (ids.astype(np.int64) << 32) | np.arange(n)
    key.sort()
    order, ids = key & 0xFFFFFFFF, key >> 32
    rows = rows.take(order if which is None else which[order], axis=0)
    starts = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), ids[1:] != ids[:-1]]))
    counts = np.diff(np.append(starts, n))
    left = np.repeat(counts, counts)  # rows of the id from this one on
    place = np.arange(n) - np.repeat(starts, counts)
    left -= place
    at, step = np.arange(n), 1
    while True:
        at = at[(place[at] & (2 * step - 1) == 0) & (left[at] > step)]
        if not len(at):
            return ids[starts], rows.take(starts, axis=0)
        rows[at] += rows.take(at + step, axis=0)
        step *= 2


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.steps = rate, 0
        self.first = {n: np.zeros_like(v) for n, v in weights.items()}
        self.second = {n: np.zeros_like(v) for n, v in weights.items()}

    def step(self, weights: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for name, d in gradients.items():
            first, second = self.first[name], self.second[name]
            first *= np.float32(0.9)
            first += np.float32(0.1) * d
            second *= np.float32(0.99)
            d = d * d
            d *= np.float32(0.01)
            second += d
            step = second / np.float32(1 - 0.99 ** self.steps)
            np.sqrt(step, out=step)
            step += np.float32(1e-6)
            np.divide(first, step, out=step)
            step *= np.float32(-self.rate / (1 - 0.9 ** self.steps))
            step += weights[name]
            weights[name] = step


class AttentionModel:
    def __init__(self, vocabulary: int, seed: int = 0) -> None:
        g = np.random.default_rng(seed)
        draw = lambda *shape: (g.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {
            "embed": (g.normal(size=(vocabulary, WIDTH)) * 0.5).astype(np.float32),
            "place": (g.normal(size=(CONTEXT + SCORED, WIDTH)) * 0.1).astype(np.float32),
            "query": draw(WIDTH, WIDTH), "key": draw(WIDTH, WIDTH), "value": draw(WIDTH, WIDTH),
            "mixed": draw(WIDTH, HIDDEN), "own": draw(WIDTH, HIDDEN), "bias": np.zeros(HIDDEN, np.float32),
            "states": draw(HIDDEN, STATES), "states_bias": np.zeros(STATES, np.float32),
        }
        self.emit = np.full((vocabulary, STATES), 1 / vocabulary, np.float32)
        self.units = np.zeros((0, STATES), np.float32)
        self.share = 0.0

    def infer(self, inputs: np.ndarray, own: np.ndarray, kept: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States without their common factor, and that factor. ``kept`` gets what ``gradients`` reads.

        All windows meet a weight in one product. Values have a column of ones, so one product reads them and sums the attention.
        Inputs that are not of the text lie before its first window or behind what is scored, so only the former are masked.
        """
        w = self.weights
        n = len(inputs)
        x = np.take(w["embed"], inputs, axis=0)
        x += w["place"]
        flat, late = x.reshape(-1, WIDTH), x[:, CONTEXT:].reshape(-1, WIDTH)
        q = (late @ (w["query"] * np.float32(WIDTH ** -0.5))).reshape(n, SCORED, WIDTH)
        kv = np.ones((n * (CONTEXT + SCORED), 2 * WIDTH + 1), x.dtype)
        kv[:, : 2 * WIDTH] = flat @ np.concatenate([w["key"], w["value"]], axis=1)
        kv = kv.reshape(n, CONTEXT + SCORED, -1)
        attention = q @ kv[:, :, :WIDTH].transpose(0, 2, 1)
        np.clip(attention, np.float32(-60), np.float32(60), out=attention)
        np.exp(attention, out=attention)
        attention *= _CAUSAL
        attention[~own[:, 0], :, :CONTEXT] = 0
        read = (attention @ kv[:, :, WIDTH:]).reshape(-1, WIDTH + 1)
        seen = np.empty((len(late), 2 * WIDTH), x.dtype)
        seen[:, :WIDTH] = late
        np.divide(read[:, :WIDTH], read[:, WIDTH:], out=seen[:, WIDTH:])
        hidden = seen @ np.concatenate([w["own"], w["mixed"]])
        hidden += w["bias"]
        np.tanh(hidden, out=hidden)
        states = hidden @ w["states"]
        states += w["states_bias"]
        if np.abs(w["states"]).sum(axis=0).max() + np.abs(w["states_bias"]).max() > 60:
            np.clip(states, np.float32(-60), np.float32(60), out=states)
        np.exp(states, out=states)
        if kept is not None:
            kept |= {"x": flat, "q": q, "kv": kv, "attention": attention, "total": read[:, WIDTH:], "seen": seen, "hidden": hidden}
        return states.reshape(n, SCORED, STATES), (states @ np.ones(STATES, states.dtype)).reshape(n, SCORED)

    def forward(self, inputs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        kept: dict[str, np.ndarray] = {}
        states, factor = self.infer(inputs, own, kept)
        states /= factor[:, :, None]
        return states, kept

    def gradients(self, inputs: np.ndarray, kept: dict[str, np.ndarray], wrong: np.ndarray) -> dict[str, np.ndarray]:
        """From d loss / d logits of the states, which is (states - expected states) at each scored token."""
        out, d_x = self.backward(kept, wrong)
        return out | {"embed": self.embed_gradient(inputs, d_x)}

    def embed_gradient(self, inputs: np.ndarray, d_x: np.ndarray) -> np.ndarray:
        ids, out = inputs.ravel().astype(np.intp), np.empty_like(self.weights["embed"])
        for i, column in enumerate(d_x.reshape(-1, WIDTH).T.astype(np.float64)):
            out[:, i] = np.bincount(ids, column, len(out))
        return out

    def backward(self, kept: dict[str, np.ndarray], wrong: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all weights but the embedding, and those of the inputs."""
        w = self.weights
        n, scale = len(kept["q"]), np.float32(WIDTH ** -0.5)
        wrong, hidden, seen, kv = wrong.reshape(-1, STATES), kept["hidden"], kept["seen"], kept["kv"]
        out = {"states": hidden.T @ wrong, "states_bias": np.ones(len(wrong), wrong.dtype) @ wrong}
        d = wrong @ w["states"].T
        d *= 1 - hidden * hidden
        from_seen = seen.T @ d
        out |= {"own": from_seen[:WIDTH], "mixed": from_seen[WIDTH:], "bias": d.sum(axis=0)}
        d_seen = d @ np.concatenate([w["own"], w["mixed"]]).T
        # The attention is kept without its sum: the derivative of that sum is one more column.
        d_read = np.empty((len(d), WIDTH + 1), d.dtype)
        np.divide(d_seen[:, WIDTH:], kept["total"], out=d_read[:, :WIDTH])
        d_read[:, WIDTH] = -np.vecdot(d_read[:, :WIDTH], seen[:, WIDTH:])
        d_read = d_read.reshape(n, SCORED, -1)
        d_scores = d_read @ kv[:, :, WIDTH:].transpose(0, 2, 1)
        d_scores *= kept["attention"]
        d_query = (d_scores @ kv[:, :, :WIDTH]).reshape(-1, WIDTH)
        d_kv = np.empty((n, CONTEXT + SCORED, 2 * WIDTH), d.dtype)
        d_kv[:, :, :WIDTH] = d_scores.transpose(0, 2, 1) @ kept["q"]
        d_kv[:, :, WIDTH:] = kept["attention"].transpose(0, 2, 1) @ d_read[:, :, :WIDTH]
        d_kv = d_kv.reshape(-1, 2 * WIDTH)
        from_x = kept["x"].T @ d_kv
        out |= {"query": seen[:, :WIDTH].T @ d_query * scale, "key": from_x[:, :WIDTH], "value": from_x[:, WIDTH:]}
        d_x = (d_kv @ np.concatenate([w["key"], w["value"]], axis=1).T).reshape(n, CONTEXT + SCORED, WIDTH)
        d_x[:, CONTEXT:] += (d_seen[:, :WIDTH] + d_query @ (w["query"].T * scale)).reshape(n, SCORED, WIDTH)
        out["place"] = d_x.sum(axis=0)
        return out, d_x

    def fit(self, windows: Windows, rounds: int = TRAIN_STEPS, batch: int = 64, rate: float = 0.02, seed: int = 1) -> None:
        """Adam for the weights; the emissions follow the expected states by moving averages."""
        g = np.random.default_rng(seed)
        vocabulary = len(self.emit)
        plain = np.bincount(windows.targets, minlength=vocabulary).astype(np.float32) + 0.1
        counts = plain[:, None] * g.gamma(1.0, size=(vocabulary, STATES)).astype(np.float32)
        counts *= batch * SCORED / counts.sum()
        self.emit = counts / counts.sum(axis=0)
        adam = Adam(self.weights, rate)
        for _ in range(rounds):
            inputs, own, targets, scored = windows.take(g.integers(0, len(windows.start), batch))
            states, kept = self.forward(inputs, own)
            joint = states * self.emit[targets]
            expected = joint / np.maximum(joint.sum(axis=-1, keepdims=True), 1e-30)
            wrong = np.where(scored[:, :, None], states - expected, 0).astype(np.float32) / scored.sum()
            adam.step(self.weights, self.gradients(inputs, kept, wrong))
            counts *= np.float32(0.97)
            np.add.at(counts, targets[scored], expected[scored].astype(np.float32))
            smooth = counts + counts.sum(axis=0) * (plain / plain.sum())[:, None] * np.float32(0.02)
            self.emit = smooth / smooth.sum(axis=0)

    def expected_states(self, windows: Windows, which: np.ndarray, units: np.ndarray, out: np.ndarray, firsts: np.ndarray,
                        adam: Adam | None = None) -> None:
        """Add the expected states of the ids of some windows to ``out``: below those of the ids where no unit starts, those of the units.

        ``units`` has for each id of the stream the unit (frequent word) that starts there, or -1; ``firsts`` gets the id with
        which a unit starts. With ``adam`` the weights take a step after each ``ROUND`` windows, all of which count alike; the expectations are those before the step.
        """
        vocabulary = len(self.emit)
        summed: dict[str, np.ndarray] = {}
        read: list[tuple[np.ndarray, np.ndarray]] = []
        for c in range(0, len(which), CHUNK):
            inputs, own, targets, scored = windows.take(which[c: c + CHUNK])
            kept: dict[str, np.ndarray] = {}
            states, factor = self.infer(inputs, own, kept)
            states, targets, scored = states.reshape(-1, STATES), targets.ravel(), scored.ravel()
            states /= factor.reshape(-1, 1)
            joint = np.take(self.emit, targets, axis=0)
            joint *= states
            joint /= np.maximum(joint @ np.ones(STATES, np.float32), np.float32(1e-30))[:, None]
            if adam is not None:
                states -= joint
                states[~scored] = 0
                out_of, d_x = self.backward(kept, states)
                for name, d in out_of.items():
                    summed[name] = summed[name] + d if name in summed else d
                read.append((inputs, d_x))
                end = min(c + CHUNK, len(which))
                if end % ROUND == 0 or end == len(which):
                    summed["embed"] = self.embed_gradient(*[np.concatenate(part) for part in zip(*read)])
                    n = (end - 1) % ROUND + 1
                    adam.step(self.weights, {name: (d / np.float32(n * SCORED)).astype(np.float32) for name, d in summed.items()})
                    summed, read = {}, []
            at = np.flatnonzero(scored)
            rows, unit = targets[at], units[(windows.start[which[c: c + CHUNK]][:, None] + np.arange(SCORED)).ravel()[at]]
            begins = np.flatnonzero(unit >= 0)
            firsts[unit[begins]] = rows[begins]
            rows[begins] = vocabulary + unit[begins]
            ids, sums = summed_by(rows, joint, at)
            out[ids] += sums

    def packed(self) -> np.ndarray:
        """All weights as rows of ``STATES`` numbers, the last one filled up with zeros."""
        flat = np.concatenate([self.weights[n].ravel() for n in sorted(self.weights)])
        return np.append(flat, np.zeros(-len(flat) % STATES, np.float32)).reshape(-1, STATES)

    def unpack(self, rows: np.ndarray) -> None:
        flat, at = rows.ravel(), 0
        for n in sorted(self.weights):
            old = self.weights[n]
            self.weights[n] = flat[at: at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size

    def learn_emissions(self, total: np.ndarray) -> None:
        """B and W from the summed states, smoothed by the plain shares."""
        for name, rows in (("emit", total[: len(self.emit)]), ("units", total[len(self.emit):])):
            plain = rows.sum(axis=1) + 0.1
            rows = rows + rows.sum(axis=0) * (plain / plain.sum())[:, None] * 0.005 + 1e-9
            setattr(self, name, (rows / rows.sum(axis=0)).astype(np.float32))

    def log_probabilities(self, windows: Windows, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of every id, and probability of the unit that starts there (0: none)."""
        out = np.empty(len(windows.targets), np.float32)
        whole = np.zeros(len(windows.targets), np.float32)
        for c in range(0, len(windows.start), CHUNK):
            which = np.arange(c, min(c + CHUNK, len(windows.start)))
            inputs, own, targets, scored = windows.take(which)
            states, factor = self.infer(inputs, own)
            states, factor = states.reshape(-1, STATES), factor.ravel()
            p = np.vecdot(states, np.take(self.emit, targets.ravel(), axis=0)) / factor
            at = np.flatnonzero(scored)
            place = (windows.start[which][:, None] + np.arange(SCORED)).ravel()[at]
            out[place] = np.log(np.maximum(p[at], 1e-30))
            begins = np.flatnonzero(units[place] >= 0)
            place, at = place[begins], at[begins]
            whole[place] = np.vecdot(np.take(states, at, axis=0), np.take(self.units, units[place], axis=0)) / factor[at]
        return out, whole

    def words(self, s: Stream, windows: Windows, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(natural log probability of each word by its ids, its probability as a unit)."""
        spelled, whole = self.log_probabilities(windows, unit_places(s, tops))
        return np.add.reduceat(spelled.astype(np.float64), s.word_starts), whole[s.word_starts].astype(np.float64)


def unit_places(s: Stream, tops: np.ndarray) -> np.ndarray:
    """For each id of the stream the frequent word that starts there, or -1."""
    out = np.full(len(s.ids), -1, np.int32)
    if len(tops):
        at = np.minimum(np.searchsorted(tops, s.hashes), len(tops) - 1)
        out[s.word_starts] = np.where(tops[at] == s.hashes, at, -1)
    return out


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values by sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = text_bytes(batch.column(0))
    for a, b in steps([len(t) for t in texts], STEP):
        hashes = hashed_words(texts[a:b])[3]
        values, counts = np.unique(hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([values, [END_HASH]]).view(np.int64)),
            pa.array(np.concatenate([counts, [b - a]]).astype(np.int64))], ["hash", "n"])


_CODERS: dict[int, sentencepiece.SentencePieceProcessor] = {}


def _coder(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    key = hash(proto)
    if key not in _CODERS:
        _CODERS[key] = sentencepiece.SentencePieceProcessor(model_proto=proto)
    return _CODERS[key]


def _gather(sent, size: int, learn: bool = False):
    """Summed states of a whole task by id and unit. With ``learn`` its weights times its windows, and the windows, follow as rows from ``size`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, proto, tops = sent.value
        model = copy.copy(start)
        model.weights = dict(start.weights)
        coder, total, n = _coder(proto), np.zeros((size, STATES), np.float32), 0
        spelled, firsts = Spelled(coder), np.zeros(len(tops), np.int32)
        adam = Adam(model.weights, RATE) if learn else None
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in steps([len(t) for t in texts], STEP):
                s = stream(texts[a:b], spelled)
                windows = Windows(s, coder.bos_id())
                model.expected_states(windows, np.arange(len(windows.start)), unit_places(s, tops), total, firsts, adam)
                n += len(windows.start)
        ids, sums = summed_by(firsts, total[len(model.emit):])  # an id also counts where a unit starts with it
        total[ids] += sums
        for ids in np.array_split(np.flatnonzero(total.any(axis=1)), 8):
            yield _states(ids, total[ids])
        if learn and n:
            rows = np.concatenate([model.packed() * np.float32(n), np.full((1, STATES), n, np.float32)])
            yield _states(np.arange(size, size + len(rows)), rows)

    return run


def _states(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(0, rows.size + 1, STATES, dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), lists], ["id", "states"])


def _sum_states(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, STATES), np.float64)
        for batch in batches:
            np.add.at(total, np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()).reshape(-1, STATES))
        ids = np.flatnonzero(total.any(axis=1))
        yield _states(ids, total[ids])

    return run


@dataclass
class LanguageModel:
    model: AttentionModel
    proto: bytes
    counts: DataFrame  # (hash, n) of every training token
    tokens: int
    distinct: int
    frequent: tuple[np.ndarray, np.ndarray]
    tops: np.ndarray


def fit(docs: DataFrame, learn: Column, model_path: str, key: str = "doc_id", text: str = "text") -> LanguageModel:
    """Learn from the rows of ``docs`` where ``learn`` holds."""
    spark = docs.sparkSession
    with_proto = sentencepiece.SentencePieceProcessor(model_file=model_path)
    proto = with_proto.serialized_model_proto()
    training = docs.filter(learn).select(F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    counts = materialise(map_batches(training.select("text"), "hash long, n long", _count)
                         .groupBy("hash").agg(F.sum("n").alias("n")), "word_counts")
    tokens, distinct, n_docs = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)),
        F.coalesce(F.sum(F.when(F.col("hash") == F.lit(int(END_HASH.view(np.int64))), F.col("n"))), F.lit(0))).first()
    hot = counts.filter(F.col("n") * FREQUENT >= tokens).toArrow()  # at most FREQUENT rows, as they sum to ``tokens``
    hashes = np.asarray(hot.column(0).combine_chunks()).view(U64) if hot.num_rows else np.zeros(0, U64)
    order = np.argsort(hashes)
    frequent = (hashes[order], np.asarray(hot.column(1).combine_chunks()).astype(np.int64)[order] if hot.num_rows
                else np.zeros(0, np.int64))
    most = np.lexsort((frequent[0], -frequent[1]))[:TOP]
    tops = np.sort(frequent[0][most])
    model = AttentionModel(with_proto.get_piece_size())
    if n_docs:
        span = 1 << 30
        sample = training.filter(F.pmod("h", F.lit(span)) < F.lit(int(min(1.0, SAMPLE_DOCS / n_docs) * span))) \
            .select("text").toArrow().column(0).combine_chunks()
        if not len(sample):
            sample = training.select("text").limit(1).toArrow().column(0).combine_chunks()
        own = stream(text_bytes(sample), with_proto)
        windows = Windows(own, with_proto.bos_id())
        model.fit(windows)
        sent = spark.sparkContext.broadcast((model, proto, tops))
        size, more = len(model.emit) + len(tops), len(model.packed()) + 1
        sums = (training.select("text").mapInArrow(_gather(sent, size, True), "id int, states array<float>").repartition("id")
                .mapInArrow(_sum_states(size + more), "id int, states array<float>").toArrow())  # at most ``size + more`` rows
        ids = np.asarray(sums.column(0).combine_chunks())
        total = np.zeros((size + more, STATES))
        total[ids] = np.asarray(sums.column(1).combine_chunks().flatten()).reshape(len(ids), STATES)
        model.unpack(total[size: -1] / total[-1])
        model.learn_emissions(total[:size])
        model.share = float(frequent[1][most].sum() / (tokens + distinct))
    return LanguageModel(model, proto, counts, int(tokens), int(distinct), frequent, tops)


def score(docs: DataFrame, learned: LanguageModel, key: str = "doc_id", text: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, the columns ``keep``, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((learned.model, learned.proto, learned.frequent, learned.tops))
    tokens, floor = learned.tokens, np.log10(learned.tokens + learned.distinct + 1.0)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, proto, (keys, values), tops = sent.value
        coder = _coder(proto)
        texts = text_bytes(batch.column(1))
        for a, b in steps([len(t) for t in texts], STEP):
            s = stream(texts[a:b], coder)
            spelled, whole = model.words(s, Windows(s, coder.bos_id()), tops)
            seen = lookup(keys, values, s.hashes)
            plain = spelled / np.log(10) + np.log10(1 - model.share)
            mixed = np.where(whole > 0, np.log10(10 ** plain + model.share * whole + 1e-300), plain)
            starts = s.text_words[:-1]
            rare = np.flatnonzero(seen == 0)
            bounds = np.searchsorted(rare, s.text_words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array(np.diff(s.text_words)),
                pa.array(np.add.reduceat((seen > 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(np.where(seen > 0, np.log10(seen + 1.0) - floor, 0), starts)),
                pa.array(np.add.reduceat(mixed, starts)),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.hashes[rare].view(np.int64)))],
                ["row", "n_tokens", "hot", "hot_base", "score", "rare"])

    # Rows get a number for the join back, so that equal and null keys are told apart; it is fixed by being written.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"),
                           F.col(key).alias(key), *[F.col(c) for c in keep])
    kinds = dict(docs.dtypes)
    more = [key, *keep]

    def carried(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for part in step(batch):
            own = batch.slice(at, part.num_rows)
            at += part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, *own.columns[2:]], [*part.schema.names, *more])

    schema = "row long, n_tokens long, hot long, hot_base double, score double, rare array<long>"
    scored = materialise(map_batches(numbered, ", ".join([schema, *(f"`{c}` {kinds[c]}" for c in more)]), carried), "scored")
    rare = (
        scored.select("row", F.explode("rare").alias("hash")).join(learned.counts, "hash", "left")
        .groupBy("row").agg(F.count("n").alias("cold"),
                            F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0) - F.lit(float(floor))).alias("cold_base"))
    )
    return scored.join(rare, "row", "left").select(
        *more, "n_tokens", (F.col("hot") + F.coalesce("cold", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("cold_base", F.lit(0.0))).alias("base_score"), "score")
