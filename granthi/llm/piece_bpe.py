"""Exact SentencePiece BPE encoding by backtracking, and decoding.

Merging always takes the best piece that two neighbours form (the leftmost of equal ones). The result is the only split of a text into
pieces in which every two neighbours are what merging their joint text alone gives. So it is found from the
left: longest piece first (an Aho-Corasick automaton), each neighbour pair checked by merging
it again (remembered per pair), and positions that cannot be continued are kept in a bit field.

No piece has a blank behind another character, so a text falls into units (blanks and the word behind them)
that are encoded each by itself and remembered in a bounded memory. Characters outside the vocabulary
become byte pieces. Null is the empty text, which has no ids.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from granthi.llm.common import map_batches

BLANK = "▁"
REMEMBERED_UNITS = 300_000
REMEMBERED_PAIRS = 400_000
REMEMBERED_LENGTH = 64
NEVER = float("inf")


def load_pieces(path: str) -> list[tuple[str, float | None]]:
    """(piece, merge score) by id; pieces that merging never makes (control, byte, unknown) have no score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [(model.id_to_piece(i), None if any(test(i) for test in special) else model.get_score(i))
            for i in range(model.get_piece_size())]


class PieceCodec:
    """Encoder and decoder over a piece list. ``encode`` and ``decode`` are inverse up to U+2581."""

    def __init__(self, pieces: list[tuple[str, float | None]]) -> None:
        self.pieces = [p for p, _ in pieces]
        self.ids = {p: i for i, (p, score) in enumerate(pieces) if score is not None}
        self.cost = {p: -score for p, score in pieces if score is not None}
        self.costs = [self.cost.get(p, NEVER) for p in self.pieces]
        seen = Counter(self.cost.values())
        self.tied = {cost for cost, n in seen.items() if n > 1}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.bytes = {int(p[1:-1], 16): i for i, (p, score) in enumerate(pieces)
                      if score is None and re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece has a blank behind another character: units are not independent")
        self.chars = {p for p in self.ids if len(p) == 1}
        breaks = "" if any("\n" in p for p in self.ids) else "\n"
        self.units = re.compile(f"{BLANK}*[^{BLANK}{breaks}]+|{BLANK}+" + ("|\n" if breaks else "")).findall
        self.pairs: dict[int, bool] = {}
        # A piece that merging its own text doesn't give can't be a result.
        self.reachable = {p: i for p, i in self.ids.items() if self.merge(p) == [i]}
        self.longest_piece = max(map(len, self.reachable), default=0)
        # For every beginning of a piece the longest piece that it begins with.
        self.within: dict[str, tuple[int, int]] = {"": (0, 0)}
        for piece in self.reachable:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in self.within:
                    known = self.reachable.get(piece[:n])
                    self.within[piece[:n]] = self.within[piece[: n - 1]] if known is None else (n, known)
        self.machine = ahocorasick.Automaton()
        for piece, i in self.reachable.items():
            self.machine.add_word(piece, i)
        self.machine.make_automaton()
        self.names = [str(i) for i in range(len(pieces))]
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(BLANK, " ").encode()
                    for i in range(len(pieces))]
        self.known = _Memory(self.code_unit)

    def merge(self, text: str, keep: int = 1) -> list[int]:
        """Merging step by step, the definition, until at most ``keep`` pieces are left."""
        parts = list(text)
        while True:
            cost, at = min(((self.cost.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))),
                           default=(NEVER, 0))
            if cost == NEVER or len(parts) <= keep:
                return [self.ids[p] for p in parts]
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one last; None for a single character."""
        if piece not in self.splits:
            parts = self.merge(self.pieces[piece], keep=2)
            self.splits[piece] = tuple(parts) if len(parts) == 2 else None
        return self.splits[piece]

    def crosses(self, left: int, right: int) -> bool:
        """Would merging the joint text of two pieces have merged across their border?

        Both pieces are taken apart from the last merge backwards. Whatever stood at the border while a
        piece was still in two halves must not have formed a better piece than the merge that ended it;
        of equal merges the left one comes first.
        """
        before = (NEVER, 0)
        while True:
            cost = self.cost.get(self.pieces[left] + self.pieces[right])
            if cost is not None and (cost, 1) < before:
                return True
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return False
            if b is None or a is not None and self.costs[left] > self.costs[right]:
                before, left = (self.costs[left], 1), a[1]
            else:
                before, right = (self.costs[right], 2), b[0]

    def compatible(self, left: int, right: int) -> bool:
        """Does merging the joint text of two pieces give these two? Remembered per pair."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            if self.costs[left] in self.tied or self.costs[right] in self.tied:
                known = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
            else:
                known = not self.crosses(left, right)
            self.pairs[key] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Pieces of a text whose characters all belong to the vocabulary.

        The chain of longest matches of one pass of the automaton is right for about half of all words.
        Where two neighbours do not fit, the shorter matches are tried; ``failed`` has a bit for each
        position from which the rest can't be reached with the piece before it, so none is tried twice.
        """
        known, compatible = self.pairs.get, self.compatible
        chain, before = [], -1
        for _, piece in self.machine.iter_long(text):
            if before >= 0 and not known(before << 32 | piece) and not compatible(before, piece):
                break
            chain.append(piece)
            before = piece
        else:
            return chain
        # What fitted so far stays; at its end a shorter match than the one that didn't fit comes next.
        size, failed, at, below = len(text), 0, 0, len(self.pieces[piece])
        path: list[tuple[int, int, int]] = []  # piece, start, length
        for fitting in chain:
            length = len(self.pieces[fitting])
            path.append((fitting, at, length))
            at += length
        within, reach, widest = self.within, self.machine.longest_prefix, self.longest_piece
        while at < size:
            # The longest piece here that is shorter than ``below``, if any.
            held = reach(text[at: at + widest])
            length, piece = within[text[at: at + (held if held < below else below - 1)]]
            if length:
                if failed >> (at + length) & 1 or before >= 0 and not (
                        known(before << 32 | piece) or compatible(before, piece)):
                    below = length
                else:
                    path.append((piece, at, length))
                    before, at, below = piece, at + length, 1 << 60
            else:
                failed |= 1 << at
                _, at, below = path.pop()
                before = path[-1][0] if path else -1
        return [piece for piece, _, _ in path]

    def encode_unit(self, unit: str) -> list[int]:
        if self.chars.issuperset(unit):
            return self.backtrack(unit)
        out: list[int] = []
        begin = 0
        for i, char in enumerate(unit):
            if char not in self.chars:
                if begin < i:
                    out += self.backtrack(unit[begin:i])
                out += [self.bytes[b] for b in char.encode()]
                begin = i + 1
        return out + self.backtrack(unit[begin:]) if begin < len(unit) else out

    def code_unit(self, unit: str) -> tuple[str, str]:
        """Ids of a unit, joined by commas, and the text they decode to."""
        ids = self.encode_unit(unit)
        return ",".join([self.names[i] for i in ids]), self.spell(ids)

    def coded(self, text: str) -> list[tuple[str, str]]:
        """Ids and decoded text of the units of a text, in turn."""
        return list(map(self.known.__getitem__, self.units(BLANK + text.replace(" ", BLANK)))) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.coded(text) for i in ids.split(",")]

    def spell(self, ids: list[int]) -> str:
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return unblanked(self.spell(ids))


def unblanked(text: str) -> str:
    """Without the blank that is set before every text."""
    return text[1:] if text.startswith(" ") else text


class _Memory(dict):
    """Remembers results of short keys in two generations: when the younger is full it becomes the older, and what is asked
    for again comes back from there. Its size is bounded, and what is in use is never forgotten."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[str, str]:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_UNITS // 2:
                self.old = self.copy()
                self.clear()
            self[key] = value
        return value


_CODECS: dict[str, PieceCodec] = {}


def codec(pieces: list[tuple[str, float | None]], name: str) -> PieceCodec:
    """One codec per worker process, so that later tasks find it warm."""
    if name not in _CODECS:
        _CODECS[name] = PieceCodec(pieces)
    return _CODECS[name]


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text",
                  with_text: bool = False) -> DataFrame:
    """One row per document: key, n_tokens, ids (comma-joined) digest, digest of the decoded text.

    ``with_text`` adds ``ids`` (the comma-joined ids) and ``decoded``. Null and empty texts have no
    ids and decode to the empty text. Map-only; the piece list goes to the workers once (fixed size).
    Other columns of ``docs`` are not read.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = codec(pieces.value, model_path)
        counts, id_digests, text_digests, all_ids, all_texts = [], [], [], [], []
        for value in batch.column(1).to_pylist():
            units = coder.coded(value or "")
            ids = ",".join([i for i, _ in units])
            decoded = unblanked("".join([t for _, t in units]))
            counts.append(ids.count(",") + 1 if ids else 0)
            id_digests.append(hashlib.sha256(ids.encode()).hexdigest())
            text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_text:
                all_ids.append(ids)
                all_texts.append(decoded)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_text:
            columns += [pa.array(all_ids, pa.string()), pa.array(all_texts, pa.string())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(key, text), schema + (", ids string, decoded string" if with_text else ""), step)
