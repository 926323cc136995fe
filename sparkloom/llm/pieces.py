"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the pieces.

One pass over a text's characters follows the automaton's output links, which name every piece that ends at a
position, and relaxes the best score there: the highest sum of piece scores of the text up to it, with the last piece
of that way (Viterbi). That is the encoding of a unigram model, and the columns ``viterbi_*``.

A BPE model's own encoding is another one. Its encoding of a text cut anywhere between two of its pieces is the
encodings of both sides, so the same pass keeps, at each position, the one last piece that forms a stable pair with
the last piece before it, that is, whose pair BPE encodes as those two. Pairs are tested once and
remembered. For a BPE model ``ids`` are these, as the library gives them; for a unigram model both are the same.

Units of a text whose ends no piece crosses (a word with the spaces before it, the marks after it) are segmented on
their own and remembered, in tables bounded by bytes; very long units take the same single pass. Characters that no
piece has are units too and become bytes. Batches are cut by the bytes of their texts, so a task's memory doesn't grow with them.
Tables outlive a task, beside whatever the executor does next, so a remembered unit is its text, a number, and its ids in an
array of all ids: less than half of what it takes as an object.

Defined results: a null or empty text gives no pieces and score 0; decoding gives the text back, but for U+2581, which stands
for a space in the pieces and comes back as one; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from sys import getsizeof
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes, by estimate, that a worker's table of units may take, and all that it remembers about pairs of pieces.
REMEMBERED = 64 << 20
REMEMBERED_PAIRS = 48 << 20
LONGEST_REMEMBERED = 40
#: Units of a text that are looked up at a time.
LOOKED_UP = 1 << 14
#: A character without a piece scores so much less than the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model(NamedTuple):
    """What the driver reads from a model file; its size is that of the vocabulary."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    bpe: bool
    dummy_prefix: bool


def read_model(path: str = MODEL) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    normal = proto.normalizer_spec
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError("only models that leave the text as it is are supported")
    kind = proto.trainer_spec.model_type
    if kind not in (proto.trainer_spec.UNIGRAM, proto.trainer_spec.BPE):
        raise ValueError("only unigram and BPE models are supported")
    rows = [(p.piece, p.score, p.type) for p in proto.pieces]
    return Model(*zip(*rows, strict=True), kind == proto.trainer_spec.BPE, normal.add_dummy_prefix)


class Bounded(dict):
    """Remembers what ``make`` gives for a key, within a number of bytes: ``each`` a key and what it is made of. Keys
    that were not asked for since the last half was filled are forgotten."""

    def __init__(self, make, each: int, most: int):
        super().__init__()
        self.make, self.each, self.most, self.size, self.older = make, each, most // 2, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.size += self.each + (len(value) * 60 if isinstance(value, tuple) else 0)
        if self.size > self.most:
            self.older, self.size = dict(self), self.each
            self.clear()
        self[key] = value
        return value


class Units(dict):
    """A number by unit. What is known of the units stands in arrays by that number: where its ids begin in ``flat``,
    then those of the best-scored way if they are others, the score of that way, and whether the ids decode to it."""

    def __init__(self, make, older: Units | None = None):
        super().__init__()
        self.make, self.older, self.size = make, older, 0
        self.flat, self.begin, self.other = array("i"), array("q", [0]), array("q")
        self.score, self.plain = array("d"), bytearray()

    def __missing__(self, unit: str) -> int:
        older, at, number = self.older, None, len(self.score)
        if older is not None:
            at = older.get(unit)
        if at is None:
            ids, best, score, plain = self.make(unit)
        else:
            start, other, end = older.begin[at], older.other[at], older.begin[at + 1]
            ids, best, score, plain = older.flat[start:other], older.flat[other:end], older.score[at], older.plain[at]
        self.flat.extend(ids)
        self.other.append(len(self.flat))
        self.flat.extend(best)
        self.begin.append(len(self.flat))
        self.score.append(score)
        self.plain.append(plain)
        self.size += 25 + 4 * (len(ids) + len(best))
        if len(unit) <= LONGEST_REMEMBERED:
            self.size += 100 + getsizeof(unit)
            self[unit] = number
        return number

    def of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[float], bool]:
        """The units' ids, the ids of the best-scored ways, the scores, and whether all ids decode to their units."""
        at = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        # the arrays cannot grow while NumPy reads them, which it does within this call
        flat, begin, other = (np.frombuffer(x, kind) for x, kind in ((self.flat, np.int32), (self.begin, np.int64), (self.other, np.int64)))
        start, middle, end = begin[at], other[at], begin[at + 1]
        ids = best = flat[spans(start, middle)]
        if (middle < end).any():
            best = flat[spans(np.where(middle < end, middle, start), end)]
        return ids, best, np.frombuffer(self.score)[at].tolist(), bool(np.frombuffer(self.plain, np.bool_)[at].all())


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All positions from each start to before its end."""
    n = end - start
    ends = np.cumsum(n)
    return np.repeat(end - ends, n) + np.arange(ends[-1])


class Encoded(NamedTuple):
    """A text's ids and those of the best-scored way as 32-bit integers, that way's score, and the UTF-8 text that the
    ids decode to."""

    ids: np.ndarray
    best: np.ndarray
    score: float
    text: bytes


class Codec:
    """Encodes and decodes with one model.

    Inside, a *part* is a piece's id, or a number from the vocabulary's size on: that of a character which stands
    in pieces without being one, or ``self.start`` (nothing yet)."""

    def __init__(self, model: Model):
        self.model = model
        size = len(model.pieces)
        ids = {p: k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind in (NORMAL, USER_DEFINED) and p}
        self.score = {p: model.scores[k] for p, k in ids.items()}
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        bare = sorted(set("".join(ids)) - set(ids))
        self.texts = [*model.pieces, *bare, ""]
        self.start = size + len(bare)
        parts = ids | {c: size + k for k, c in enumerate(bare)}
        self.width = [max(1, len(x)) for x in self.texts]
        self.gain = [self.score.get(x, self.worst) for x in self.texts]
        self.automaton = ahocorasick.Automaton()
        for piece, part in parts.items():
            self.automaton.add_word(piece, (len(piece) - 1, self.gain[part], part))
        self.automaton.make_automaton()
        self.bytes = {int(model.pieces[k][3:5], 16): k for k, kind in enumerate(model.kinds) if kind == BYTE}
        self.unknown = next((k for k, kind in enumerate(model.kinds) if kind == UNKNOWN), 0)
        self.surface = [self._surface(p, kind) for p, kind in zip(model.pieces, model.kinds, strict=True)]
        self.known = set("".join(ids))
        self.units = self._units(ids)
        self.remembered = Units(self.unit)
        self.stable = Bounded(self._stable, 120, REMEMBERED_PAIRS * 2 // 3)
        self.halves = Bounded(self._halves, 250, REMEMBERED_PAIRS // 6)
        self.edges = Bounded(self._edge, 250, REMEMBERED_PAIRS // 6)

    def _units(self, pieces: Iterable[str]) -> re.Pattern:
        """Cuts a text where no piece has the characters on both sides next to one another: around characters of no
        piece, before spaces, and after letters, where no piece goes on from a letter to that character. Texts still
        have their spaces here, and none that stand for them."""

        def one_of(chars: Iterable[str]) -> str:
            return "".join(map(re.escape, sorted(set(chars) - {" "}))).replace(SPACE, " ")

        known = one_of(self.known)
        if not known:
            return re.compile("(?s).+")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return re.compile(f"[{known}]+|[^{known}]+")
        after = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        letters = one_of(c for c in self.known if c.isalpha())
        marks = one_of(c for c in self.known if not c.isalpha() and c not in after and c != SPACE)
        rest = one_of(self.known - {SPACE}) or "^\\s\\S"
        word = f" *[{letters}]++(?:(?=[{marks}])|[{rest}]*)|" if letters and marks else ""
        return re.compile(f"{word} +[{rest}]*|[{rest}]+|[^{known} ]+")

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}.get(kind, piece.replace(SPACE, " ").encode())

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for short texts: merge the best neighbours until no two make a piece."""
        parts = list(text)
        while (merged := self.merge_once(parts)) != parts:
            parts = merged
        return parts

    def merge_once(self, parts: list[str]) -> list[str]:
        joined = [(self.score.get(a + b), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        best = max((x for x in joined if x[0] is not None), default=None)
        if best is None:
            return parts
        k = -best[1]
        return [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]

    def _halves(self, text: str) -> tuple[str, str] | None:
        """The two pieces that BPE merges last to make this one; none for a character or a piece it never makes."""
        parts, before = list(text), []
        while len(parts) > 1:
            before = parts
            parts = self.merge_once(parts)
            if parts == before:
                return None
        return (before[0], before[1]) if before else None

    def _edge(self, side_text: tuple[int, str]) -> tuple[tuple[str, float], ...]:
        """What stands at one edge of a piece (0 left, 1 right) while BPE makes it, and the score of the merge that
        takes each away."""
        side, text = side_text
        halves = self.halves[text]
        if halves is None:
            return ((text, -np.inf),)
        inner = self.edges[side, halves[side]]
        # scores that don't fall from the parts to the whole say nothing about the order of merges
        if not inner or any(len(x) > 1 and self.score[x] <= self.score[text] for x in halves):
            return ()
        return (*inner[:-1], (halves[side], self.score[text]), (text, -np.inf))

    def _stable(self, pair: int) -> bool:
        """Whether BPE encodes the texts of two parts, joined, as these two: at no time do the pieces on both sides
        of the boundary make a piece that comes before what else happens to them."""
        a, b = (self.texts[part] for part in divmod(pair, len(self.texts)))
        if len(b) > 1 and self.halves[b] is None:
            return False
        if not self.edges[1, a] or not self.edges[0, b]:
            return self.merged(a + b) == [x for x in (a, b) if x]
        for x, gone_x in self.edges[1, a]:
            for y, gone_y in self.edges[0, b]:
                made = self.score.get(x + y) if x and y else None
                # of equal merges the left one comes first
                if made is not None and made > gone_x and made >= gone_y:
                    return False
        return True

    def ways(self, text: str) -> tuple[list[int], list[int], float]:
        """For each position the last part of the text's BPE encoding up to there (left alone for a unigram model) and
        that of the best-scored way to get there; then the score of the whole. Every character is in some piece, so
        every position is reached."""
        size, stable, none, other = len(self.texts), self.stable, -float("inf"), not self.model.bpe
        part, best, total = [self.start], [0], [0.0]
        now, top, arg, found = 0, none, 0, other
        for last, (back, gain, own) in self.automaton.iter(text):
            if last != now:  # all pieces that end at a position come together
                part.append(found)
                best.append(arg)
                total.append(top)
                now, top, found = last, none, other
            reached = total[last - back] + gain
            if reached > top:
                top, arg = reached, own
            if not found and stable[part[last - back] * size + own]:
                found = own
        return [*part, found], [*best, arg], top

    def path(self, unit: str, part: list[int]) -> list[int]:
        """The ids along the last parts, from the end back; a character that is no piece is its bytes."""
        size, width, end, found = len(self.model.pieces), self.width, len(unit), []
        while end:
            own = part[end]
            if own < size:
                found.append(own)
            else:
                found.extend(self.spelt(unit[end - 1])[::-1])
            end -= width[own]
        found.reverse()
        return found

    def spelt(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def unit(self, unit: str) -> tuple[list[int], list[int], float, bool]:
        """A unit's ids, those of the best-scored way (none if they are the same), its score, and whether the ids decode
        to the unit."""
        text = unit.replace(" ", SPACE)
        if text[0] not in self.known:
            ids, other, score = [k for c in text for k in self.spelt(c)], [], self.worst * len(text)
        else:
            part, best, score = self.ways(text)
            ids = scored = self.path(text, best)
            if self.model.bpe and part != best:
                ids = self.path(text, part)
            other = scored if ids != scored else []
        return ids, other, score, self.surfaces(ids) == unit.encode("utf-8", "replace")

    def split(self, text: str | None) -> Encoded:
        if not text:
            return Encoded(NO_IDS, NO_IDS, 0.0, b"")
        text = (" " if self.model.dummy_prefix else "") + text.replace(SPACE, " ")
        units = self.units.findall(text)
        found, scores = [], []
        for k in range(0, len(units), LOOKED_UP):
            if self.remembered.size > REMEMBERED // 2:  # units not asked for since the last half was filled are forgotten
                self.remembered.older = None
                self.remembered = Units(self.unit, self.remembered)
            *one, score, plain = self.remembered.of(units[k : k + LOOKED_UP])
            found.append((*one, plain))
            scores += score
        ids, best = (np.concatenate([x[k] for x in found]) if len(found) > 1 else found[0][k] for k in (0, 1))
        plain = all(x[2] for x in found) and "".join(units) == text
        return Encoded(ids, best, float(sum(scores)), text.encode("utf-8", "replace") if plain else self.surfaces(ids.tolist()))

    def encode(self, text: str | None) -> list[int]:
        return self.split(text).ids.tolist()

    def surfaces(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))

    def shown(self, surfaces: bytes) -> str:
        text = surfaces.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids: Iterable[int]) -> str:
        return self.shown(self.surfaces(ids))


NO_IDS = np.empty(0, np.int32)

_codecs: dict[int, Codec] = {}


def codec(model: Model) -> Codec:
    """This worker's codec for the model."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


#: Columns after ``doc_id``.
COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32())), "n_pieces": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
    "round_trip": ("boolean", pa.bool_()), "viterbi_pieces": ("long", pa.int64()), "viterbi_score": ("double", pa.float64()),
    "viterbi_sha256": ("string", pa.string()),
}


def encode(docs: DataFrame, model: Model, with_ids: bool = True) -> DataFrame:
    """Per row: ``doc_id``, the ``ids`` of its pieces (unless ``with_ids`` is off), their number and SHA-256 as
    little-endian 32-bit integers, whether they decode to the text, and number, summed score and SHA-256 of the
    best-scored segmentation."""
    names = [c for c in COLUMNS if with_ids or c != "ids"]

    def rows(own: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        found = {c: [] for c in names}
        flat, ends = [], [0]
        for x in part.column(1):
            text = x.as_py() or ""
            of = own.split(text)
            if with_ids:
                flat.append(of.ids)
                ends.append(ends[-1] + len(of.ids))
            found["n_pieces"].append(len(of.ids))
            found["ids_sha256"].append(hashlib.sha256(of.ids.astype("<i4", copy=False)).hexdigest())
            found["round_trip"].append(own.shown(of.text) == text)
            found["viterbi_pieces"].append(len(of.best))
            found["viterbi_score"].append(of.score)
            found["viterbi_sha256"].append(hashlib.sha256(of.best.astype("<i4", copy=False)).hexdigest())
        columns = {c: pa.array(v, COLUMNS[c][1]) for c, v in found.items() if c != "ids"}
        if with_ids:
            values = pa.array(np.concatenate([NO_IDS, *flat]), pa.int32())
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.RecordBatch.from_arrays([part.column(0), *(columns[c] for c in names)], ["doc_id", *names])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in parts:
            for piece in slices(part, 1):
                yield rows(own, piece)
        pa.default_memory_pool().release_unused()

    spec = ", ".join(f"{c} {COLUMNS[c][0]}" for c in names)
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, {spec}")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; null ids give an empty text."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in parts:
            texts = [own.decode(x.as_py() or ()) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(batches, f"doc_id {kind}, text string")


def op9_sentencepiece(spark, sf_dir, model: str = MODEL):
    return encode(table(spark, sf_dir, "documents"), read_model(model), with_ids=False)


def stage(spark, docs, sf_dir, model: str = MODEL):
    """The documents' ids, their numbers, digests and scores, a row for each row, whatever its id; the last stage."""
    return encode(docs, read_model(model))
