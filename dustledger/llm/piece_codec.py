"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking over an Aho-Corasick automaton.

Merging by score, leftmost first among equal scores, never crosses the border of two pieces of the result before one of them
is whole. So a sequence of pieces is the encoding of its text exactly if every two neighbours are: merging their joined
text gives back these two. The encoder therefore walks from left to right, tries the longest piece that starts at a position
first and then its shorter prefixes, accepts a piece that is compatible with its left neighbour, and steps back where none
is; a bitfield marks the positions from which no way leads on, so each is left at most once.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

SPACE = "▁"
#: Words up to this length are remembered per worker, at most twice this many of them, and this many pairs of pieces.
REMEMBERED_LENGTH, REMEMBERED = 48, 250_000
#: Texts that a worker encodes before it hands their ids on.
AT_ONCE = 500
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: Stands for a control id, which ends a run of bytes; no text holds a lone high surrogate.
_CUT = "\ud800"
_LOADED: dict[str, "PieceCodec"] = {}


class PieceCodec:
    """Encoder and decoder of one model, from its piece table (piece, score, kind)."""

    def __init__(self, table: list[tuple[str, float, int]], unknown_surface: str = " ⁇ "):
        import ahocorasick

        self.score = {piece: score for piece, score, kind in table if kind == _NORMAL}
        self.number = {piece: k for k, (piece, _, kind) in enumerate(table) if kind == _NORMAL}
        self.length = [len(piece) for piece, _, _ in table]
        self.text = [piece for piece, _, _ in table]
        self.byte = {int(piece[3:-1], 16): k for k, (piece, _, kind) in enumerate(table) if kind == _BYTE}
        self.history: list[tuple[list[float], list[str], list[str]] | None] = [None] * len(table)
        whole = [piece for piece, k in self.number.items() if self._remerge_alone(piece, k)]
        self.known = {piece for piece in whole if len(piece) == 1}
        self.reachable = reachable = set(whole)
        self.shorter = [-1] * len(table)
        backwards = ahocorasick.Automaton()
        for piece in whole:
            backwards.add_word(piece[::-1], self.number[piece])
            prefix = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in reachable), None)
            self.shorter[self.number[piece]] = -1 if prefix is None else self.number[prefix]
        backwards.make_automaton()
        self.backwards = backwards
        # borders that no piece spans: merging on either side of them is independent
        inner = {a + b for piece in self.score for a, b in zip(piece, piece[1:])}
        letters = {c for c in self.known if c.isalpha() and c != SPACE}
        spaced = not any(pair[1] == SPACE and pair[0] != SPACE for pair in inner)
        lined = not any("\n" in pair for pair in inner)
        parted = not any((pair[0] in letters) != (pair[1] in letters) for pair in inner if pair[0] != SPACE)
        line, one = ("\n", "|\n") if lined else ("", "")
        some = "".join(map(re.escape, sorted(letters)))
        bodies = [f"[{some}]+", f"[^{some}{SPACE}{line}]+"] if parted and some else [f"[^{SPACE}{line}]+"]
        word = "|".join([*(f"{SPACE}*{body}" for body in bodies), f"{SPACE}+"]) + one
        self.words = re.compile(word).findall if spaced else lambda text: [text]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memory = _Memory(self)
        self.surface = [
            unknown_surface if kind == _UNKNOWN else _CUT if kind == _CONTROL else piece.replace(SPACE, " ") if kind != _BYTE
            else chr(int(piece[3:-1], 16)) if int(piece[3:-1], 16) < 128 else chr(0xDC00 + int(piece[3:-1], 16))
            for piece, _, kind in table]
        self.kind = [kind for _, _, kind in table]
        self.high_bytes = np.array([kind == _BYTE and int(piece[3:-1], 16) > 127 for piece, _, kind in table])

    def _remerge_alone(self, piece: str, number: int) -> bool:
        """Merge a piece's characters, the highest score first and the leftmost of equal ones, and keep the history.

        The history has the score of every merge, and the first and the last part before each and at the end. A piece that
        does not come out whole is in no encoding.
        """
        parts = list(piece)
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            found = [self.score.get(a + b, -math.inf) for a, b in zip(parts, parts[1:])]
            best = max(found)
            if best == -math.inf:
                return False
            at = found.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        self.history[number] = ([*scores, -math.inf], firsts, lasts)
        return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their joined characters are merged again.

        Both histories run side by side in the order of their scores; the pieces fall if the pair of parts that meets at
        their border is ever the next to merge. Of equal scores the left piece's merge comes first, then the border's.
        """
        key = left << 32 | right
        told = self.pairs.get(key)
        if told is not None:
            return told
        (ours, _, lasts), (theirs, firsts, _) = self.history[left], self.history[right]
        i = j = 0
        while True:
            border = self.score.get(lasts[i] + firsts[j], -math.inf)
            if border > ours[i] and border >= theirs[j]:
                told = False
                break
            if i == len(ours) - 1 and j == len(theirs) - 1:
                told = True
                break
            if ours[i] >= theirs[j] and i < len(ours) - 1:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[key] = told
        return told

    def longest(self, run: str) -> list[int]:
        """By distance from the end of the run, the longest piece that starts there: one scan of the reversed run.

        The automaton tells the longest of the pieces that end at a position first.
        """
        best = [-1] * len(run)
        for at, piece in self.backwards.iter(run[::-1]):
            if best[at] < 0:
                best[at] = piece
        return best

    def backtrack(self, run: str) -> array:
        """The pieces of a run of known characters."""
        starts, size, shorter, compatible = self.longest(run), self.length, self.shorter, self.compatible
        failed = bytearray((len(run) >> 3) + 1)
        out = array("i")
        at, last, piece = 0, len(run) - 1, starts[-1]
        while at <= last:
            end = at + size[piece]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or compatible(out[-1], piece)):
                out.append(piece)
                at = end
                piece = starts[last - at] if at <= last else -1
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:  # nothing leads on from here: mark it and take the last piece back, which is then shortened
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= size[piece]
        return out

    def encode_word(self, word: str) -> bytes:
        """Packed ids of a word; a character outside the vocabulary becomes the ids of its UTF-8 bytes."""
        own = self.number.get(word)
        if own is not None and word in self.reachable:
            return array("i", (own,)).tobytes()
        out, at = array("i"), 0
        while at < len(word):
            end = at
            while end < len(word) and word[end] in self.known:
                end += 1
            if end > at:
                out.extend(self.backtrack(word[at:end]))
            if end < len(word):
                out.extend(self.byte[b] for b in word[end].encode("utf-8", "surrogatepass"))
                end += 1
            at = end
        return out.tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text: a leading space mark, spaces as marks, then word by word."""
        if not text:
            return np.zeros(0, np.int32)
        words = self.words(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.memory.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces end to end, bytes as UTF-8 (each invalid byte becomes U+FFFD), without the leading mark."""
        listed = ids.tolist()
        text = "".join(map(self.surface.__getitem__, listed)).lstrip(_CUT)
        first = next((k for k in listed if self.kind[k] != _CONTROL), None)
        if first is not None and self.kind[first] == _NORMAL and text.startswith(" "):
            text = text[1:]
        if not self.high_bytes[ids].any():
            return text.replace(_CUT, "")
        return "".join(_valid(part.encode("utf-8", "surrogateescape")) for part in text.split(_CUT))


class _Memory(dict):
    """Packed ids of short words met before. When it is full, it becomes the older half and starts anew."""

    def __init__(self, codec: PieceCodec):
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > REMEMBERED_LENGTH:
            return self.codec.encode_word(word)
        ids = self.older.get(word)
        if ids is None:
            ids = self.codec.encode_word(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _valid(raw: bytes) -> str:
    out, at = [], 0
    while True:
        try:
            out.append(raw[at:].decode("utf-8"))
            return "".join(out)
        except UnicodeDecodeError as bad:
            out.append(raw[at:at + bad.start].decode("utf-8") + "\ufffd")
            at += bad.start + 1


def piece_table(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of every id of a model file; other kinds of model than this codec handles are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, trained = model.normalizer_spec, model.trainer_spec
    kinds = {p.type for p in model.pieces}
    if (trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix or rules.precompiled_charsmap
            or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces
            or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
        raise ValueError("only merge-type models with byte fallback and identity normalisation are handled")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class SharedCodec:
    """A model for use in columns: the piece table is read once on the driver and broadcast (one vocabulary, whatever the data).

    Each worker process builds the automaton once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.key, self.table = uuid.uuid4().hex, spark.sparkContext.broadcast(piece_table(path))

    def encode(self, text: Column) -> Column:
        """array<int> of ids, as the library's encoding without begin and end ids. A null or empty text has no ids."""
        key, table = self.key, self.table

        def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(key, table.value)
            for part in _slices(parts):
                yield pd.Series([codec.encode(t) for t in part])

        return F.pandas_udf(_hinted(encoded), "array<int>")(text)

    def round_trip(self, text: Column) -> Column:
        """struct<ids, text>: the ids of ``encode`` and what ``decode`` makes of them, in one pass of one worker."""
        key, table = self.key, self.table

        def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = _codec(key, table.value)
            for part in _slices(parts):
                ids = [codec.encode(t) for t in part]
                yield pd.DataFrame({"ids": ids, "text": pd.Series([codec.decode(one) for one in ids], dtype=object)})

        return F.pandas_udf(_hinted(both, pd.DataFrame), "ids array<int>, text string")(text)

    def decode(self, ids: Column) -> Column:
        """The text of an array of ids, whether it came from ``encode`` or not; a null array gives an empty text."""
        key, table = self.key, self.table

        def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(key, table.value)
            for part in _slices(parts):
                yield pd.Series(["" if one is None else codec.decode(np.asarray(one, np.int64)) for one in part], dtype=object)

        return F.pandas_udf(_hinted(decoded), "string")(ids)


def _slices(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        for at in range(0, len(part), AT_ONCE):
            yield part.iloc[at:at + AT_ONCE]


def _hinted(fn, kind=pd.Series):
    fn.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[kind]}
    return fn


def _codec(key: str, table: list[tuple[str, float, int]]) -> PieceCodec:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceCodec(table)
    return _LOADED[key]
