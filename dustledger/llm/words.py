"""Words, word hashes and word shingles of whole texts, vectorised over Arrow batches with numpy.

A word is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII, with A-Z
lower-cased. On UTF-8 bytes this is one table lookup per byte.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Characters of a word in the original text (before lower-casing).
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_RNG = np.random.default_rng(20240611)
_LETTER = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_BASE, _BLOCK + 1), _powers(_BASE_INVERSE, _BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(text: str | None) -> bytes:
    """The words of ``text`` as lower-cased UTF-8, one space between words; null gives no words."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def _block_hashes(block: bytes) -> np.ndarray:
    """One hash per word of a folded block no longer than the power tables, or of one longer word."""
    power, inverse = _POWER, _INVERSE
    if len(block) >= _BLOCK:
        power, inverse = _powers(_BASE, len(block) + 1), _powers(_BASE_INVERSE, len(block) + 1)
    raw = np.frombuffer(block, dtype=np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * power[: len(raw)], dtype=np.uint64)))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a folded text, in order; long texts go block by block."""
    if not text:
        return np.zeros(0, np.uint64)
    if len(text) < _BLOCK:
        return _block_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at >= _BLOCK:
            cut = text.rfind(b" ", at, at + _BLOCK)
            cut = text.find(b" ", at + _BLOCK) if cut < 0 else cut
            end = cut if cut >= 0 else end
        parts.append(_block_hashes(text[at:end]))
        at = end + 1
    return np.concatenate(parts)


def batches(texts: Iterable[str | None], limit: int = 1 << 19) -> Iterable[tuple[list[bytes], int]]:
    """Consecutive folded texts of together at most ``limit`` bytes (one longer text stands alone)."""
    own: list[bytes] = []
    size = 0
    for text in texts:
        norm = folded(text)
        if own and size + len(norm) + 1 > limit:
            yield own, size
            own, size = [], 0
        own.append(norm)
        size += len(norm) + 1
    if own:
        yield own, size


def shingles(norms: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the word n-gram hashes of folded texts end to end, and how many each text has.

    A text of fewer than ``n`` words, but not none, has one shingle of all its words.
    """
    counts = np.array([x.count(b" ") + 1 if x else 0 for x in norms], dtype=np.int64)
    words = word_hashes(b" ".join(x for x in norms if x))
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(counts)))[:-1]
    first = np.repeat(at - np.concatenate(([0], np.cumsum(grams)))[:-1], grams) + np.arange(grams.sum())
    length = np.repeat(np.minimum(counts, n), grams)
    total = length.astype(np.uint64)
    for k in range(n):
        reach = length > k
        total[reach] += words[first[reach] + k] * _PLACE[k]
    return mix(total), grams
