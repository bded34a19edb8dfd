"""The draws of ``functions.numeric`` for many keys at a time, as numpy arrays inside a task."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from dustledger.functions.numeric import TWO24

_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_STEPS = np.array([[1, 0], [5, 1], [3, 5], [7, 0]])
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _one_block(texts: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the MD5 digests of texts of at most 55 bytes, as words (n, 2) in the digest's byte order."""
    n, size = len(texts), np.strings.str_len(texts)
    block = texts.astype("S64").view(np.uint8)
    block[np.arange(0, 64 * n, 64) + size] = 0x80
    words = np.ascontiguousarray(block.view("<u4").reshape(n, 16).T)
    words[14] = size * 8
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            mixed = d ^ (b & (c ^ d))
        elif kind == 1:
            mixed = c ^ (d & (b ^ c))
        else:
            mixed = b ^ c ^ d if kind == 2 else c ^ (b | ~d)
        mixed += a
        mixed += words[(_STEPS[kind, 0] * i + _STEPS[kind, 1]) % 16]
        mixed += _SINES[i]
        turn = _TURNS[kind, i % 4]
        turned = mixed << turn
        mixed >>= np.uint32(32) - turn
        turned |= mixed
        turned += b
        a, b, c, d = d, turned, b, c
    return np.stack([a + np.uint32(_START[0]), b + np.uint32(_START[1])], axis=1).astype("<u4")


@lru_cache(maxsize=8)
def _numbers(count: int) -> np.ndarray:
    return np.array([str(i).encode() for i in range(1, count + 1)])


def uniform_pairs(head: str, draws: int, tails: list[str]) -> np.ndarray:
    """(tails, draws, 2): slots 0 and 1 of ``numeric.uniform`` for the keys ``head`` + draw + tail, draws from 1 on."""
    start = np.array([head.encode()])
    texts = np.strings.add(np.strings.add(start, _numbers(draws))[None, :], np.array([t.encode() for t in tails])[:, None]).ravel()
    if texts.dtype.itemsize <= 55:
        digest = _one_block(texts).view(np.uint8).reshape(-1, 8)
    else:
        digest = np.frombuffer(b"".join(hashlib.md5(t).digest()[:8] for t in texts.tolist()), np.uint8).reshape(-1, 8)
    first = digest.view(">u8").ravel()
    pair = np.stack([first >> np.uint64(40), first >> np.uint64(16) & np.uint64(0xFFFFFF)], axis=-1).astype(float)
    return ((pair + 0.5) / TWO24).reshape(len(tails), draws, 2)
