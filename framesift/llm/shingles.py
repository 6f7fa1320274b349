"""Hashed five-word shingles of whole texts, in numpy, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix

SHINGLE = 5
#: Texts are hashed in blocks of about so many bytes.
BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_PLACE = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as they are needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.up = np.multiply.accumulate(np.concatenate([one, np.full(size - 1, self.base, np.uint64)]))
            self.down = np.multiply.accumulate(np.concatenate([one, np.full(size - 1, self.inverse, np.uint64)]))
        return self.up[:n], self.down[:n]


_POWERS = Powers(_BASE)


def prefix_hash(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P with P[j] - P[i] = base^i * hash(a[i:j]), and the inverse powers that undo base^i."""
    up, down = _POWERS.upto(len(a) + 1)
    p = np.empty(len(a) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_BYTE[a] * up[:-1], out=p[1:])
    return p, down


def _words(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (run of bytes that aren't gaps) of a block; A-Z count as a-z."""
    a = _LOWER[np.frombuffer(block, np.uint8)]
    word = np.concatenate([[False], ~_GAP[a], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    p, down = prefix_hash(a)
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64)), start


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of one long text, block by block, cut at gaps (a word longer than a block is hashed whole)."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        while end < len(text) and not _GAP[text[end]]:
            end += 1
        out.append(_words(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(docs: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of every text, in order."""
    i = 0
    while i < len(docs):
        if len(docs[i]) > BLOCK_BYTES:
            yield _long_words(docs[i])
            i += 1
            continue
        j, size = i, 0
        while j < len(docs) and (size := size + len(docs[j]) + 1) <= BLOCK_BYTES + 1:
            j += 1
        h, start = _words(b" ".join(docs[i:j]))
        ends = np.cumsum([len(d) + 1 for d in docs[i:j]])
        yield from np.split(h, np.searchsorted(start, ends[:-1]))
        i = j


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of every k consecutive words; fewer words are one shingle, none are none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    place = _PLACE if k == SHINGLE else mix(np.arange(101, 101 + k, dtype=np.uint64)) | np.uint64(1)
    if n < k:
        return mix(np.array([(words * place[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    s = words[: n - k + 1] * place[0]
    for j in range(1, k):
        s += words[j : n - k + 1 + j] * place[j]
    return mix(s)


def shingle_sets(docs: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for w in word_hashes(docs):
        s = np.sort(shingle_hashes(w))
        yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def set_digest(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    return int(mix(np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])
