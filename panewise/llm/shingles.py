"""Hashes of words and sets of shingles, a batch of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += np.uint8(32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# The bytes of a little-endian number that a word of 0 to 8 bytes fills.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

# Bytes that are hashed at once; a longer text is cut between words.
_AT_ONCE = 1 << 22
# Longer words are hashed one by one.
_LONG = 512


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> _SHIFT)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first byte) of each word, A-Z as a-z. Equal words have equal hashes.

    Eight bytes at a time are put into the hash and mixed, each step of which can be undone: words of up to
    eight bytes never meet others of their length, and longer ones only as random numbers would.
    """
    if len(data) > _AT_ONCE and not data.isspace():
        cut = max(data.rfind(s, 0, _AT_ONCE) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut > 0:
            first, second = word_hashes(data[:cut]), _shifted(word_hashes(data[cut:]), cut)
            return np.concatenate([first[0], second[0]]), np.concatenate([first[1], second[1]])
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = ~_SPACE[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    low = np.zeros(len(codes) + 8, np.uint8)
    low[: len(codes)] = _LOWER[codes]
    eight = np.ndarray((len(codes) + 1,), "<u8", buffer=low, strides=(1,))  # the eight bytes from each place on
    h = mixed((end - start).astype(np.uint64) * _PRIME + _MIX)
    for i in np.flatnonzero(end - start > _LONG).tolist():
        digest = hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, np.uint64)[0]
    rest = np.flatnonzero(end - start <= _LONG)
    at, left = start[rest], (end - start)[rest]
    while len(rest):
        h[rest] = mixed((h[rest] ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _PRIME)
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return h, start


def _shifted(words: tuple[np.ndarray, np.ndarray], by: int) -> tuple[np.ndarray, np.ndarray]:
    return words[0], words[1] + by


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `size` words.

    With fewer words the whole sequence is the only shingle; without words there is none.
    """
    data = b"\n".join(t or b"" for t in texts)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    word, place = word_hashes(data)
    bound = np.searchsorted(place, np.r_[0, ends])
    n = len(word)
    rolled = np.full(max(0, n - size + 1), np.uint64(size))
    for k in range(size):
        rolled = mixed(rolled + word[k : k + len(rolled)] * _PRIME)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            h = np.full(1, np.uint64(b - a))
            for k in range(a, b):
                h = mixed(h + word[k : k + 1] * _PRIME)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
