"""Shingle tokens of a text, prefix lengths, and token combinations: the parts of the n-gram join that look at one set."""

from __future__ import annotations

import numpy as np

CACHED_WORDS = 200_000
#: A prefix is extended by the size of its set divided by this.
EXTENSION = 40
U = np.uint64
_MIX = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)]


class _Words(dict):
    """64-bit hashes of words, by their bytes."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * _MIX[5]
    return (x ^ (x >> U(29))) * _MIX[6]


def tokens(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; bytes.lower() and bytes.split() know ASCII letters and white space only."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = _scramble(out + hashes[k : k + n] * _MIX[k % 5])
    return np.unique(out)


def needed(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked set must share."""
    return -(-n * percent // 100)


def extension(n: int) -> int:
    """By how many tokens the prefix of a set of n is extended."""
    return n // EXTENSION


def prefix(own: np.ndarray, percent: int) -> np.ndarray:
    """The extended prefix, in the order of the hashes: two linked sets share ``extension`` + 1 tokens of theirs."""
    return own[: len(own) - needed(len(own), percent) + 1 + extension(len(own)) if len(own) else 0]


def size_class(n: int, percent: int) -> tuple[int, int, int]:
    """(class, largest size of this class, and of the next); linked sets lie in one class or in neighbouring ones."""
    at, low = 0, 1
    while True:
        high = low * 100 // percent + 1
        if n < high:
            return at, high - 1, high * 100 // percent
        at, low = at + 1, high


def combinations(own: np.ndarray, percent: int) -> list[tuple[list[int], int, int]]:
    """(keys, class, keys that a linked set shares at least) of a set, for its own class and for the next.

    The prefix is extended to the whole set, whose order is cut into blocks; a block is the combination of all tokens in
    it. A pair is compared in the class of its larger set. Two linked sets differ in few tokens, each of which changes one
    block. There are half as many blocks again as such tokens, so many stay the same in both. Blocks of less than two
    tokens have no key; if a set has so many of these that no common key is sure, the last number is below 1.
    """
    out, n = [], len(own)
    at, largest, next_largest = size_class(n, percent)
    mixed = _scramble(own)
    for number, top in ((at, largest), (at + 1, next_largest)):
        blocks = 3 * top * (100 - percent) // (100 + percent) + 3
        differ = (n + min(top, n * 100 // percent)) * (100 - percent) // (100 + percent)
        place = ((own >> U(32)) * U(blocks)) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        held = np.diff(np.append(starts, n))
        sums = np.add.reduceat(mixed, starts)
        labels = _scramble(place[starts] * _MIX[0] + U((number + 1) * int(_MIX[1]) % 2**64) + held.astype(np.uint64))
        keys = _scramble(sums + labels)[held >= 2].view(np.int64).tolist()
        out.append((keys, number, len(keys) - differ))
    return out
