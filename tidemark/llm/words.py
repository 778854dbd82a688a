"""Words of UTF-8 texts as 64-bit numbers, computed for many texts at once.

A word is a run of bytes other than the six ASCII white-space bytes. Equal words get equal
numbers. Words of up to ``LONG`` bytes are hashed together, by powers of a base modulo 2^64; sums of
such powers can cancel by a pattern once a text has a thousand bytes, so longer words, which
are rare, get a digest each.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20  # texts hashed at once; a longer text is a chunk of its own


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest(data: bytes) -> int:
    """64 bits of a digest, which no pattern in the data can make equal."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class Powers:
    """Powers of an odd base modulo 2^64, and their inverses, as far as asked for."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 2)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, inverse))])


def chunks(texts: list[bytes]):
    """Ranges of texts of about CHUNK_BYTES bytes each."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_numbers(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of ``texts`` in order, and for each text where its words begin
    (one entry more than there are texts)."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    space = np.concatenate([[True], _SPACE[data]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    first, last = edge[0::2], edge[1::2]
    powers.reach(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[:len(data)], out=total[1:])
    number = (total[last] - total[first]) * powers.down[first]
    number = mixed(number + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(last - first > LONG).tolist():
        number[i] = digest(joined[first[i]:last[i]])
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return number, np.searchsorted(first, begins)
