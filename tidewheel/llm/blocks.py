"""Words, hashes and shingles of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes that end words: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of licence words once A-Z are lower case: 0-9, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """Words of texts: `doc` (index of text), `start`, `end` (bytes in `raw`), `hash`; `first[i]` to `first[i+1]` are text i's.

    A null or empty text has no words. Words are maximal runs of bytes with `inside` true.
    """

    def __init__(self, texts: list[str | None], lower: bool, inside: np.ndarray | None = None):
        parts = [(x or "").encode() for x in texts]
        whole = b" ".join([*parts, b""])  # each text is followed by a space
        self.raw = whole.lower() if lower else whole  # of bytes, lower() changes A-Z alone
        b = np.frombuffer(self.raw, np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])]).astype(np.int64)
        inword = (~SPACE if inside is None else inside)[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inword, [False]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.bytes = b
        self._hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            up, down = _upto(len(self.bytes) + 1)
            total = np.zeros(len(self.bytes) + 1, U)
            np.cumsum((self.bytes.astype(U) + U(1)) * up[:-1], out=total[1:])
            self._hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U))
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words that lies within one text."""
        at = np.arange(max(0, len(self.doc) - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]]
        h = np.zeros(len(at), U)
        for j in range(k):
            h = h * U(0xD6E8FEB86659FD93) + self.hash[at + j]
        return at, mix(h)
