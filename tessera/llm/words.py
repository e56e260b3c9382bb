"""Words of a batch of texts as arrays: vectorised splitting and 64-bit hashing of their bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .common import SPACES, chunks

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes handled at once; a longer text is cut between words.
PIECE = 1 << 21
#: A longer word is hashed with BLAKE2, as polynomial hashes of long strings can be made to collide.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Lane:
    """One hash function: a table of byte values and powers of an odd multiplier and of its inverse."""

    def __init__(self, seed: int):
        self.values = mix(np.arange(256, dtype=U) + U(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))
        r = int(mix(np.array([seed + 1001], U))[0]) | 5
        self.r, self.inv = U(r), U(pow(r, -1, 1 << 64))
        self.up = self.down = np.ones(0, U)
        self.seed = seed

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(n - 1, x, U)]), dtype=U) for x in (self.r, self.inv))
        return self.up[:n], self.down


_LANES: dict[int, _Lane] = {}


def lane(seed: int) -> _Lane:
    if seed not in _LANES:
        _LANES[seed] = _Lane(seed)
    return _LANES[seed]


@dataclass
class Words:
    """Words of texts: `count` by text; `start`, `end` in `data` and a hash by word and lane."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    count: np.ndarray
    hashes: list[np.ndarray]

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.count)])


def _piece(data: np.ndarray, lanes: int, fold: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, end = edge[::2], edge[1::2]
    out = []
    shown = _LOWER[data] if fold else data
    for k in range(lanes):
        own = lane(k)
        up, down = own.powers(len(data) + 1)
        total = np.concatenate([[U(0)], np.cumsum(own.values[shown] * up[: len(data)], dtype=U)])
        out.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93)))
    for i in np.flatnonzero(end - start > LONG):
        raw = shown[start[i] : end[i]].tobytes()
        for k in range(lanes):
            out[k][i] = U(int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=bytes([k])).digest(), "little"))
    return start, end, out


def split(texts: list, lanes: int = 1, fold: bool = False) -> Words:
    """Words of all texts (null: none). Equal words have equal hashes; fold lower-cases A-Z first."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        if to < len(data):  # cut after a separator
            back = np.flatnonzero(_SPACE[data[at:to]])
            while not len(back):
                to = min(len(data), to + PIECE)
                back = np.flatnonzero(_SPACE[data[at:to]])
            to = at + int(back[-1]) + 1
        s, e, h = _piece(data[at:to], lanes, fold)
        parts.append((s + at, e + at, h))
        at = to
    start = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    end = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    hashes = [np.concatenate([p[2][k] for p in parts]) if parts else np.zeros(0, U) for k in range(lanes)]
    count = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return Words(data, start, end, count, hashes)


def batches(texts: list, lanes: int = 1, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """split() over bounded runs of texts: (from, to, words)."""
    for i, j in chunks(texts, PIECE):
        yield i, j, split(texts[i:j], lanes, fold)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries (n - 1 fewer than entries), by doubling."""
    if len(h) < n:
        return np.zeros(0, U)
    out, have, power, width = None, 0, h, 1
    while True:
        if n & width:
            m = len(h) - have - width + 1
            out = power[:m] if out is None else mix(out[:m] * U(0x9E3779B97F4A7C15) + power[have : have + m])
            have += width
        if have == n:
            return out
        power = mix(power[:-width] * U(0xA24BAED4963EE407 + 2 * width) + power[width:])
        width *= 2
