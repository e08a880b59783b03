"""NumPy views of many texts at once: bytes, word spans, hashes. Used inside tasks on bounded slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE_BYTES = 1 << 20
_WS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def slices(texts: Iterable[bytes], limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts in lists of about ``limit`` bytes; a longer text is a list of its own, never cut."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by a line feed, and where each text (with it) stops."""
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), stops


def spans(separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs where ``separator`` is false."""
    inside = np.zeros(len(separator) + 2, np.int8)
    inside[1:-1] = ~separator
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans(_WS[buf])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class SpanHasher:
    """64-bit hashes of byte spans: differences of one running polynomial sum, made independent of the place."""

    def __init__(self, n: int = SLICE_BYTES + 4096):
        self._grow(n)

    def _grow(self, n: int) -> None:
        self.pow, self.inv = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)

    def __call__(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(values) + 1 > len(self.pow):
            self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.pow[:len(values)], out=total[1:])
        return mix((total[stop] - total[start]) * self.inv[start] + (stop - start).astype(np.uint64))


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
