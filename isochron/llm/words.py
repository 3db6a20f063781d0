"""Words of whole Arrow batches without a Python loop over them.

Byte-level kernels over the UTF-8 buffer of a string column: separators are all
ASCII, so no code point is split. Hashes are sums of per-byte random weights
times powers of an odd multiplier modulo 2**64, taken from running sums; equal
words get equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; one longer text is taken alone.
CHUNK_BYTES = 1 << 20


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over bytes, true inside the inclusive ranges."""
    t = np.zeros(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: Everything in ASCII but digits and lower-case letters; used after lower-casing A-Z.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """Words of a run of texts: byte spans, the text each is in, and each text's first word."""

    buf: np.ndarray  # bytes of all texts, lower-cased if asked
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray  # first[i]..first[i + 1]: words of text i


def chunks(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as UTF-8; null is empty) in runs of about ``size`` bytes."""
    at, held, total = 0, [], 0
    for i, x in enumerate(col.cast(pa.large_binary())):
        b = x.as_py() or b""
        if held and total + len(b) > size:
            yield at, held
            at, held, total = i, [], 0
        held.append(b)
        total += len(b)
    if held:
        yield at, held


def find_words(texts: list[bytes], sep: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes outside ``sep`` in each text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    word = np.empty(len(buf) + 1, dtype=bool)
    word[0] = False
    np.logical_not(sep[buf], out=word[1:])
    edge = np.flatnonzero(word[1:] != word[:-1])  # the blank between texts is a separator in every table
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, offsets)
    return Words(buf, starts, ends, np.repeat(np.arange(len(texts)), np.diff(first)), first)


_RNG = np.random.default_rng(20240501)
_WEIGHT = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        k = min(done, n - done)
        np.multiply(out[:k], np.uint64(pow(base, done, 2**64)), out=out[done : done + k])
        done += k
    return out


class Hasher:
    """64-bit hashes of words and of runs of words; keeps its tables between chunks."""

    def __init__(self) -> None:
        self.up = _powers(_STEP, 1024)
        self.down = _powers(_BACK, 1024)

    def words(self, w: Words) -> np.ndarray:
        n = len(w.buf) + 1
        if n > len(self.up):
            self.up, self.down = _powers(_STEP, n), _powers(_BACK, n)
        total = np.zeros(n, dtype=np.uint64)
        np.cumsum(_WEIGHT[w.buf] * self.up[: n - 1], out=total[1:])
        h = (total[w.ends] - total[w.starts]) * self.down[w.starts]
        return mix(h + (w.ends - w.starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` word hashes (len(h) - n + 1 of them, none if fewer words)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i]) if i else mix(h[: len(h) - n + 1])
    return out
