"""Numpy hashes of words, word shingles and byte grams of one text (whole-array operations, no per-word Python)."""

from __future__ import annotations

import numpy as np

U = np.uint64
MUL = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


with np.errstate(over="ignore"):
    BYTE = mix((np.arange(256, dtype=U) + U(1)) * U(MUL))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_POW = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MUL**i and MUL**-i modulo 2**64 for i < n; kept for the longest n so far up to 2 Mi."""
    if _POW[0].size >= n:
        return _POW[0][:n], _POW[1][:n]
    size = 1 << max(16, (n - 1).bit_length())
    up = np.full(size, U(MUL)); up[0] = 1
    down = np.full(size, U(pow(MUL, -1, 1 << 64))); down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= 1 << 21:
        _POW[:] = [up, down]
    return up[:n], down[:n]


def word_hashes(text: bytes, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than 0x20, 0x09-0x0D) of the text, A-Z lower-cased, in order."""
    raw = np.frombuffer(text, np.uint8)
    parts, at = [], 0
    while at < raw.size:
        end = at + block
        while end < raw.size and not SPACE[raw[end]]:  # to the end of the word
            nxt = np.flatnonzero(SPACE[raw[end:end + 4096]])
            end += int(nxt[0]) if nxt.size else 4096
        parts.append(_block_hashes(raw[at:end]))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, U)


def _block_hashes(raw: np.ndarray) -> np.ndarray:
    word = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    starts, ends = edge[::2], edge[1::2]
    if not starts.size:
        return np.empty(0, U)
    up, down = powers(raw.size)
    value = BYTE[LOWER[raw]]
    value *= up
    value[~word] = 0
    h = np.add.reduceat(value, starts)
    h *= down[starts]
    h += (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(h)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words the whole sequence as one; else empty."""
    w = word_hashes(text) if text else np.empty(0, U)
    if not w.size:
        return w
    m = min(n, w.size)
    s = np.zeros(w.size - m + 1, U)
    for i in range(m):
        s += w[i:w.size - m + 1 + i] * U(pow(MUL, 2 * i + 3, 1 << 64))
    if m < n:
        s += U(m)
    return np.unique(mix(s))


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string of the array (no lower-casing), one per start."""
    n = raw.size - k + 1
    if n <= 0:
        return np.empty(0, U)
    up, down = powers(raw.size + 1)
    s = np.zeros(raw.size + 1, U)
    np.cumsum(BYTE[raw] * up[:raw.size], out=s[1:])
    h = s[k:] - s[:n]
    h *= down[:n]
    return mix(h)
