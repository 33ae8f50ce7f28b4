"""Vectorised kernels over batches of UTF-8 texts: spans of words, hashes, rolling windows, minimizers.

A batch of texts is one byte array (16 zero bytes of padding) with document offsets; no text becomes a
Python string here, and work is proportional to the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the 64-bit mixer and bases of the rolling hashes.
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SEEDS = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
LONG_WORD = 256
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)

WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: True for the bytes of a word `[^\x20\x09-\x0D]+`.
NOT_WHITE = np.array([b not in WHITE for b in range(256)])
#: True for the bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: A-Z to a-z, other bytes unchanged.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Padded bytes and n+1 offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string() if pa.types.is_string(col.type) else pa.large_binary() if pa.types.is_binary(col.type) else col.type)
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("" if pa.types.is_large_string(col.type) else b"", col.type))
    if not len(col):
        return np.zeros(16, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return np.concatenate([data, np.zeros(16, np.uint8)]), offs - offs[0]


def runs_of_docs(offs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes each, or of one longer document."""
    out, lo, n = [], 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out


def spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and n+1 offsets into them by document."""
    n = int(offs[-1])
    m = is_word[buf[:n]]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    full = offs[:-1] < offs[1:]
    a, z = offs[:-1][full], offs[1:][full] - 1
    s[a], e[z] = m[a], m[z]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= M1
    x ^= x >> U(27)
    x *= M2
    x ^= x >> U(31)
    return x


def load(buf: np.ndarray) -> np.ndarray:
    """View of the eight bytes that start at every position."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the given byte spans."""
    eight, n = load(buf), ends - starts
    h = mix((eight[starts] & KEEP[np.minimum(n, 8)]) ^ (SEEDS[seed] * (n.astype(U) + U(1))))
    at, k = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
    while at.size:
        left = n[at] - k
        h[at] = mix((h[at] * SEEDS[1 - seed]) ^ (eight[starts[at] + k] & KEEP[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 8
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = U(int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little"))
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.ones(max(n, 1 << 16), U)
            p[1:] = U(b)
            out.append(np.cumprod(p))
        _POWERS[base] = tuple(out)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def rolling(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of the windows of `size` consecutive values, one for each start."""
    if len(h) < size:
        return np.zeros(0, U)
    up, down = powers(BASES[which], len(h) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(h * up[:-1])])
    return mix((total[size:] - total[:-size]) * down[: len(h) - size + 1])


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over every w consecutive values, by doubling."""
    k = 1
    while 2 * k <= w:
        x, k = op(x[:-k], x[k:]) if len(x) > k else x[:0], 2 * k
    return x if k == w or not len(x) else op(x[: len(x) - (w - k)], x[w - k :]) if len(x) > w - k else x[:0]


def inside(offs: np.ndarray, size: int, total: int) -> np.ndarray:
    """True for the starts whose window of `size` ends in the same document; offs: in the unit of the windows."""
    ok = np.zeros(max(0, total - size + 1), bool)
    d = np.zeros(len(ok) + 1, np.int32)
    a, z = offs[:-1], np.maximum(offs[:-1], offs[1:] - size + 1)
    keep = z > a
    np.add.at(d, a[keep], 1)
    np.add.at(d, z[keep], -1)
    ok[:] = np.cumsum(d[:-1]) > 0
    return ok


def minimizers(gram: np.ndarray, w: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of the w gram hashes inside each window, and which gram positions are such a smallest one.

    Equal windows hold equal grams, so both occurrences select the gram at the same place: a window can only
    occur twice if its smallest gram hash is selected at two positions.
    """
    low = sliding(gram, w)[: len(valid)]
    top = np.where(valid, low, U(0))
    pad = np.zeros(w - 1, U)
    best = sliding(np.concatenate([pad, top, pad]), w, np.maximum)
    chosen = best[: len(gram)] == gram
    some = sliding(np.concatenate([pad.astype(bool), valid, pad.astype(bool)]), w, np.logical_or)[: len(gram)]
    return low, chosen & some


def gathered(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of all spans, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(total)
