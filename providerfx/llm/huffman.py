"""Canonical length-limited Huffman codes: lengths from counts, vectorised packing, table-driven decoding."""

from __future__ import annotations

import numpy as np

MAX_BITS = 20
#: A checkpoint holds the bit offset of every so many tokens.
STEP = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol (0 where it does not occur) by package-merge; at most `limit` bits."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, weight = [], leaf
    for _ in range(limit - 1):
        pairs = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaf))
        weight = both[by]
    take, lens = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lens[:n] += 1
        take = 2 * (take - n)
    lens[:take] += 1
    out[order] = lens
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, prev = np.zeros(len(lengths), np.uint64), 0, 0
    at = 0
    while at < len(order):
        k = int(lengths[order[at]])
        n = int(np.searchsorted(lengths[order], k, "right")) - at
        code <<= k - prev
        codes[order[at : at + n]] = np.arange(code, code + n, dtype=np.uint64)
        code, prev, at = code + n, k, at + n
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream (most significant bit first) and the bit offset of every STEP-th token."""
    k = lengths[ids].astype(np.int64)
    ends = np.cumsum(k)
    at = ends - k
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    word, room = at >> 5, (64 - (at & 31) - k).astype(np.uint64)
    value = codes[ids] << room  # 64 bits from the word's first on
    hi, lo = value >> np.uint64(32), value & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    out[word[first]] += np.add.reduceat(hi, first)
    out[word[first] + 1] += np.add.reduceat(lo, first)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::STEP].astype(np.uint64)


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and code length for each value of the next `bits` bits."""
    bits = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    width = (1 << (bits - lengths[used].astype(np.int64))).astype(np.int64)
    symbol, size = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    n = int(width.sum())
    symbol[:n], size[:n] = np.repeat(used, width), np.repeat(lengths[used], width)
    return symbol, size, bits


def unpack(payload: bytes, marks: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids: all stretches between checkpoints are decoded side by side, a token of each at a time."""
    symbol, size, bits = table
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    out = np.zeros((len(marks), STEP), np.uint32)
    at, shift = marks.astype(np.int64), np.uint64(64 - bits)
    left = n - STEP * np.arange(len(marks))
    for k in range(min(STEP, n)):
        if k == left[-1]:  # only the last stretch can be short
            at = at[:-1]
            if not len(at):
                break
        look = ((eight[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)) >> shift).astype(np.int64)
        out[: len(at), k] = symbol[look]
        at = at + size[look]
    return out.ravel()[:n]
