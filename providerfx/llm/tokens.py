"""Batch tokenization for Arrow functions.

A text is cut where a space or line feed follows a character that is no white space, and where one of PUNCTUATION
follows an ASCII letter. No pre-token of the two tokenizers spans such a place and none looks back, so the ids of a
text are those of its cut pieces, one after another; special strings hold no such place and stay whole. Each distinct
piece is encoded once by the library and kept in a bounded table of the process, under two hashes of its bytes; texts
of any length are handled in byte-balanced ranges. Many pieces are one text to the library, which costs less than one
by one: words of plain letters are told apart by ids that only begin or only end a word, others by offsets.
"""

from __future__ import annotations

import json
import os

import numpy as np

from providerfx.llm.blocks import member, release
from providerfx.llm.words import flat, gathered, span_hash

RANGE_BYTES = 4 << 20
TABLE_PIECES = 3 << 18
#: Pieces that the library sees as one text, and such texts that it gets at once.
GROUP_PIECES = 128
BATCH_GROUPS = 32
PUNCTUATION = np.array([chr(b) in '.,;:!?()"' for b in range(256)])
LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def letters(b: np.ndarray) -> np.ndarray:
    """True for the bytes of ASCII letters and of U+00C0 to U+027F but two signs and U+0130, whose lower case is not a letter alone.

    All these are as they are in NFC.
    """
    out = LETTER[b]
    two = np.flatnonzero((b >= 0xC3) & (b <= 0xC9))
    two = two[two + 1 < len(b)]
    second = b[two + 1]
    two = two[((b[two] != 0xC3) | ((second != 0x97) & (second != 0xB7))) & ((b[two] != 0xC4) | (second != 0xB0))]
    out[two] = out[two + 1] = True
    return out


def cut_marks(buf: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Safe places in [lo, hi): True where the byte is a space or line feed right after a character that is certainly not white space, or punctuation after a letter."""
    b = buf[lo:hi]
    ws = (b == 0x20) | (b == 0x0A)
    m = ws.copy()
    m[1:] &= ~ws[:-1]
    if not len(m):
        return m
    m[0] = bool(lo) and bool(ws[0]) and int(buf[lo - 1]) not in (0x20, 0x0A)
    at = np.flatnonzero(m)
    p = buf[lo + at - 1]
    bad = (p == 0x09) | (p == 0x0B) | (p == 0x0C) | (p == 0x0D)
    high = np.flatnonzero(p >= 0x80)
    if high.size:  # white space beyond ASCII ends in these ways; a few other characters do too, which only makes longer pieces
        g = lo + at[high]
        bad[high] |= ((buf[g - 2] == 0xC2) & ((p[high] == 0x85) | (p[high] == 0xA0))) | (np.isin(buf[np.maximum(g - 3, 0)], (0xE1, 0xE2, 0xE3)) & np.isin(buf[g - 2], (0x9A, 0x80, 0x81)))
    m[at[bad]] = False
    m[1:] |= PUNCTUATION[b[1:]] & LETTER[b[:-1]]
    return m


def ranges(buf: np.ndarray, offs: np.ndarray, limit: int = RANGE_BYTES):
    """Byte ranges of about `limit`, cut at ends of documents or at safe places inside long ones."""
    n, lo = int(offs[-1]), 0
    while lo < n:
        hi = lo + limit
        if hi >= n:
            hi = n
        else:
            end = int(offs[np.searchsorted(offs, hi, "right") - 1])
            if end > lo + limit // 2:
                hi = end
            else:
                stop = int(offs[np.searchsorted(offs, hi, "right")])
                while hi < stop:
                    found = np.flatnonzero(cut_marks(buf, hi, min(stop, hi + 65536)))
                    if found.size:
                        hi += int(found[0])
                        break
                    hi = min(stop, hi + 65536)
        yield lo, hi
        lo = hi


class Encoder:
    """Ids or counts of texts by one tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.kind, self.mark = word_marks(self.lib)
        self.reset()

    def reset(self) -> None:
        """An empty table: sorted hashes of pieces, second hashes, their rows, and the ids of all rows one after another."""
        self.keys, self.checks, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.offs = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def plain(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pieces, that lie one after another, are one word of LETTERs to the library, and where the letters begin."""
        if not self.kind:
            return np.zeros(len(starts), bool), ends
        b = buf[starts[0] : ends[-1]]
        of = lambda flags: np.add.reduceat(flags, starts - starts[0], dtype=np.int64)
        n, size = of(letters(b)), ends - starts
        if self.kind == "end":  # white space before the word has no ids
            return (n > 0) & (n + of((b == 0x20) | (b == 0x0A)) == size), ends - n
        return (n > 0) & (n == size - 1) & (buf[starts] == 0x20), ends - n  # one space is part of the word

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of LETTERs, and how many each has."""
        n = ends - starts
        offs = np.concatenate([[0], np.cumsum(n + 1)])
        text = np.full(offs[-1], 0x20, np.uint8)
        text[gathered(offs[:-1] + 1, n)] = buf[gathered(starts, n)]
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        heads = np.append(np.arange(0, len(n), GROUP_PIECES), len(n))
        for lo in range(0, len(heads) - 1, BATCH_GROUPS):
            own = heads[lo : lo + BATCH_GROUPS + 1]
            got = self.lib.encode_batch_fast([text[a:z].tobytes().decode() for a, z in zip(offs[own[:-1]].tolist(), offs[own[1:]].tolist())], add_special_tokens=False)
            i = np.concatenate([np.array(e.ids, np.uint32) for e in got])
            k = np.flatnonzero(self.mark[i])
            if len(k) != own[-1] - own[0]:
                raise RuntimeError("the tokenizer does not mark words as expected")
            ids.append(i)
            lens.append(np.diff(np.append(k, len(i))) if self.kind == "begin" else np.diff(np.append(-1, k)))
        return np.concatenate(ids), np.concatenate(lens)

    def joined(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie one after another in buf, and how many each has.

        Neighbours that meet in a safe place are one text to the library; a token belongs to the piece in which it starts.
        """
        n = len(offs) - 1
        safe = cut_marks(buf, 0, int(offs[-1]))[offs[:-1]]
        safe[::GROUP_PIECES] = False
        heads = np.append(np.flatnonzero(~safe), n)
        chars = np.concatenate([[0], np.cumsum((buf[: offs[-1]] & 0xC0) != 0x80)])[offs]
        ids, starts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(heads) - 1, BATCH_GROUPS):
            own = heads[lo : lo + BATCH_GROUPS + 1]
            texts = [buf[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(offs[own[:-1]].tolist(), offs[own[1:]].tolist())]
            for e, base in zip(self.lib.encode_batch(texts, add_special_tokens=False), chars[own[:-1]].tolist()):
                got = e.ids
                ids.append(np.array(got, np.uint32))
                starts.append(np.fromiter((a for a, _ in e.offsets), np.int64, len(got)) + base)
        piece = np.searchsorted(chars, np.concatenate(starts), "right") - 1
        return np.concatenate(ids), np.bincount(piece, minlength=n)

    def add(self, keys: np.ndarray, checks: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        first = len(self.offs) - 1
        order = np.argsort(~plain, kind="stable")
        n = int(plain.sum())
        ids, lens = self.words(buf, starts[order[:n]], ends[order[:n]])
        others = ends[order[n:]] - starts[order[n:]]
        more, more_lens = self.joined(buf[gathered(starts[order[n:]], others)], np.concatenate([[0], np.cumsum(others)]))
        self.ids = np.concatenate([self.ids, ids, more])
        self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(np.concatenate([lens, more_lens]))])
        rows = np.empty(len(keys), np.int32)
        rows[order] = np.arange(first, first + len(keys), dtype=np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks, self.rows = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.checks, checks), (self.rows, rows)))

    def lookup(self, buf: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces in [lo, hi) and their rows in the table."""
        m = cut_marks(buf, lo, hi)
        a = offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi)]
        m[a - lo] = True
        m[0] = True
        starts = np.flatnonzero(m) + lo
        ends = np.append(starts[1:], hi)
        plain, first_letter = self.plain(buf, starts, ends)
        begin = np.where(plain, first_letter, starts)
        if self.kind == "end":  # such words are the same in upper and lower case
            upper = np.flatnonzero((buf[lo:hi] >= 65) & (buf[lo:hi] <= 90)) + lo
            upper = upper[plain[np.searchsorted(starts, upper, "right") - 1]]
            buf = buf.copy()
            buf[upper] += 32
        key, first, inv = np.unique(span_hash(buf, begin, ends) ^ plain.astype(np.uint64), return_index=True, return_inverse=True)
        check = span_hash(buf, begin[first], ends[first], 1)
        if len(self.keys) + len(key) > TABLE_PIECES and len(self.keys):
            self.reset()
        new = np.flatnonzero(~member(key, self.keys))
        if len(new):
            at = first[new]
            self.add(key[new], check[new], buf, begin[at], ends[at], plain[at])
        at = np.searchsorted(self.keys, key)
        if (self.checks[at] != check).any():
            raise RuntimeError("two pieces of text have the same hash")
        return starts, self.rows[at].astype(np.int64)[inv]

    def counts(self, col) -> np.ndarray:
        buf, offs = flat(col)
        out = np.zeros(len(offs) - 1, np.int64)
        for lo, hi in ranges(buf, offs):
            starts, rows = self.lookup(buf, offs, lo, hi)
            d0 = int(np.searchsorted(offs, lo, "right")) - 1
            doc = np.searchsorted(offs, starts, "right") - 1 - d0
            got = np.bincount(doc, weights=(self.offs[rows + 1] - self.offs[rows]).astype(float)).astype(np.int64)
            out[d0 : d0 + len(got)] += got
        return out

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n+1 offsets."""
        buf, offs = flat(col)
        n, parts = np.zeros(len(offs) - 1, np.int64), [np.zeros(0, np.uint32)]
        for lo, hi in ranges(buf, offs):
            starts, rows = self.lookup(buf, offs, lo, hi)
            lens = self.offs[rows + 1] - self.offs[rows]
            parts.append(self.ids[gathered(self.offs[rows], lens)])
            d0 = int(np.searchsorted(offs, lo, "right")) - 1
            got = np.bincount(np.searchsorted(offs, starts, "right") - 1 - d0, weights=lens.astype(float)).astype(np.int64)
            n[d0 : d0 + len(got)] += got
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])


def word_marks(lib) -> tuple[str, np.ndarray]:
    """How ids tell words of plain letters apart, by the tokenizer's own description: which ids "begin" or "end" a word; else neither."""
    said = json.loads(lib.to_str())
    none = "", np.zeros(0, bool)
    size = max(said["model"]["vocab"].values(), default=-1) + 1
    mark, before = np.zeros(size, bool), said["pre_tokenizer"] or {}
    if said["model"]["type"] != "BPE" or any(t["normalized"] for t in said["added_tokens"]):
        return none
    if said["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
        mark[[i for t, i in said["model"]["vocab"].items() if t.startswith("\u0120")]] = True  # the space of this alphabet
        return "begin", mark
    kinds = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
    steps = before.get("pretokenizers", [])
    suffix = said["model"].get("end_of_word_suffix")
    if suffix and kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["use_regex"]:
        mark[[i for t, i in said["model"]["vocab"].items() if t.endswith(suffix)]] = True
        return "end", mark
    return none


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file; memory that the last batch left is given back first."""
    release()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
