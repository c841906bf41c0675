"""Words and characters of Arrow string columns, taken from the characters' buffer in whole-array steps.

A word is a run of letters and digits; it is hashed in lower case. Its hash is a polynomial over the random codes of its
characters modulo 2**64, read off prefix sums, so no word is ever a Python object and no pattern is run.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa

from tidemark.llm import sketch as S
from tidemark.llm import text as X

#: Bytes handled at once; a piece ends at a space or a row's end.
PIECE = 1 << 20
#: Code points beyond hold no letters or digits.
LAST = 0x32400
BASE = 0x9E3779B97F4A7C15 | 1

_tables: list[np.ndarray] = []
_powers: list[np.ndarray] = []


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter or digit, code of the lower-case character) by code point."""
    if not _tables:
        kind = np.zeros(LAST + 1, bool)
        lower = np.arange(LAST + 1, dtype=np.uint64)
        for o in range(LAST):
            c = chr(o)
            if unicodedata.category(c)[0] in "LN":
                kind[o] = True
                low = c.lower()
                if len(low) == 1:
                    lower[o] = ord(low)
        with np.errstate(over="ignore"):
            _tables.extend([kind, S.mix(lower * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))])
    return _tables[0], _tables[1]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(max(n, PIECE + 4096), b, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


def _points(raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of raw, the places in characters of the byte places starts)."""
    b = np.frombuffer(raw, np.uint8)
    if not (b & 0x80).any():
        return b, starts
    lead = np.r_[0, np.cumsum((b & 0xC0) != 0x80)]
    cp = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(cp, LAST), lead[starts]


def _raw(col: pa.Array) -> tuple[np.ndarray, bytes]:
    """(offsets, bytes) of a string array; a null is empty."""
    if col.null_count:
        col = pa.compute.fill_null(col, "")
    kind_of = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind_of)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return off, col.buffers()[2].to_pybytes()


_classes: list[np.ndarray] = []


def _class() -> tuple[np.ndarray, np.ndarray]:
    """(unusual, part) by code point, after the patterns of text.suspect(); part: 1 Latin letter, 2 look-alike script, 0 what may lie between, else 3."""
    if not _classes:
        every = "".join(chr(o) if not 0xD800 <= o < 0xE000 else " " for o in range(LAST))
        found = lambda p: [m.start() for m in re.finditer(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", p), every)]
        odd = np.ones(LAST + 1, bool)
        odd[:LAST] = False
        odd[found(X.ODD)] = True
        part = np.full(LAST + 1, 3, np.uint8)
        part[found(X.BESIDE_LATIN)] = 1
        part[found(X.BESIDE_FOREIGN)] = 2
        part[found(X.BETWEEN)] = 0
        _classes.extend([odd, part])
    return _classes[0], _classes[1]


def suspects(col: pa.Array) -> np.ndarray:
    """text.suspect() of each row, false for null; rows of ASCII alone are never touched."""
    n = len(col)
    out = np.zeros(n, bool)
    if not n or col.null_count == n or col.buffers()[2] is None:
        return out
    off, raw = _raw(col)
    lo, hi = int(off[0]), int(off[-1])
    high = np.frombuffer(raw, np.uint8)[lo:hi] >= 0x80
    if not high.any():
        return out
    # rows with a byte beyond ASCII
    many = np.r_[0, np.cumsum(high)]
    rows = np.flatnonzero(many[off[1:] - lo] > many[off[:-1] - lo])
    odd, part = _class()
    for x in range(0, len(rows), 4096):
        some = rows[x : x + 4096]
        texts = [raw[off[r] : off[r + 1]].decode("utf-8", "replace") for r in some]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), LAST)
        row = np.repeat(np.arange(len(some)), size)
        hit = np.zeros(len(some), bool)
        hit[row[odd[cp]]] = True
        kind = part[cp]
        at = np.flatnonzero(kind)
        k, r = kind[at], row[at]
        pair = (r[1:] == r[:-1]) & (((k[1:] == 1) & (k[:-1] == 2)) | ((k[1:] == 2) & (k[:-1] == 1)))
        hit[r[1:][pair]] = True
        out[some[hit]] = True
    return out


def comparables(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """text.consistent() of each row, as hashed() ignores case; only suspects become Python objects. Null stays null."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    mask = suspects(col)
    if not mask.any():
        return col
    mask = pa.array(mask)
    fixed = pa.array([X.consistent(t) for t in col.filter(mask).to_pylist()], col.type)
    return pa.compute.replace_with_mask(col, mask, fixed)


def hashed(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all rows one after another, number of words of each row); a null has none."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    counts = np.zeros(n, np.int64)
    if not n or col.null_count == n or col.buffers()[2] is None:
        return np.zeros(0, np.uint64), counts
    off, raw = _raw(col)
    letter, code = _lookup()
    out = []
    lo, total = int(off[0]), int(off[-1])
    while lo < total:
        hi = min(lo + PIECE, total)
        if hi < total:
            row_end = int(off[np.searchsorted(off, hi)])
            at = raw.find(b" ", hi, row_end)
            hi = at if at >= 0 else row_end
        first, last = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi, "left")
        rows = np.arange(first, last)
        cp, at_char = _points(raw[lo:hi], np.maximum(off[first:last] - lo, 0))
        k = letter[cp]
        split = np.zeros(len(cp) + 1, bool)
        split[at_char] = True
        begins, ends = k.copy(), k.copy()
        begins[1:] &= ~k[:-1] | split[1:-1]
        ends[:-1] &= ~k[1:] | split[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends)
        p, inverse = _power(len(cp))
        with np.errstate(over="ignore"):
            total_at = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(code[cp] * p[: len(cp)], out=total_at[1:])
            out.append(S.mix((total_at[e + 1] - total_at[s]) * inverse[s]))
        counts += np.bincount(rows[np.searchsorted(at_char, s, "right") - 1], minlength=n)
        lo = hi
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts
