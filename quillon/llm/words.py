"""Cutting texts into the words of the byte-level pattern, over whole batches with array operations.

The pattern is: contractions ('s 't 're 've 'm 'll 'd), runs of letters, of digits or of other signs with at
most one blank before them, and white space, whose last character is left to the next word. Each rule looks at
character classes of neighbouring runs only, so the word starts of a batch follow from a few masks.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, DIGIT, BLANK = 0, 1, 2, 3
#: The characters with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SLICE_BYTES = 1 << 20  #: text handled at once; a longer text forms a slice of its own


@cache
def classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = DIGIT
    table[WHITE] = BLANK
    return table


def starts(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of word starts; ``code`` are the code points of all texts, ``doc`` the starts of the non-empty ones."""
    n = len(code)
    kind = classes()[code]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    fresh = np.zeros(n + 1, bool)
    fresh[doc] = True
    fresh[n] = True
    new |= fresh[:n]
    a = np.flatnonzero(new)
    b = np.r_[a[1:], n]
    k = kind[a]
    word = np.zeros(n, bool)
    after_space = np.zeros(len(a), bool)
    after_space[1:] = (code[a[1:] - 1] == 32) & ~fresh[a[1:]]
    word[a[(k == BLANK) | ~after_space]] = True
    white = (k == BLANK) & ~fresh[b]
    word[b[white] - 1] = True
    # contractions: a lone apostrophe that no blank precedes, then small letters of the same text
    mark = np.flatnonzero((k == OTHER) & (code[a] == 39) & (b - a == 1) & ~after_space & ~fresh[b])
    if len(mark):
        mark = mark[k[mark + 1] == LETTER]
    if len(mark):
        s, e = a[mark + 1], b[mark + 1]
        x = code[s]
        y = np.where(e - s > 1, code[np.minimum(s + 1, n - 1)], 0)
        one = np.isin(x, [115, 116, 109, 100])
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        word[s[hit]] = False
        rest = s[hit] + size[hit]
        word[rest[rest < e[hit]]] = True
    return word


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts in order, and the number of words of each text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    raw = bytes(memoryview(data)[offsets[0]:offsets[-1]]) if data is not None else b""
    offsets -= offsets[0]
    if not raw:
        return pa.array([], pa.string()), np.zeros(n, np.int64)
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(code) == len(raw):
        at, byte_of = offsets, None
    else:
        size = np.ones(len(code), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            size += code >= limit
        byte_of = np.r_[0, np.cumsum(size)]
        at = np.searchsorted(byte_of, offsets)
    doc = np.unique(at[:-1][at[1:] > at[:-1]])
    begin = np.flatnonzero(starts(code, doc))
    count = np.diff(np.searchsorted(begin, at))
    ends = np.r_[begin, len(code)]
    cuts = (ends if byte_of is None else byte_of[ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(cuts), pa.py_buffer(raw)), count


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(False).astype(np.int64)
    part = np.cumsum(size) // SLICE_BYTES
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(size)] if len(size) else np.array([0])
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield s, e
