"""Words, word hashes and word shingles of a whole Arrow batch of texts at once, in numpy.

Texts stay the UTF-8 bytes of the Arrow column; a word never crosses a text. A word's 64-bit hash is the sum of
one random number for each byte and its place in the word, mixed with its length; so it has no structure that
words could share, costs the same for each byte, and there is no Python work for each word. Long columns go in blocks.
"""

from __future__ import annotations

import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 4 << 20
#: Bytes that separate words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and bytes of non-ASCII characters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[ord("A") : ord("Z") + 1] = NOT_LETTER[ord("a") : ord("z") + 1] = NOT_LETTER[128:] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: shift-xor and odd multiplications."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: A random number for each of PLACES places in a word and each byte; beyond, that number mixed with how often the places are through.
PLACES = 64
_TERMS = mix(mix(np.arange(PLACES * 256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x2545F4914F6CDD1D))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and len + 1 offsets. Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of all texts: doc (row), start and end (bytes), hash; first: len(texts) + 1 word offsets."""

    def __init__(self, column, separators: np.ndarray = SPACE):
        data, offsets = text_bytes(column)
        self.n_docs = len(offsets) - 1
        starts, ends, hashes = [], [], []
        cuts = _cuts(data, offsets, separators)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, h = _block(data[a:b], edge[a : b + 1], separators)
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(h)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.end, self.hash = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)
        self.offsets = offsets


def _cuts(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> list[int]:
    """Block bounds at which no word goes on."""
    cuts, n = [0], len(data)
    while cuts[-1] < n:
        at = cuts[-1] + BLOCK
        if at >= n:
            cuts.append(n)
            break
        ends = offsets[np.searchsorted(offsets, at)]  # the next text's start is always a bound
        near = np.flatnonzero(separators[data[at:ends]][:65536])
        if not len(near):
            near = np.flatnonzero(separators[data[at:ends]])
        cuts.append(int(at + near[0]) if len(near) else int(ends))
    return cuts


def _block(data: np.ndarray, edge: np.ndarray, separators: np.ndarray):
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~separators[data]
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(s):
        return s, e, np.zeros(0, np.uint64)
    size = e - s
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    term = _TERMS[((place & (PLACES - 1)) << 8) | LOWER[data[word]]]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        term[far] = mix(term[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return s, e, mix(np.add.reduceat(term, first) + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every shingle; a text of 1 to size - 1 words is one shingle."""
    h, n = words.hash, len(words.hash)
    if n >= size:
        total = h[: n - size + 1] * _PLACE[0]
        for j in range(1, size):
            total = total + h[j : n - size + 1 + j] * _PLACE[j]
        inside = words.doc[: n - size + 1] == words.doc[size - 1 :]
        at = np.flatnonzero(inside)
        full = mix(total[at] + np.uint64(size))
    else:
        at, full = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if not len(short):
        return full, words.doc[at], at
    value = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        has = words.count[short] > j
        value[has] += h[words.first[short[has]] + j] * _PLACE[j]
    value = mix(value + words.count[short].astype(np.uint64))
    out, doc, first = np.concatenate([full, value]), np.concatenate([words.doc[at], short]), np.concatenate([at, words.first[short]])
    order = np.argsort(doc, kind="stable")
    return out[order], doc[order], first[order]


def shingle_sets(column, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within the text; and len + 1 offsets."""
    words = Words(column)
    value, doc, _ = shingles(words, size)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(words.n_docs + 1))


def by_size(batches, text: str, most: int = 2 << 20):
    """Record batches cut to about so many bytes of text each, so that memory doesn't depend on rows in a batch."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            b = min(batch.num_rows, max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right"))))
            yield batch.slice(a, b - a)
            a = b


@contextmanager
def uncollected():
    """No garbage collection inside: millions of live strings without cycles, which collections would walk again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
