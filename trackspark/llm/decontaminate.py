"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item, and each window of a document of an item's number of words, has a 64-bit SimHash over
its five-word shingles. A multi-index of BLOCKS blocks finds every item within RADIUS bits of a window: two
fingerprints that close differ by RADIUS // BLOCKS bits at most in some block, and all values of a block that
near are looked up. Candidates are verified by exact similarity of shingles weighted by how often each occurs:
sum of the lesser over sum of the greater weights. A window that shares no shingle with an item has
similarity 0 to it, so only windows around shared shingles are fingerprinted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, by_size, shingles

SIZE = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ by 9.7 bits on average, with a standard deviation of 2.9.
RADIUS, BLOCKS = 23, 6
#: Items of one pass over the documents, and bytes of their texts: bound what is broadcast. More items take more passes.
ITEMS, ITEM_BYTES = 4096, 8 << 20
_BITS = np.arange(64, dtype=np.uint64)


def block_bounds(blocks: int = BLOCKS) -> list[int]:
    return [64 * i // blocks for i in range(blocks + 1)]


def masks(width: int, near: int) -> np.ndarray:
    """All values of width bits with near bits or fewer."""
    return np.array([sum(1 << b for b in bits) for k in range(near + 1) for bits in combinations(range(width), k)], np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return ((h[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """The SimHash of summed signs: bits of positive sums."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=-1, dtype=np.uint64)


class Index:
    """Items: id, words and shingle bag of each; all shingles sorted, with their items; the multi-index."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.string()))
        value, doc, _ = shingles(words, SIZE)
        self.ids, self.length = np.array(ids, np.int64), words.count
        order = np.argsort(value, kind="stable")
        self.shingle, self.item = value[order], doc[order]
        first = np.searchsorted(doc, np.arange(len(ids) + 1))  # shingles come by text
        self.bags = [np.unique(value[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        # An item of fewer words than a shingle is one shingle of its own size.
        short = np.flatnonzero((self.length > 0) & (self.length < SIZE))
        self.short = {int(k): dict(zip(*_grouped(value[first[short[self.length[short] == k]]], short[self.length[short] == k]), strict=True)) for k in np.unique(self.length[short])}
        self.prints = np.array([fingerprint((signs(v) * n[:, None]).sum(axis=0)) for v, n in self.bags], np.uint64)
        self.bounds, self.tables, self.masks = block_bounds(), [], []
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            key = (self.prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(key, kind="stable")
            self.tables.append((np.searchsorted(key[order], np.arange((1 << (b - a)) + 1, dtype=np.uint64)), order))
            self.masks.append(masks(b - a, RADIUS // BLOCKS))

    def near(self, print_: np.uint64) -> np.ndarray:
        """Items whose fingerprints are within RADIUS of this one."""
        found = []
        for (first, order), mask, a, b in zip(self.tables, self.masks, self.bounds[:-1], self.bounds[1:], strict=True):
            key = (((print_ >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)) ^ mask).astype(np.int64)
            low, n = first[key], first[key + 1] - first[key]
            low, n = low[n > 0], n[n > 0]
            found.append(order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        items = np.unique(np.concatenate(found))
        return items[np.bitwise_count(self.prints[items] ^ print_) <= RADIUS]

    def similarity(self, item: int, window: np.ndarray) -> float:
        value, n = self.bags[item]
        own, m = np.unique(window, return_counts=True)
        _, i, j = np.intersect1d(value, own, assume_unique=True, return_indices=True)
        least = np.minimum(n[i], m[j]).sum()
        return float(least / (n.sum() + m.sum() - least))


def _grouped(value: np.ndarray, item: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Distinct values, and the items that have each."""
    known, at = np.unique(value, return_inverse=True)
    return known.tolist(), [item[at == i].tolist() for i in range(len(known))]


def _short_matches(index: Index, words: Words):
    """(row, item, 1.0, first word, words) of the first place of each item of fewer words than a shingle, in texts of any length."""
    for size, items in index.short.items():
        value, doc, first = shingles(words, size)
        known = np.array(sorted(items), np.uint64)
        at = np.searchsorted(known, value)
        at[at == len(known)] = 0
        hit = np.flatnonzero((known[at] == value) & (words.count[doc] >= size))
        _, once = np.unique(np.column_stack([doc[hit], at[hit]]), axis=0, return_index=True)
        for i in hit[once]:
            for item in items[int(value[i])]:
                yield int(doc[i]), int(index.ids[item]), 1.0, int(first[i] - words.first[doc[i]]), size


def matches(index: Index, column, similarity: float):
    """(row, item, similarity, first word, words) of the best window of each text for each item."""
    words = Words(column)
    yield from _short_matches(index, words)
    value, doc, first = shingles(words, SIZE)
    at = np.searchsorted(index.shingle, value)
    at[at == len(index.shingle)] = 0
    hit = np.flatnonzero(index.shingle[at] == value) if len(index.shingle) else np.zeros(0, np.int64)
    for row in np.unique(doc[hit]):
        own = hit[doc[hit] == row]
        a, b = np.searchsorted(doc, [row, row + 1])
        place, n_words, begin = first[own] - words.first[row], int(words.count[row]), a
        low = np.searchsorted(index.shingle, value[own])
        high = np.searchsorted(index.shingle, value[own], "right")
        items = index.item[np.repeat(low, high - low) + _ramp(high - low)]
        places = np.repeat(place, high - low)
        best: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(index.length[items]).tolist():
            if size < SIZE:
                continue  # _short_matches has them
            p = np.unique(places[index.length[items] == size])
            starts = np.unique(np.minimum(np.maximum((p[:, None] - np.arange(size - SIZE + 1)).ravel(), 0), max(0, n_words - size)))
            wide = max(1, min(size, n_words) - SIZE + 1)
            for start, print_ in zip(starts.tolist(), _prints(value[begin:b], starts, wide), strict=True):
                window = value[begin + start : begin + start + wide]
                for item in index.near(print_).tolist():
                    if index.length[item] == size:
                        like = index.similarity(item, window)
                        if like >= similarity and like > best.get(item, (0.0, 0, 0))[0]:
                            best[item] = like, start, min(size, n_words)
        for item, found in best.items():
            yield int(row), int(index.ids[item]), *found


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _prints(value: np.ndarray, starts: np.ndarray, wide: int) -> np.ndarray:
    """Fingerprints of the windows of wide shingles at starts: running sums over each stretch of windows."""
    out = np.zeros(len(starts), np.uint64)
    for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > wide) + 1):
        if not len(part):
            continue
        for some in np.array_split(part, -(-len(part) // 4096)):
            a, b = starts[some[0]], starts[some[-1]] + wide
            sums = np.zeros((b - a + 1, 64), np.int32)
            np.cumsum(signs(value[a:b]), axis=0, out=sums[1:])
            out[some] = fingerprint(sums[starts[some] - a + wide] - sums[starts[some] - a])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item, similarity, start_word, n_words) of the best window of each document for each item it leaks.

    Words are runs of other than space and characters 9 to 13, with A-Z as a-z. A document shorter than an
    item is one window. Null and empty texts, and items without words, match nothing. Repeated rows match
    alike. An item of fewer than five words is found wherever its words follow each other. The items are broadcast in
    blocks of ITEMS and ITEM_BYTES, one pass over the documents for each block.
    """
    items = benchmark.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i is not null and trim(t) != ''")
    many, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(-(-many // ITEMS), -(-size // ITEM_BYTES))
    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, `{item}` bigint, similarity double, start_word bigint, n_words bigint"
    docs, out = docs.select(id, text), None
    for k in range(max(1, blocks)):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(max(1, blocks))) == k).collect()
        held = docs.sparkSession.sparkContext.broadcast(Index([r["i"] for r in rows], [r["t"] for r in rows]))

        def run(batches, held=held):
            index = held.value
            for batch in by_size(batches, text):
                found = list(matches(index, batch.column(text), similarity))
                own = batch.column(id).take(pa.array([x[0] for x in found], pa.int64()))
                rest = [pa.array([x[j] for x in found], kind) for j, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([own, *rest], [id, item, "similarity", "start_word", "n_words"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
