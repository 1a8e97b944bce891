"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces of like length share a matrix. In each round every row merges its leftmost pair of least rank;
pair ranks come from an open-addressing hash table, and rows close up behind the merge. Pieces longer
than the widest bucket are rows of their own, where a round merges all places of the least pair as long
as that provably equals merging them one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .words import uncollected

#: Matrix widths; a longer piece is encoded alone.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128)
#: Cells of one matrix, so that memory stays bounded.
CELLS = 1 << 20
#: Parts of text, and pieces, kept with their ids in each Python worker; when full, the store starts anew.
MEMO = 500_000
#: Longer parts are not kept.
MEMO_LEN = 64
NONE = np.int32(1 << 30)
#: A single space between two characters that aren't white space always begins a match of the pattern.
_PART = re.compile(r"(?<=\S) (?=\S)")
#: Under this pattern Latin letters, and then marks that are neither letter, number nor space, are a match each.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([^\w\s]*)").fullmatch
_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TOUCHING = ["  ", *(f" {x}" for x in _BLANKS), *(f"{x} " for x in _BLANKS)]


class Ranks:
    """A rank file: token bytes by id, and the hash table from a pair of ids to the merged id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            rank = {base64.b64decode(token): int(n) for token, n in map(bytes.split, file)}
        self.pattern, self.plain = regex.compile(pattern), pattern == PLAIN
        self.tokens = [b""] * (max(rank.values()) + 1)
        for token, n in rank.items():
            self.tokens[n] = token
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.size = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.place = np.cumsum(self.size) - self.size
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, n in rank.items():
            for i in range(1, len(token)):
                left, right = rank.get(token[:i]), rank.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = n
        keys, merged = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # linear probing: of those that meet in a free slot one stays
            at = slot[left]
            free = left[self.keys[at] < 0]
            self.keys[slot[free]] = keys[free]
            self.merged[slot[free]] = merged[free]
            placed = self.keys[slot[left]] == keys[left]
            self.merged[slot[left[placed]]] = merged[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & self.mask
        #: Ids of the parts (a space goes before each) and pieces met so far.
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair of ids, NONE where there is none. An id below 0 has no pair."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).ravel()
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            have = self.keys[slot]
            hit = have == keys[todo]
            out[todo[hit]] = self.merged[slot[hit]]
            on = ~hit & (have >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(left.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.searchsorted(WIDTHS, lengths)
        for k in np.unique(bucket):
            rows = np.flatnonzero(bucket == k)
            if k == len(WIDTHS):
                for i in rows:
                    out[i] = self._long(self.byte[np.frombuffer(pieces[i], np.uint8)]).astype("<u4").tobytes()
                continue
            for part in np.array_split(rows, -(-len(rows) * WIDTHS[k] // CELLS)):
                self._matrix([pieces[i] for i in part], WIDTHS[k], part, out)
        return out

    def _matrix(self, pieces: list[bytes], width: int, to: np.ndarray, out: list[bytes]) -> None:
        ids = np.full((len(pieces), width), -1, np.int32)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids[np.arange(width) < length[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        live, rank = np.arange(len(pieces)), self.look_up(ids[:, :-1], ids[:, 1:])
        done = ids.copy()
        while len(live):
            at = rank.argmin(axis=1)  # the leftmost of the least
            least = rank[np.arange(len(live)), at]
            on = least < NONE
            if not on.all():
                done[live[~on]] = ids[~on]
                live, ids, rank, at, least = live[on], ids[on], rank[on], at[on], least[on]
                if not len(live):
                    break
            row = np.arange(len(live))
            ids[row, at] = least
            behind = np.arange(width - 1)[None, :] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            length[live] -= 1
            if width > 2:
                rank[:, :-1] = np.where(behind[:, : width - 2], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            for side in (-1, 0):
                j = np.clip(at + side, 0, width - 2)
                rank[row, j] = self.look_up(ids[row, j], ids[row, j + 1])
        raw, step = done.astype("<u4").tobytes(), 4 * width
        for i, k, n in zip(range(0, len(raw), step), to.tolist(), (4 * length).tolist(), strict=True):
            out[k] = raw[i : i + n]

    def _long(self, ids: np.ndarray) -> np.ndarray:
        rank = self.look_up(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) < NONE:
            at = np.flatnonzero(rank == least)
            if len(at) > 1:
                at = _apart(at)
                # One by one from the left, a merge meets the merged left neighbour and the unmerged right
                # one. If none of those pairs, nor of the pairs that result, ranks below, order is the same.
                after, _ = self._merge(ids, rank, at, least)
                new = np.flatnonzero(after == least)
                near = [self.look_up(after[new[new > 0] - 1], after[new[new > 0]]), self.look_up(after[new[new < len(after) - 1]], after[new[new < len(after) - 1] + 1])]
                right = at[at + 2 < len(ids)] + 2
                near.append(self.look_up(np.full(len(right), least, np.int32), ids[right]))
                if min((int(x.min()) for x in near if len(x)), default=int(NONE)) < least:
                    at = at[:1]
            ids, rank = self._merge(ids, rank, at, least)
        return ids

    def _merge(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray, least: np.int32):
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids.copy()
        ids[at] = least
        place = np.cumsum(keep) - 1
        ids, rank = ids[keep], np.append(rank, NONE)[keep][:-1]
        near = np.unique(np.concatenate([place[at] - 1, place[at]]))
        near = near[(near >= 0) & (near < len(ids) - 1)]
        rank[near] = self.look_up(ids[near], ids[near + 1])
        return ids, rank

    def _split(self, part: str) -> list[str]:
        if self.plain and (m := _WORD(part)):
            return [m[1], m[2]] if m[2] else [m[1]]
        return self.pattern.findall(part)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        split = [self._split(part) for part in parts]
        fresh = list({x for row in split for x in row if x not in self.pieces})
        self.pieces.update(zip(fresh, self.encode_pieces([x.encode() for x in fresh]), strict=True))
        out = [b"".join([self.pieces[x] for x in row]) for row in split]
        for x in fresh:
            if len(x) > MEMO_LEN:
                del self.pieces[x]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        for memo in (self.parts, self.pieces):
            if len(memo) > MEMO:
                memo.clear()
        memo = self.parts
        heads, rows = [], []
        for text in texts:
            head, *rest = _parts(text)
            heads.append(head)
            rows.append(rest)
        fresh = list({x for row in rows for x in row if x not in memo})
        coded = self._encode_parts([*heads, *(" " + x for x in fresh)])
        memo.update(zip(fresh, coded[len(heads) :], strict=True))
        out = [b"".join([head, *[memo[x] for x in row]]) for head, row in zip(coded, rows, strict=False)]
        for x in fresh:
            if len(x) > MEMO_LEN:
                del memo[x]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids: each token's bytes are gathered from all tokens' bytes laid end to end."""
        ids = np.frombuffer(ids, "<u4")
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(end):
            return b""
        return self.flat[np.arange(end[-1]) + np.repeat(self.place[ids] - end + size, size)].tobytes()


def _parts(text: str) -> list[str]:
    """A text cut at its single spaces between other characters, which are dropped."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in _TOUCHING):
        return _PART.split(text)
    return text.split(" ")


def _apart(at: np.ndarray) -> np.ndarray:
    """Of places in rising order the leftmost ones that don't overlap: in a run of neighbours every other one."""
    run = np.concatenate([[True], np.diff(at) > 1])
    start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - start) % 2 == 0]


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def _groups(texts: list[str], most: int = 1 << 21):
    """Slices of texts of about so many characters in all."""
    a, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """All columns of docs, with n_tokens, ids_sha256, decoded_sha256, round_trip and, if asked for, ids.

    ids are little-endian unsigned 32-bit integers. A null text is empty: no ids. round_trip tells whether
    the decoded bytes are the text's. Own columns with those names are replaced. The rank file is opened on
    each executor, where path must exist.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids"]
    docs = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string", "round_trip boolean", *["ids binary"] * keep_ids])

    def run(batches):
        coder = ranks(path, pattern)
        with uncollected():
            for batch in batches:
                texts = [x or "" for x in batch.column(text).to_pylist()]
                columns: list[list] = [[], [], [], [], []]
                for a, b in _groups(texts):
                    for one, ids in zip(texts[a:b], coder.encode(texts[a:b]), strict=True):
                        back = coder.decode(ids)
                        row = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == one.encode(), ids
                        for column, value in zip(columns, row, strict=True):
                            column.append(value if column is not columns[4] or keep_ids else None)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
                new = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 4 + keep_ids]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names[: 4 + keep_ids]])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
