"""Token counts with overlap resynchronisation.

A text up to CHUNK characters is one chunk. A longer one is cut into chunks that overlap; each is encoded
with offsets, and two neighbours are spliced at a boundary that is stable in both: the overlap there has
ASCII white space, which the tokenizer drops and no token, special string or normalisation spans, and for
AGREE tokens on either side both encodings have the same ids at the same offsets. The text's tokens are those
of each chunk between its two boundaries. Where there is no such place the overlap grows, at last to the whole
of a chunk, which then is one with the next.

Within one chunk counting needs no order of tokens: each distinct run between ASCII white space is encoded once
and its number kept. The library encodes such a run alone as it does within the text, by the same proof.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import uncollected

#: Characters of a chunk, and of the first overlap.
CHUNK = 1 << 15
OVERLAP = 512
#: Tokens on either side of a splice on which both encodings must agree.
AGREE = 4
#: Runs kept with their number of tokens in each Python worker, and the longest run that is kept.
MEMO = 500_000
MEMO_LEN = 64
_BLANK = " \t\n\v\f\r"


class Counting:
    """Counts of one tokenizer file. spaces: whether its tokens never hold ASCII white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.sizes = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
            self.offsets, self.spaces = None, False
        else:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            self.sizes = lambda texts: [len(x) for x in coder.encode_batch_fast(texts, add_special_tokens=False)]
            self.offsets = lambda texts: [(np.array(x.ids, np.int64), np.array(x.offsets, np.int64).reshape(-1, 2)) for x in coder.encode_batch(texts, add_special_tokens=False)]
            self.spaces = self._drops_spaces(coder)
        self.memo: dict[bytes, int] = {}

    @staticmethod
    def _drops_spaces(coder) -> bool:
        """Whether white space only separates: it is dropped, and no added string has or swallows any."""
        plain = all(not (set(x.content) & set(_BLANK)) and not (x.lstrip or x.rstrip or x.single_word) for x in coder.get_added_tokens_decoder().values())
        same = [coder.encode(x, add_special_tokens=False).ids for x in ("ab cd", "ab\t\n cd", " ab\r\v\fcd ")]
        return plain and coder.encode(_BLANK, add_special_tokens=False).ids == [] and same[0] == same[1] == same[2] == [i for x in ("ab", "cd") for i in coder.encode(x, add_special_tokens=False).ids]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Number of tokens and of splices of each whole text."""
        if not self.spaces:  # nothing is proven to be stable: the overlap would grow to the whole text
            return [(n, 0) for n in self.sizes(texts)]
        out = [(0, 0)] * len(texts)
        short = [i for i, x in enumerate(texts) if len(x) <= CHUNK]
        for i, n in zip(short, self._by_runs([texts[i] for i in short]), strict=True):
            out[i] = n, 0
        for i in set(range(len(texts))) - set(short):
            out[i] = splice(texts[i], self.offsets)
        return out

    def _by_runs(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, rows = self.memo, [x.encode().split() for x in texts]  # bytes split at ASCII white space only
        fresh = list({x for row in rows for x in row if x not in memo})
        memo.update(zip(fresh, self.sizes([x.decode() for x in fresh]), strict=True))
        out = [sum([memo[x] for x in row]) for row in rows]
        for x in fresh:
            if len(x) > MEMO_LEN:
                del memo[x]
        return out


def splice(text: str, offsets, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> tuple[int, int]:
    """Number of tokens of text, and of splices. offsets encodes a text to ids and character offsets."""

    def encoded(a: int, b: int) -> np.ndarray:
        ids, places = offsets([text[a:b]])[0]
        return np.column_stack([ids, places + a])

    total = splices = begin = 0  # tokens before begin are counted
    end = min(len(text), chunk)
    left = encoded(0, end)
    while end < len(text):
        wide, at = overlap, None
        while at is None:
            start = max(begin, end - wide)
            stop = min(len(text), start + chunk + wide)
            right = encoded(start, stop)
            at = boundary(text, left, right, start, end, agree)
            if at is None and start == begin:
                at = begin  # no stable place in all of the chunk: it and the next, which is right, are one
            wide *= 2
        total += int(((left[:, 1] >= begin) & (left[:, 1] < at)).sum())
        splices += at > begin
        begin, end, left = at, stop, right
    return total + int((left[:, 1] >= begin).sum()), splices


def boundary(text: str, a: np.ndarray, b: np.ndarray, start: int, end: int, agree: int) -> int | None:
    """The last place in [start, end) behind ASCII white space around which both encodings agree.

    a and b are rows of id, first and last character: a of the chunk that ends at end, b of that which starts at start.
    """
    a = a[a[:, 1] >= start]
    b = b[b[:, 2] <= end]
    # Same ids at same offsets, from either side: a row of a is matched to the row of b that starts there.
    same = np.zeros(len(a), bool)
    if len(a) and len(b):
        k = np.minimum(np.searchsorted(b[:, 1], a[:, 1]), len(b) - 1)
        same = (a == b[k]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(same)])
    for i in range(len(a) - agree, agree - 1, -1):
        if run[i + agree] - run[i - agree] == 2 * agree and text[a[i, 1] - 1] in _BLANK:
            return int(a[i, 1])
    return None


@lru_cache(maxsize=4)
def _counting(path: str) -> Counting:
    return Counting(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """All columns of docs, with n_bytes, n_tokens, n_splices and over_limit (n_tokens > limit).

    A null text is empty. path is a file of the tokenizers (.json) or sentencepiece (.model) library that
    each executor can open. Own columns with those names are replaced.
    """
    names = ["n_tokens", "n_splices"]
    docs = docs.drop("n_bytes", *names, "over_limit")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_tokens bigint", "n_splices bigint"])

    def run(batches):
        counting = _counting(path)
        with uncollected():
            for batch in batches:
                texts = [x or "" for x in batch.column(text).to_pylist()]
                rows, a = [], 0
                while a < len(texts):
                    b, size = a, 0
                    while b < len(texts) and size < 1 << 21:
                        size += len(texts[b])
                        b += 1
                    rows += counting.count(texts[a:b])
                    a = b
                new = [pa.array([row[k] for row in rows], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    out = docs.mapInArrow(run, schema)
    return out.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint"), "over_limit": F.col("n_tokens") > limit})


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_splices")
