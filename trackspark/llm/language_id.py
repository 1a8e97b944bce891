"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier over hashed byte trigrams
(log odds of the languages on either side, add-one smoothed) gives a margin; a text gets the language whose
codeword has the least sum of weighted logistic losses. Margins are averages for each trigram, and a bit's
weight is the inverse of its mean margin, so that every bit counts alike.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import by_size, text_bytes

#: Rows of each language that are learned from, as expected by hashing; all rows where there are fewer.
ROWS_PER_LANG = 1000
#: Hashed trigrams: the model has so many numbers for each bit, and the driver so many (256 KB) for each language while it learns.
GRAMS = 1 << 16
#: Best and second language closer than this in loss: flagged as ambiguous.
MARGIN = 0.5
#: Slope of the loss over margins in units of their mean.
SLOPE = 4.0
_PART = 1 << 19

#: ASCII letters in lower case; other ASCII is a blank; bytes of other characters stay.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def crc_mod(id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. Null where the id is."""
    return F.crc32(id.cast("string").cast("binary")) % n


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords, +1 or -1. Up to 7: every split of the languages once; more: random, far apart."""
    if n <= 7:
        bits = [(1, *x) for x in product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(bits, np.int8).reshape(-1, n).T
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = min(int((code[i] != code[:i]).sum(axis=1).min()) for i in range(1, n))
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


def grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram of each byte of all texts (GRAMS where it would leave the text), text offsets, whether each has a letter."""
    data, offsets = text_bytes(column)
    t = _FOLD[data].astype(np.uint32)
    out = np.full(len(t), GRAMS, np.int64)
    if len(t) > 2:
        out[:-2] = (t[:-2] * np.uint32(0x9E3779B1) + t[1:-1] * np.uint32(0x85EBCA77) + t[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    for back in (1, 2):
        last = offsets[1:] - back
        out[last[last >= offsets[:-1]]] = GRAMS
    return out, offsets


def _segments(offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have bytes in [a, b), and where these begin, from a."""
    first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
    docs = np.arange(first, last)
    docs = docs[offsets[docs + 1] > np.maximum(offsets[docs], a)]
    return docs, np.maximum(offsets[docs], a) - a


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", rows_per_lang: int = ROWS_PER_LANG):
    """(languages, codewords, weight table) from rows with text and lang. Rows are chosen by a hash of the id."""
    docs = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in docs.groupBy(lang).count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, 0), np.int8), np.zeros((GRAMS + 1, 0), np.float32)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / n)))])
    sample = docs.filter((F.pmod(F.xxhash64(F.col(id), F.lit(17)), F.lit(1_000_000)) / 1e6) < share[F.col(lang)]).select(F.col(text).alias("t"), F.col(lang).alias("l"))

    def count(batches):
        total = {}
        for batch in by_size(batches, "t"):
            gram, offsets = grams(batch.column("t"))
            for i, one in enumerate(batch.column("l").to_pylist()):
                into = total.setdefault(one, np.zeros(GRAMS + 1, np.int64))
                into += np.bincount(gram[offsets[i] : offsets[i + 1]], minlength=GRAMS + 1)
        for one, into in total.items():
            at = np.flatnonzero(into[:GRAMS])
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at), pa.array(into[at])], ["l", "gram", "n"])

    seen = sample.mapInArrow(count, "l string, gram bigint, n bigint").groupBy("l", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.ones((len(langs), GRAMS), np.float32)
    table[seen["l"].map({k: i for i, k in enumerate(langs)}).to_numpy(int), seen["gram"].to_numpy(int)] += seen["n"].to_numpy()
    table /= table.sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((GRAMS + 1, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        odds = np.log(table[code[:, b] > 0].mean(axis=0)) - np.log(table[code[:, b] < 0].mean(axis=0))
        weights[:GRAMS, b] = odds / np.abs(table @ odds).mean()
    return langs, code, weights


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Mean loss of each row (margins for each bit) under each codeword."""
    return np.logaddexp(0, -SLOPE * margins[:, None, :] * code[None, :, :]).mean(axis=2)


def predict(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred, score (0 to 1) and ambiguous.

    und, 0 and false where the text is null or has no letter, or nothing was learned. Own columns with
    those names are replaced.
    """
    langs, code, weights = model
    names = ["lang_pred", "score", "ambiguous"]
    docs = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, ambiguous boolean"])
    held = docs.sparkSession.sparkContext.broadcast((langs, code, weights))  # GRAMS numbers for each bit

    def run(batches):
        langs, code, weights = held.value
        for batch in by_size(batches, text):
            column = batch.column(text)
            n = len(column)
            gram, offsets = grams(column)
            total, size = np.zeros((n, weights.shape[1]), np.float64), np.zeros(n)
            for a in range(0, len(gram), _PART):
                part = gram[a : a + _PART]
                rows, at = _segments(offsets, a, a + len(part))
                total[rows] += np.add.reduceat(weights[part], at, axis=0)
                size[rows] += np.add.reduceat(part < GRAMS, at)
            known = np.array([x is not None and any(map(str.isalpha, x)) for x in column.to_pylist()], bool)
            pred, score, close = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if langs and n:
                losses = decode(total / np.maximum(size, 1)[:, None], code) if code.shape[1] else np.zeros((n, 1))
                ranked = np.sort(losses, axis=1)
                chance = np.exp(4 * (ranked[:, :1] - ranked))
                pred[known] = np.array(langs, object)[losses.argmin(axis=1)[known]]
                score[known] = (1 / chance.sum(axis=1))[known]
                close[known] = (ranked[:, 1] - ranked[:, 0] < MARGIN)[known] if len(langs) > 1 else False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(close)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs.filter(~held_out))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
