"""Toxic spans by a linear-chain conditional random field over letter runs.

Document labels become token labels by a lexicon, found in rounds: the words that occur in enough of the toxic
texts that no chosen word explains yet (copies of a text count once) and hardly in others. So a language with few
texts teaches its words too, and wrong labels and long texts teach none. The field has two states, features of a
word, its byte n-grams and its two neighbours (hashed), and transitions. Forward-backward marginals give spans, and their maximum and sum, calibrated on the
labelled texts, the score of a document.

A batch of texts is one chain whose transitions are cut where a text begins. Its 2 x 2 products are scanned
in blocks, all blocks at once, so there is no Python work for each token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, NOT_LETTER, Words, by_size, mix, text_bytes

#: Labelled rows that are learned from, toxic and other, as expected by hashing; all where there are fewer.
TOXIC_ROWS, OTHER_ROWS = 700, 1400
BUCKETS = 1 << 20
#: Hashed byte n-grams of a word with a blank on either side, and their sizes.
GRAMS, SIZES = 1 << 18, (4, 6)
#: A lexicon word is in this share of the toxic texts not explained yet (LEAST texts at least), and so many times likelier in toxic texts.
SUPPORT, LEAST, LIFT = 0.06, 4, 12.0
STEPS = 40
#: How much a neighbouring word, and the n-grams of a word, count against the word itself: rare neighbours must not explain a label away.
NEIGHBOUR = np.array([1.0, 0.25, 0.25])
GRAM = 0.25
SPAN = 0.5
#: Tokens in the chain at a time in training, give or take a text.
CHAIN = 1 << 17
_WIDTH = 64


def scan(m: np.ndarray, v0: np.ndarray) -> np.ndarray:
    """v[t] = v[t - 1] M[t], each scaled to sum 1. m: (4, n), the entries 00, 01, 10, 11; v: (2, n)."""
    n = m.shape[1]
    out = np.empty((2, n))
    if n <= 4 * _WIDTH:
        a, b = map(float, v0)
        for t, (p, q, r, s) in enumerate(m.T.tolist()):
            a, b = a * p + b * r, a * q + b * s
            a, b = a / (a + b), b / (a + b)
            out[0, t], out[1, t] = a, b
        return out
    rows = -(-n // _WIDTH)
    block = np.zeros((4, rows * _WIDTH))
    block[[0, 3]] = 1
    block[:, :n] = m
    block = np.ascontiguousarray(block.reshape(4, rows, _WIDTH).transpose(0, 2, 1))
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(_WIDTH):
        w, x, y, z = block[:, k]
        p, q, r, s = p * w + q * y, p * x + q * z, r * w + s * y, r * x + s * z
        size = p + q + r + s
        p, q, r, s = p / size, q / size, r / size, s / size
    ends = scan(np.stack([p, q, r, s]), v0)
    a, b = np.append(v0[0], ends[0, :-1]), np.append(v0[1], ends[1, :-1])
    full = np.empty((2, _WIDTH, rows))
    for k in range(_WIDTH):
        w, x, y, z = block[:, k]
        a, b = a * w + b * y, a * x + b * z
        size = a + b
        a, b = a / size, b / size
        full[0, k], full[1, k] = a, b
    return full.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def marginals(emit: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(state 1) of each token; with pairs also the summed pair marginals (2 x 2) over transitions."""
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    up = np.exp(np.clip(emit, -30, 30))
    t = np.exp(np.where(start, 0.0, trans.reshape(4, 1)))
    m = np.stack([t[0], t[1] * up, t[2], t[3] * up])
    ahead = scan(m, np.array([0.5, 0.5]))
    back = np.full((2, n), 0.5)
    if n > 1:
        back[:, :-1] = scan(m[:, :0:-1][[0, 2, 1, 3]], np.array([0.5, 0.5]))[:, ::-1]
    both = ahead * back
    p = both[1] / both.sum(axis=0)
    if not pairs:
        return p, None
    joint = np.stack([ahead[i, :-1] * m[2 * i + j, 1:] * back[j, 1:] for i in (0, 1) for j in (0, 1)])
    joint = (joint / joint.sum(axis=0))[:, ~start[1:]]
    return p, joint.sum(axis=1).reshape(2, 2)


def _in_parts(bias, w, f, own, start, trans, cuts):
    """marginals and pair marginals of all tokens, cut where texts begin. own: what the n-grams of each token's word add."""
    p, pair = np.empty(len(start)), np.zeros((2, 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            p[a:b], joint = marginals(bias + own[a:b] + sum(k * x[y[a:b]] for k, x, y in zip(NEIGHBOUR, w, f, strict=True)), start[a:b], trans, pairs=True)
            pair += joint
    return p, pair


def features(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashed features (3, n) of the word and the words before and behind it in its text."""
    before, behind = np.zeros_like(h), np.zeros_like(h)
    before[1:], behind[:-1] = h[:-1], h[1:]
    before[start] = 0
    behind[:-1][start[1:]] = 0
    stack = np.stack([h, mix(before + np.uint64(1)), mix(behind + np.uint64(2))])
    return (stack % np.uint64(BUCKETS)).astype(np.int64)


class Grams:
    """Byte n-grams of the distinct words of some texts: of (distinct word of each token), id and word of each n-gram, scale (of each distinct word)."""

    def __init__(self, words: Words, column):
        data, _ = text_bytes(column)
        _, at, self.of = np.unique(words.hash, return_index=True, return_inverse=True)
        a, size = words.start[at], words.end[at] - words.start[at]
        ends = np.cumsum(size + 2)
        first = ends - size - 2
        raw = np.full(int(ends[-1]) if len(ends) else 0, ord(" "), np.uint8)
        to = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        raw[to + np.repeat(first + 1, size)] = LOWER[data[to + np.repeat(a, size)]]
        word = np.repeat(np.arange(len(at)), size + 2)
        ids, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for n in SIZES:
            here = np.flatnonzero(np.arange(len(raw)) + n <= ends[word])
            h = np.full(len(here), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + raw[here + j]
            ids.append((mix(h) % np.uint64(GRAMS)).astype(np.int32))
            owners.append(word[here])
        self.id, self.word = np.concatenate(ids), np.concatenate(owners)
        self.scale = GRAM / np.sqrt(np.maximum(1, np.bincount(self.word, minlength=len(at))))

    def add(self, v: np.ndarray) -> np.ndarray:
        """What weights v of the n-grams add to each token."""
        return (self.scale * np.bincount(self.word, v[self.id], len(self.scale)))[self.of]

    def seen(self, p: np.ndarray) -> np.ndarray:
        """Expected n-grams, where p says how likely each token is."""
        return np.bincount(self.id, (self.scale * np.bincount(self.of, p, len(self.scale)))[self.word], GRAMS)


def lexicon(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Hashes of the words that mark toxic texts, in rounds: in enough of those not explained yet, and much rarer in other than toxic texts.

    The lift is taken over all toxic texts, so that what is left late, of one language perhaps, teaches none of its common words.
    """
    sets = {}
    for words, bad in zip(texts, toxic, strict=True):
        own = np.unique(words)
        sets.setdefault((own.tobytes(), bool(bad)), own)  # copies of a text count once
    bad = [x for (_, b), x in sets.items() if b]
    good = [x for (_, b), x in sets.items() if not b]
    if not bad:
        return np.zeros(0, np.uint64)
    known, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *good]), return_counts=True)
    word, k = np.unique(np.concatenate(bad), return_counts=True)
    at = np.searchsorted(known, word)
    at[at == len(known)] = 0
    other = np.where(known[at] == word, n[at], 0) if len(known) else np.zeros(len(word))
    lift = (k / len(bad)) / ((other + 0.5) / (len(good) + 1))
    rare, found = word[lift >= LIFT], np.zeros(0, np.uint64)
    while bad:
        word, k = np.unique(np.concatenate(bad), return_counts=True)
        new = word[(k >= max(LEAST, SUPPORT * len(bad))) & np.isin(word, rare)]
        if not len(new):
            break
        found = np.union1d(found, new)
        bad = [x for x in bad if not np.isin(x, new).any()]
    return found


def _fit_scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
    return w


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: 1, log odds of its largest marginal, log of 1 + the sum of those that aren't small, which length alone would add up."""
    n = np.diff(first)
    top, total = np.zeros(len(n)), np.zeros(len(n))
    if len(p):
        full = n > 0
        top[full] = np.maximum.reduceat(p, first[:-1][full])
        total[full] = np.add.reduceat(np.where(p >= 0.1, p, 0), first[:-1][full])
    top = np.clip(top, 0.02, 0.98)
    return np.column_stack([np.ones(len(n)), np.log(top / (1 - top)), np.log1p(total)])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", seed: int = 3):
    """(feature weights, transitions, score weights, lexicon) from labelled rows. labels: id, label (0 or 1).

    The rows are chosen by a hash of the id; their texts, bounded in number of rows, are fitted on the driver.
    """
    labels = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y"))
    n = {r[0]: r[1] for r in labels.filter("_y in (0, 1)").groupBy("_y").count().collect()}
    share = F.when(F.col("_y") == 1, min(1.0, TOXIC_ROWS / max(1, n.get(1, 0)))).otherwise(min(1.0, OTHER_ROWS / max(1, n.get(0, 0))))
    chosen = labels.filter((F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000)) / 1e6) < share)
    # The chosen labels are bounded by TOXIC_ROWS + OTHER_ROWS, give or take the hash.
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")

    got = rows.select(F.col("_id").cast("string").alias("id"), F.col("_y").alias("y"), "_t").orderBy("id", "_t").toArrow()
    return fit(got.column("_t"), got.column("y").to_numpy() == 1)


def fit(column: pa.ChunkedArray, y: np.ndarray):
    """The model from texts and whether they are toxic."""
    words = Words(column, NOT_LETTER)
    texts = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    marks = lexicon(texts, y)
    weights, trans = np.zeros(BUCKETS), np.zeros((2, 2))
    if not y.any() or y.all() or not len(marks):
        return weights, trans, np.array([-3.0, 0.0, 0.0]), marks
    h, first, doc = words.hash, words.first, words.doc
    start = np.zeros(len(h), bool)
    start[first[:-1][words.count > 0]] = True
    gold = np.isin(h, marks) & y[doc]
    f, grams = features(h, start).astype(np.int32), Grams(words, column)
    # Whole texts go through the chain some at a time, which bounds the driver's memory.
    cuts = [0, *first[np.flatnonzero(np.diff(first // CHAIN)) + 1], len(h)]
    emit_seen = np.stack([np.bincount(x, gold.astype(float), BUCKETS) for x in f])
    gram_seen, v, v_total = grams.seen(gold.astype(float)), np.zeros(GRAMS), np.zeros(GRAMS)
    pair_seen = np.zeros((2, 2))
    np.add.at(pair_seen, (gold[:-1][~start[1:]].astype(int), gold[1:][~start[1:]].astype(int)), 1)
    bias, total, w = np.log((gold.sum() + 1) / (len(h) + 2)), np.zeros((3, BUCKETS)), np.zeros((3, BUCKETS))
    trans_total = np.zeros((2, 2))
    for _ in range(STEPS):  # AdaGrad on the penalised log likelihood
        p, pair = _in_parts(bias, w, f, grams.add(v), start, trans, cuts)
        grad = NEIGHBOUR[:, None] * (emit_seen - np.stack([np.bincount(x, p, BUCKETS) for x in f])) - 0.05 * w
        total += grad**2
        w += 1.2 * grad / np.sqrt(total + 1e-6)
        grad = gram_seen - grams.seen(p) - 0.05 * v
        v_total += grad**2
        v += 1.2 * grad / np.sqrt(v_total + 1e-6)
        step = (pair_seen - pair) - 0.05 * trans
        trans_total += step**2
        trans = trans + 0.3 * step / np.sqrt(trans_total + 1e-6)
    weights = np.concatenate([[bias], (NEIGHBOUR[:, None] * w).ravel(), v]).astype(np.float32)
    p, _ = _in_parts(bias, w, f, grams.add(v), start, trans, cuts)
    return weights, trans, _fit_scale(summary(p, first), y.astype(float)), marks


def score(docs: DataFrame, model, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of docs, with score (0 to 1) and, if asked for, spans (start, end in code points, p).

    spans are runs of words with a marginal of SPAN or more. A text without words, or null, has the score
    of no evidence and no span. Own columns with those names are replaced.
    """
    docs = docs.drop("score", "spans")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double", *["spans array<struct<start:bigint,end:bigint,p:double>>"] * spans])
    held = docs.sparkSession.sparkContext.broadcast(model[:3])  # bounded by BUCKETS and GRAMS
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches):
        weights, trans, scale = held.value
        for batch in by_size(batches, text):
            w = Words(batch.column(text), NOT_LETTER)
            start = np.zeros(len(w.hash), bool)
            start[w.first[:-1][w.count > 0]] = True
            if len(weights) > BUCKETS:
                f = features(w.hash, start)
                emit = weights[0] + weights[1:][f[0]] + weights[1 + BUCKETS :][f[1]] + weights[1 + 2 * BUCKETS :][f[2]] + Grams(w, batch.column(text)).add(weights[1 + 3 * BUCKETS :])
                p, _ = marginals(emit.astype(np.float64), start, trans)
            else:
                p = np.zeros(len(w.hash))
            value = 1 / (1 + np.exp(-np.clip(summary(p, w.first) @ scale, -30, 30)))
            new = [pa.array(value)]
            if spans:
                found: list[list] = [[] for _ in range(w.n_docs)]
                hit = np.flatnonzero(p >= SPAN)
                column = batch.column(text)
                for i in np.unique(w.doc[hit]):
                    raw = np.frombuffer(column[int(i)].as_py().encode(), np.uint8)
                    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    own = hit[w.doc[hit] == i]
                    for run_ in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                        a, b = w.start[run_[0]] - w.offsets[i], w.end[run_[-1]] - w.offsets[i]
                        found[i].append({"start": int(point[a]), "end": int(point[b]), "p": float(p[run_].max())})
                new.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "score", *["spans"] * spans])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .language_id import crc_mod
    from .tables import table

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs, labels.filter(~held_out).select("doc_id", "toxic"))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").cast("bigint").alias("n_spans"), F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"]))).alias("spans"))
