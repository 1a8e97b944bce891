"""Each text operator against the library, a brute-force version or held-out accuracy, on small and odd inputs."""

import base64
import hashlib
import itertools
import random
import re
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackspark.llm import byte_bpe, components, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, pii, quality, token_counts, toxicity
from trackspark.llm.tables import lookup
from trackspark.llm.words import Words, shingle_sets

SF = "/root/testdata/sf0.001"
BLANK = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \n\t", "a", "One two", "Hélló wörld 漢字 🙂", "x" * 3000, "same text here", "same  text\there", "SAME text here", "l1\nl2\n\nl1"]


def make(spark, texts, extra=False):
    """A small documents table; extra: a column whose name the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("own") for c in ("kept", "score", "n_tokens", "spans", "accepted", "n")}) if extra else df


def words(text):
    return re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


# Shared helpers.


def test_words_and_shingles_equal_split():
    rng = random.Random(1)
    texts = [None, "", " ", *("".join(rng.choice("aB é\n\t漢.") for _ in range(rng.randint(0, 60))) for _ in range(200))]
    w = Words(pa.array(texts))
    assert w.count.tolist() == [len(words(t)) for t in texts]
    ids = {}
    for i, t in enumerate(texts):
        for word, h in zip(words(t), w.hash[w.first[i] : w.first[i + 1]].tolist(), strict=True):
            assert ids.setdefault(word, h) == h
    assert len(set(ids.values())) == len(ids)
    value, first = shingle_sets(pa.array(texts))
    assert np.diff(first).tolist() == [len(shingle_set(t)) for t in texts]


def test_lookup_with_heavy_key(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i,) for i in range(3000)], "k bigint")
    found = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2).filter("k < 2000")
    out = lookup(rows, ["k"], found, "n").groupBy().agg(F.count("*"), F.count("v"), F.sum("v")).first()
    assert tuple(out) == (3000, 3000 - 333, sum(2 * (0 if i % 3 else i) for i in range(2000)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 130)}, 2: 2, 3: 2}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [*ODD, "<|endoftext|> a<|startoftext|>b", "it's 12 we'll", " ".join(f"wörd{i}" for i in range(9000)), "".join(rng.choice("ab c'1é\n") for _ in range(80_000))]
    out = token_counts.token_counts(make(spark, texts, extra=True), P.path("word_bpe_49k.json"), limit=100).orderBy("doc_id").collect()
    want = [len(coder.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r["n_tokens"] for r in out] == want
    assert [r["n_bytes"] for r in out] == [len((t or "").encode()) for t in texts]
    assert [r["over_limit"] for r in out] == [n > 100 for n in want]
    assert out[-2]["n_splices"] > 0


def test_splice_widens_until_stable():
    counting = token_counts.Counting(P.path("word_bpe_49k.json"))
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "é", " ", "\n", "<|endoftext|>", "'s", "1", "x" * 40]) for _ in range(rng.randint(0, 300)))
        whole = counting.offsets([text])[0][0]
        assert token_counts.splice(text, counting.offsets, chunk=rng.choice([30, 90]), overlap=rng.choice([4, 20]))[0] == len(whole)
    assert token_counts.splice("x" * 500, counting.offsets, chunk=50, overlap=8) == (len(counting.offsets(["x" * 500])[0][0]), 0)


def test_other_tokenizer_files(spark):
    texts = make(spark, ["Hello  there", None])
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert [r["n_tokens"] > 0 for r in token_counts.token_counts(texts, P.path(name)).orderBy("doc_id").collect()] == [True, False]


# 2


def test_codewords_differ():
    for n in (1, 2, 3, 4, 7, 9, 20):
        code = language_id.codewords(n)
        assert len(code) == n
        assert all((code[i] != code[j]).sum() >= (1 if n < 3 else 2) for i in range(n) for j in range(i))


def test_language_id_held_out(spark):
    out = language_id.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 40 and right > 0.95


def test_language_id_odd(spark):
    docs = make(spark, [*ODD, "123 !!"], extra=True)
    model = language_id.train(make(spark, ["the cat and the dog"] * 3))
    got = [r["lang_pred"] for r in language_id.predict(docs, model).orderBy("doc_id").collect()]
    assert [x == "und" for x in got] == [t is None or not any(map(str.isalpha, t)) for t in [*ODD, "123 !!"]]
    assert language_id.predict(docs, language_id.train(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert language_id.predict(docs.limit(0), model).count() == 0


# 3

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_equals_patterns():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "a@b.c", "1", "255", "256", ".", "-", " ", "+1", "(", "_", "é", "4111111111111111", "00000000000000"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_pii_long_texts_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1((" * 50_000, "a@" * 100_000):
        pii.base_spans(text)


def test_pii_learns_contexts(spark):
    known = [f"please call me at +1 (201) 555-0{i:03d} today" for i in range(12)]
    hidden = [f"please call me at 201-555-77{i:02d}-12 today" for i in range(4)]
    other = [f"order 201-555-88{i:02d}-12 arrived" for i in range(4)]
    out = pii.extract(make(spark, [*known, *hidden, *other, None, ""], extra=True)).orderBy("doc_id").collect()
    assert [len(r["base"]) for r in out] == [1] * 12 + [0] * 10
    texts = [*known, *hidden, *other]
    found = [[texts[i][s["start"] : s["end"]] for s in r["spans"]] for i, r in enumerate(out[:20])]
    assert [x[0] for x in found[12:16]] == [f"201-555-77{i:02d}-12" for i in range(4)]
    assert found[16:] == [[]] * 4
    assert pii.extract(make(spark, [])).count() == 0


# 4


def brute_leaks(docs, items):
    out = {}
    for d, text in enumerate(docs):
        w = words(text)
        for i, item in enumerate(items):
            v = words(item)
            if not v or not w:
                continue
            bag = lambda x: [tuple(x)] if len(x) < 5 else [tuple(x[k : k + 5]) for k in range(len(x) - 4)]
            best = 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = bag(w[s : s + len(v)]), bag(v)
                both = sum(min(a.count(x), b.count(x)) for x in set(a) | set(b))
                best = max(best, both / (len(a) + len(b) - both))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randint(15, 50)) for _ in range(12)] + ["tiny item here", "", "a b a b a b a b a b a b"]
    docs = [None, "", items[3], "tiny item here", *(prose(rng, rng.randint(1, 120)) for _ in range(30))]
    for k in range(30):
        v = items[k % 12].split()
        if k % 3 == 1:
            v[0] = "changed"
        if k % 3 == 2:
            v[-2:] = ["other", "end"]
        docs.append(" ".join([prose(rng, rng.randint(0, 40)), *v, prose(rng, rng.randint(0, 40))]).upper())
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(99, None)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.contaminated(make(spark, docs, extra=True), benchmark).collect()}
    want = brute_leaks(docs, items)
    assert len(want) > 25 and got == want
    assert decontaminate.contaminated(make(spark, docs), benchmark.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(7)
    index = decontaminate.Index(list(range(300)), [" ".join(f"t{x}" for x in rng.integers(0, 1000, 20)) for _ in range(300)])
    for _ in range(300):
        bits = rng.choice(64, rng.integers(0, 32), replace=False)
        probe = index.prints[rng.integers(300)] ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64), initial=np.uint64(0))
        assert index.near(probe).tolist() == np.flatnonzero(np.bitwise_count(index.prints ^ probe) <= decontaminate.RADIUS).tolist()


# 5


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(8)
    emit, trans, start = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([1, 0, 0, 0, 1, 0, 1, 0, 0], bool)
    weight, joint = {}, np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=9):
        weight[y] = np.exp(sum(emit[t] * y[t] + (0 if start[t] else trans[y[t - 1], y[t]]) for t in range(9)))
    z = sum(weight.values())
    for y, v in weight.items():
        for t in range(9):
            if not start[t]:
                joint[y[t - 1], y[t]] += v / z
    p, pair = toxicity.marginals(emit, start, trans, pairs=True)
    assert np.allclose(p, [sum(v for y, v in weight.items() if y[t]) / z for t in range(9)])
    assert np.allclose(pair, joint)


def test_block_scan_equals_plain_scan():
    m = np.random.default_rng(9).random((4, 5000)) + 0.01
    v, want = np.array([0.5, 0.5]), []
    for t in range(5000):
        v = v @ m[:, t].reshape(2, 2)
        v /= v.sum()
        want.append(v)
    assert np.allclose(toxicity.scan(m, np.array([0.5, 0.5])), np.array(want).T)


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(10)
    texts, bad = [], []
    for i in range(400):
        w = prose(rng, 60, 2000).replace("w", "word").split()
        w = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in w]
        bad.append(i % 4 == 0)
        if bad[-1]:
            w[rng.randrange(60)] = rng.choice(["nasty", "Vile!", "AWFUL"])
        texts.append(" ".join(w))
    docs = make(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad) if i < 300], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).orderBy("doc_id").collect()
    assert [r["score"] >= 0.3 for r in out[300:]] == bad[300:]
    hit = out[300]["spans"][0]
    assert texts[300][hit["start"] : hit["end"]].lower() in ("nasty", "vile", "awful")
    odd = toxicity.score(make(spark, ODD), model).collect()
    assert all(0 <= r["score"] < 0.3 and not r["spans"] for r in odd)
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r["score"] < 0.3 for r in toxicity.score(docs, nothing).collect())


def test_toxicity_learns_words_of_a_few_toxic_texts(spark):
    """A language with 4 % of the toxic texts, whose words are too rare among all of them; and copies of one text teach nothing."""
    rng = random.Random(14)
    pad = lambda: ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(30)]
    texts, bad, rare = [], [], []
    for i in range(600):
        w = pad()
        bad.append(i % 3 == 0)
        rare.append(i % 75 == 0)
        if bad[-1]:
            w[rng.randrange(30)] = rng.choice(["gruslich", "Gruslich!"]) if rare[-1] else rng.choice(["nasty", "vile", "awful"])
        texts.append(" ".join(w))
    texts += [" ".join([*pad()[:29], "harmless"])] * 20
    labels = spark.createDataFrame([(i, int(i >= 600 or bad[i])) for i in range(620)], "doc_id bigint, toxic int")
    model = toxicity.train(make(spark, texts), labels)
    known = lambda *x: np.isin(Words(pa.array([" ".join(x)]), toxicity.NOT_LETTER).hash, model[3]).tolist()
    assert known("gruslich", "nasty", "vile", "awful", "harmless", texts[0].split()[0]) == [True] * 4 + [False] * 2
    fresh = [" ".join([*pad(), "gruslich", *pad()]), " ".join(pad())]
    assert [r["score"] >= 0.3 for r in toxicity.score(make(spark, fresh), model).orderBy("doc_id").collect()] == [True, False]


def test_toxicity_shares_weight_within_word_families():
    column = pa.array(["réeuxê réeuxvi", "Réeuxpa", "plain", None])
    w = Words(column, toxicity.NOT_LETTER)
    grams = toxicity.Grams(w, column)
    v = np.zeros(toxicity.GRAMS)
    for i in grams.id[grams.word == grams.of[0]]:
        v[i] = 1
    own = grams.add(v)
    assert own[0] > own[1] > 0 and own[2] > 0 and own[3] == 0
    # Against plain Python: one weight for each n-gram is the dot product with the expected n-grams.
    p = np.array([0.5, 0.25, 1.0, 0.125])
    assert np.isclose(grams.add(v) @ p, grams.seen(p) @ v)
    assert len(grams.id) == sum(max(0, len(x.encode()) + 2 - n + 1) for x in ("réeuxê", "réeuxvi", "réeuxpa", "plain") for n in toxicity.SIZES)


# 6


def test_kneser_ney_sums_to_one_and_equals_plain_count(spark):
    texts = ["the cat sat. The dog ran, and the cat ran!", "a b c", "zz top 12 tops"]
    model = np.exp(-quality.train(make(spark, texts)).astype(float)).reshape(-1, quality.SYMBOLS)
    assert np.allclose(model.sum(axis=1), 1, atol=1e-4)
    gram, _ = quality.ngrams(pa.array(texts))
    seen = {r["gram"]: r["n"] for r in quality.counts(make(spark, texts), "text").collect()}
    assert seen == {int(g): int(n) for g, n in zip(*np.unique(gram, return_counts=True), strict=True)}


def test_quality_keeps_prose_and_rejects_junk(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice(["ba", "ne", "ti", "ro", "sal"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    good = [" ".join(rng.choice(vocabulary) for _ in range(80)) + "." for _ in range(120)]
    junk = ["".join(rng.choice("%$#&|!XQZ90") for _ in range(400)) for _ in range(10)]
    docs = make(spark, [*good, *junk, None, ""], extra=True)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(125, 0), (None, 1)], "doc_id bigint, quality int")
    got = [r["accepted"] for r in quality.classify(docs, labels).orderBy("doc_id").collect()]
    assert all(got[:120]) and not any(got[120:130]) and got[130:] == [True, True]
    assert quality.classify(docs, labels.limit(0)).filter("not accepted").count() == 0


# 7


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    lines = [prose(rng, rng.randint(1, 14), 60) for _ in range(60)]
    for x in lines[:40]:
        w = x.split()
        w[rng.randrange(len(w))] = "new"
        lines.append(" ".join(w))
    docs = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(60)] + ODD
    sets, order = [], []
    for d, t in enumerate(docs):
        for k, line in enumerate((t or "").split("\n")):
            if words(line):
                sets.append(frozenset(words(line)))
                order.append((d, k))
    want = {p: any(100 * len(s & o) >= 80 * len(s | o) for o in sets[:i]) for i, (p, s) in enumerate(zip(order, sets, strict=True))}
    df = make(spark, docs, extra=True)
    got = {(r["doc_id"], r["line"]): r["removed"] for r in line_dedup.line_verdicts(df).collect()}
    assert got == want
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert clean == {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not want.get((d, k))) for d, t in enumerate(docs)}


# 8


def test_byte_bpe_equals_library(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank, special_tokens={})
    rng = random.Random(13)
    texts = [*ODD, "ab" * 2000, " " * 700 + "x", "日本語" * 500, "".join(rng.choice("thernsao") for _ in range(5000)), "it's  we'll\x1c \xa0y", "<|endoftext|>"]
    texts += ["".join(rng.choice("ab \n\té'sR1._²") for _ in range(rng.randint(1, 120))) for _ in range(300)]
    out = byte_bpe.encode(make(spark, texts, extra=True), path, P.PATTERN).orderBy("doc_id").collect()
    for t, r in zip(texts, out, strict=True):
        ids = coder.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["n_tokens"], bytes(r["ids"]), r["ids_sha256"]) == (len(ids), raw, hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and r["round_trip"]
    assert byte_bpe.encode(make(spark, []), path, P.PATTERN).count() == 0


# 9


def test_exact_dedup_groups(spark):
    docs = make(spark, [*ODD, *["copy of  a text"] * 50, "copyofatext"], extra=True)
    rows = {r["doc_id"]: r for r in docs.collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for i, r in rows.items()}
    for r in exact_dedup.exact_dedup(docs).collect():
        same = [i for i in rows if norm[i] == norm[r["doc_id"]]]
        keep = min(same, key=lambda i: (-len(rows[i]["text"] or ""), i))
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(same), r["doc_id"] == keep, hashlib.sha256(norm[keep].encode()).hexdigest())
    assert exact_dedup.exact_dedup(make(spark, [])).count() == 0


def test_exact_dedup_null_id(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (5, "a"), (None, "b")], "doc_id bigint, text string")
    assert sorted((r["text"], r["doc_id"] or 0, r["keep_id"] or 0, r["kept"]) for r in exact_dedup.exact_dedup(df).collect()) == [("a", 0, 5, False), ("a", 0, 5, False), ("a", 5, 5, True), ("b", 0, 0, True)]


# 10


def brute_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("common,block", [(0.002, 2048), (0.5, 3)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, common, block):
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LARGE", block)
    rng = random.Random(14)
    passage, texts = prose(rng, 60, 5000), [*ODD]
    for n in (4, 6, 9, 12, 30, 36, 60, 66, 130, 300):
        base = prose(rng, n, 5000).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(copy))
                copy[k : k + rng.choice([0, 1])] = [f"new{rng.randrange(9999)}"]
            texts.append(" ".join(copy + prose(rng, rng.choice([0, 0, n // 8]), 5000).split()))
    texts += [f"{passage} {prose(rng, rng.randint(5, 60), 5000)}" for _ in range(30)] + [texts[20]] * 40
    got = [(r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(make(spark, texts, extra=True)).orderBy("doc_id").collect()]
    assert got == brute_components(texts)


def test_jaccard_join_empty(spark):
    assert jaccard_join.near_duplicates(make(spark, [])).count() == 0


# Registered queries and the pipeline.


def test_exact_dedup_query_equals_sql(spark, duck):
    got = {tuple(r) for r in exact_dedup.query(spark, SF).collect()}
    assert got == set(duck.sql(exact_dedup.QUERY_SQL).fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).persist()
        assert out.columns == docs.columns, name
        assert out.join(docs, "doc_id", "left_semi").count() == out.count() <= docs.count()
        docs = out
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({re.sub(r"\s", "", t) for t in texts.values()}) == len(texts)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(" ".join(words(i)) in " ".join(words(t)) for i in items for t in texts.values())
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in final} == set(texts) and all(r["round_trip"] for r in final)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == set(texts)
