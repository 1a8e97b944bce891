"""The models and the pipeline against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from trackspark.llm import language_id, pii, quality

from .test_llm import SF, brute_components, make, shingle_set, words


def plain_kneser_ney(texts):
    """P(last symbol | the others) by recursion over dictionaries, for any history."""
    symbols = [[int(quality._SYMBOL[b]) for b in t.encode()] for t in texts]
    top = Counter()
    for s in symbols:
        s = [28] * (quality.ORDER - 1) + s
        top.update(tuple(s[i : i + quality.ORDER]) for i in range(len(s) - quality.ORDER + 1))
    counts = {quality.ORDER: top}
    for k in range(quality.ORDER - 1, 0, -1):
        counts[k] = Counter({g: len(left) for g, left in _left(counts[k + 1]).items()})
    cut = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        cut[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)] if all(n) else [0.5] * 3
    follow = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            follow[k][g[:-1]].append(v)

    def p(gram):
        if not gram:
            return 1 / quality.SYMBOLS
        k, seen = len(gram), follow[len(gram)].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        total, d = sum(seen), cut[k]
        c = counts[k].get(gram, 0)
        left = sum(d[min(v, 3) - 1] for v in seen) / total
        return max(c - d[min(c, 3) - 1], 0) / total + left * p(gram[1:]) if c else left * p(gram[1:])

    return p


def _left(counter):
    out = defaultdict(set)
    for g in counter:
        out[g[1:]].add(g[0])
    return out


def test_kneser_ney_equals_plain_recursion(spark):
    texts = ["the cat sat on the mat. The dog ran, and the cat ran after it again and again!", "a b c a b d a b c", "zz top 12 tops, ça и это", ""]
    model = np.exp(-quality.train(make(spark, texts)).astype(float))
    p = plain_kneser_ney(texts)
    rng = np.random.default_rng(1)
    grams = {tuple(int(x) for x in rng.integers(0, quality.SYMBOLS, quality.ORDER)) for _ in range(300)}
    for t in texts:
        s = [28] * 3 + [int(quality._SYMBOL[b]) for b in t.encode()]
        grams |= {tuple(s[i : i + 4]) for i in range(len(s) - 3)} | {(*s[i : i + 3], int(rng.integers(quality.SYMBOLS))) for i in range(len(s) - 3)}
    for g in grams:
        at = sum(x * quality.SYMBOLS ** (3 - i) for i, x in enumerate(g))
        assert math.isclose(model[at], p(g), rel_tol=1e-4, abs_tol=1e-9), g


def test_scripts_have_symbols_of_their_own():
    kinds = {name: set(quality._SYMBOL[np.frombuffer(text.encode(), np.uint8)].tolist()) for name, text in (("latin", "éüñ"), ("cyrillic", "это"), ("greek", "λόγος"), ("cjk", "日本語"), ("arabic", "سلام"), ("emoji", "😀"))}
    first = {k: v - {31, 32} for k, v in kinds.items()}
    assert all(a.isdisjoint(b) for x, a in first.items() for y, b in first.items() if x < y)


def test_few_trusted_documents_of_a_language_are_drawn_to_all(spark):
    rng = np.random.default_rng(2)
    prose = lambda: " ".join("".join(rng.choice(list("abcdefg"), 4)) for _ in range(60))
    docs = spark.createDataFrame([(i, prose(), "aa" if i < 60 else "bb") for i in range(62)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(62)], "doc_id bigint, quality int")
    limits = {r["lang"]: r["threshold"] for r in quality.classify(docs, labels).select("lang", "threshold").distinct().collect()}
    assert set(limits) == {"aa", "bb"} and limits["aa"] != limits["bb"] and abs(limits["aa"] - limits["bb"]) < 0.2 * limits["aa"]


def test_output_codes_equal_plain_decoding(spark):
    learn = [("the house and the garden of the king", "en"), ("das haus und der garten des königs", "de"), ("la maison et le jardin du roi", "fr"), ("la casa y el jardín del rey", "es")]
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(learn * 3)], "doc_id bigint, text string, lang string")
    langs, code, weights = model = language_id.train(train)
    seen = {lang: np.ones(language_id.GRAMS) for lang in langs}
    for t, lang in learn * 3:
        for g in language_id.grams(pa.array([t]))[0]:
            if g < language_id.GRAMS:
                seen[lang][g] += 1
    share = np.array([seen[x] / seen[x].sum() for x in langs])
    asked = ["der könig und das haus", "the king of the house", "el rey y la casa", "le roi et la maison", "x"]
    got = language_id.predict(make(spark, asked), model).orderBy("doc_id").collect()
    for t, r in zip(asked, got, strict=True):
        loss = np.zeros(len(langs))
        grams = [int(g) for g in language_id.grams(pa.array([t]))[0] if g < language_id.GRAMS]
        for b in range(code.shape[1]):
            odds = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
            odds /= np.abs(share @ odds).mean()
            margin = sum(odds[g] for g in grams) / max(1, len(grams))
            for k in range(len(langs)):
                loss[k] += np.logaddexp(0, -language_id.SLOPE * margin * code[k, b]) / code.shape[1]
        assert r["lang_pred"] == langs[int(loss.argmin())]
        assert math.isclose(r["score"], 1 / np.exp(4 * (loss.min() - loss)).sum(), rel_tol=1e-3)
    assert [r["lang_pred"] for r in got[:4]] == ["de", "en", "es", "fr"]


def test_more_than_sixty_four_languages_are_learned(spark):
    rows = [(i, " ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" * 3] * 20), f"l{i:02d}") for i in range(80)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model[0]) == 80
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(make(spark, [r[1] for r in rows]), model).collect()}
    assert sum(got[i] == f"l{i:02d}" for i in range(80)) >= 78


def test_pii_finds_values_with_blanks_and_long_ones(spark):
    known = [f"please call our desk at +1 (201) 555-0{i:03d} today" for i in range(12)]
    hidden = [f"please call our desk at 0171 555 77{i:02d} today" for i in range(4)]
    far = "w" * 200
    long = [f"send {far} to a{i}@b.example now" for i in range(8)] + [f"send {far} to {'k' * 120}{i}@localhost now" for i in range(3)]
    out = {r["doc_id"]: r for r in pii.extract(make(spark, [*known, *hidden, *long])).collect()}
    texts = [*known, *hidden, *long]
    found = lambda i: [texts[i][s["start"] : s["end"]] for s in out[i]["spans"]]
    assert [found(i) for i in range(12, 16)] == [[f"0171 555 77{i:02d}"] for i in range(4)]
    assert [found(i) for i in range(24, 27)] == [[f"{'k' * 120}{i}@localhost"] for i in range(3)]


def test_pipeline_equals_plain_stages(spark):
    """Every stage on its own input, against plain Python; the quality stage against its operator."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept = stages["quality"](spark, docs, SF).persist()
    accepted = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("accepted").select("doc_id").collect()
    assert set(rows(kept)) == {r["doc_id"] for r in accepted}
    before, kept = rows(kept), stages["exact_dedup"](spark, kept, SF).persist()
    groups = defaultdict(list)
    for i, t in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    assert set(rows(kept)) == {min(g, key=lambda i: (-len(before[i] or ""), i)) for g in groups.values()}
    before, kept = rows(kept), stages["jaccard_join"](spark, kept, SF).persist()
    ids = sorted(before)
    root = [c for _, c in brute_components([before[i] for i in ids])]
    assert set(rows(kept)) == {i for k, i in enumerate(ids) if root[k] == k}
    before, kept = rows(kept), stages["decontaminate"](spark, kept, SF).persist()
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bags = [Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4)) for v in items]

    def leaks(text):
        w, own = words(text), shingle_set(text)
        for v, bag in zip(items, bags, strict=True):
            if len(v) < 5 or own.isdisjoint(bag):
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                part = Counter(tuple(w[k : k + 5]) for k in range(s, min(len(w), s + len(v)) - 4))
                both = sum((part & bag).values())
                if 100 * both >= 80 * (sum(part.values()) + sum(bag.values()) - both):
                    return True
        return False

    assert set(rows(kept)) == {i for i, t in before.items() if not leaks(t)}


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("none", []), ("odd", [(1, None, "en"), (1, None, "en"), (None, "a text without id that is long enough", None), (2, "", "de"), (3, "words of a text that is long enough", "en"), (3, "words of a text that is long enough", "en")])):
        folder = tmp_path / name
        spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, "some benchmark item of words")], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in corpus_pipeline.run(spark, str(folder)).collect())
        # Null and empty texts are equal, so the least id of them stays; a repeated row stays with its copies.
        assert got == ([] if name == "none" else [(0, True), (1, False), (1, False), (3, True), (3, True)])


def test_toxicity_recall_on_held_out_rows_by_language(spark, capsys):
    from pyspark.sql import functions as F

    from trackspark.llm import toxicity

    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.query(spark, folder).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").join(labels.filter("toxic is not null"), "doc_id")
    rows = got.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hit")).orderBy("toxic", "lang").collect()
    with capsys.disabled():
        print("", *(f"{r['lang']}: {r['hit']} of {r['n']} {'toxic' if r['toxic'] else 'other'}" for r in rows), sep="\n")
    assert all(r["hit"] >= 0.8 * r["n"] if r["toxic"] else r["hit"] <= 0.1 * r["n"] for r in rows if r["n"] >= 10)
