"""Odd input for every text operator: repeated rows, no rows, no ids, very long texts; and hashes without structure."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from trackspark.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, pii, quality, token_counts, toxicity
from trackspark.llm.words import Words, shingle_sets

from .test_llm import make, prose


def test_words_have_no_structure_to_share():
    even = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    odd = even.translate(str.maketrans("ab", "ba"))
    words = [even, odd, even[:-1], "a" * 64, "a" * 65, "a" * 128 + "b", "b" + "a" * 128, "ab", "ba", "A" * 64]
    h = Words(pa.array(words)).hash
    assert len(set(h.tolist())) == len(words) - 1 and h[3] == h[-1]
    # A word's hash doesn't depend on what is around it, or on where blocks begin.
    text = " ".join(words)
    assert (Words(pa.array([text, None, text])).hash == np.tile(h, 2)).all()


def test_shingles_of_long_texts_equal_plain_ones():
    rng = random.Random(1)
    text = prose(rng, 400_000, 50_000)
    value, first = shingle_sets(pa.array([text]))
    w = text.lower().split()
    assert first[1] == len(value) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def repeated(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, "other words that are not like them at all"), (2, "one two three four five six seven eight"), (None, "no id here but words"), (None, None)], "doc_id bigint, text string")


def test_jaccard_join_of_repeated_and_unnamed_rows(spark):
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(repeated(spark)).collect())
    # Rows of one id are one document: 2 is linked with 1 by its second text (3 of 4 shingles are not enough, so it isn't).
    assert rows == [(0, 0, None), (0, 1, None), (1, 3, 1), (1, 3, 1), (2, 4, 2), (2, 5, 2)]


def test_row_wise_operators_keep_every_row(spark):
    import public_tokenizers as P

    docs = repeated(spark)
    assert sorted(r["n_bytes"] for r in token_counts.token_counts(docs, P.path("word_bpe_49k.json")).collect()) == sorted(len((r["text"] or "").encode()) for r in docs.collect())
    model = language_id.train(spark.createDataFrame([(1, "one two", "en"), (2, "ein zwei", "de")], "doc_id bigint, text string, lang string"))
    assert language_id.predict(docs, model).count() == 6
    assert pii.extract(docs).count() == 6
    assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int"))).count() == 6
    assert quality.classify(docs.selectExpr("*", "'en' as lang"), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).count() == 6
    got = line_dedup.line_verdicts(docs).collect()
    # Lines of one id and number are one place: both stay or go.
    assert sorted((r["doc_id"] or 0, r["removed"]) for r in got) == [(0, False), (1, False), (1, False), (2, False), (2, True)]
    assert exact_dedup.exact_dedup(docs).count() == 6


def test_empty_tables(spark):
    import public_tokenizers as P

    none = make(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    assert token_counts.token_counts(none, P.path("word_bpe_49k.json")).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality.classify(none, labels).count() == 0
    assert line_dedup.line_verdicts(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([(1, "an item of five words")], "item_id bigint, text string")).count() == 0


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(2)
    return [prose(rng, 200_000, 30_000), "x" * 1_500_000, prose(rng, 50)]


def test_very_long_texts(spark, long_texts):
    rng = random.Random(3)
    item = prose(rng, 40)
    w = long_texts[0].split()
    texts = [" ".join([*w[:150_000], item, *w[150_000:]]), *long_texts[1:], long_texts[0] + " more"]
    docs = make(spark, texts)
    leaks = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["start_word"], r["n_words"]) for r in leaks] == [(0, 150_000, 40)]
    assert [r["component_id"] for r in jaccard_join.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1, 2, 0]
    assert [(r["doc_id"], r["removed"]) for r in line_dedup.line_verdicts(docs).orderBy("doc_id").collect()] == [(0, False), (1, False), (2, False), (3, True)]
    assert [r["kept"] for r in exact_dedup.exact_dedup(docs).orderBy("doc_id").collect()] == [True] * 4
    model = language_id.train(spark.createDataFrame([(1, long_texts[0], "en"), (2, "x" * 1000, "xx")], "doc_id bigint, text string, lang string"))
    assert [r["lang_pred"] for r in language_id.predict(docs, model).orderBy("doc_id").collect()] == ["en", "xx", "en", "en"]
    assert quality.classify(docs, spark.createDataFrame([(0, 1), (2, 1)], "doc_id bigint, quality int")).count() == 4
    assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(0, 0), (2, 0)], "doc_id bigint, toxic int"))).count() == 4


HELPERS = [
    "_h", "_s", "_key", "_id", "_size", "_t", "_row", "_first", "_hot_size", "_hot_id", "_lang", "_own", "_gone", "_threshold", "_text", "more", "row", "likely", "nll", "n_symbols", "text_md5",
    "a", "b", "t", "line", "copies", "key", "x", "g", "by", "at", "hash", "own", "rank", "n", "h", "words", "item", "start", "value", "shape", "pattern", "kind",
]


def test_columns_named_as_helpers_stay(spark):
    import public_tokenizers as P

    docs = repeated(spark).selectExpr("*", "'en' as lang").withColumns({c: F.lit(f"own {c}") for c in HELPERS})
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id bigint, toxic int, quality int")
    model = language_id.train(docs)
    for out in (
        exact_dedup.exact_dedup(docs), quality.classify(docs, labels), pii.extract(docs), line_dedup.dedup_lines(docs), token_counts.token_counts(docs, P.path("word_bpe_49k.json")),
        language_id.predict(docs, model), toxicity.score(docs, toxicity.train(docs, labels)), byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep_ids=False),
    ):
        here = [c for c in HELPERS if c in out.columns]
        assert set(HELPERS) - set(here) == set()
        assert out.select(*here).distinct().collect() == [tuple(f"own {c}" for c in here)] and out.count() == 6
    for out in (jaccard_join.near_duplicates(docs), line_dedup.line_verdicts(docs), decontaminate.contaminated(docs, spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string"))):
        assert out.count()


def test_pipeline_of_rows_without_ids_and_with_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    item, clean, other = prose(rng, 30), prose(rng, 60), prose(rng, 60)
    rows = [(None, f"{other} {item}"), (7, f"{clean} {item} end"), (7, clean), (None, prose(rng, 50)), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.withColumns({c: F.lit("own") for c in ("text_md5", "_lang", "_own", "_key", "_h", "more")})
    kept = corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in rows[2:])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_scope_leaves_only_what_is_kept(spark, tmp_path):
    from trackspark.llm.tables import materialise, scope
    from trackspark.plans.folders import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    tables = lambda: {p.name for p in folder.glob("t-*")}
    before = tables()
    with scope() as keep:
        jaccard_join.near_duplicates(repeated(spark)).collect()
        out = keep(materialise(pii.extract(repeated(spark))))
        assert len(tables() - before) > 2
    assert len(tables() - before) == 1 and out.count() == 6
    with pytest.raises(ZeroDivisionError), scope():
        materialise(out)
        1 / 0
    assert len(tables() - before) == 1
