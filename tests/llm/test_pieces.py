"""Piece BPE against the library and against merging by hand, on whole texts of the tables, odd and long ones."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from trackspark.llm import piece_bpe

from .test_llm import ODD, make

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return piece_bpe.pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def odd_texts(model, rng, n):
    alphabet = [c for c in model.known if len(c) == 1]
    pools = [alphabet, list(" ▁ab"), list("aeiou tnsr  "), list(" \n\t\x00éß漢字🙂<0x41>s "), ["the", "ing", " ", "er", "▁▁", "un", "qu", "  "], list("ab"), list("  ")]
    return ["".join(rng.choice(rng.choice(pools) if rng.random() < 0.1 else pool) for _ in range(rng.randint(0, 60))) for pool in pools for _ in range(n)]


def test_ids_and_texts_equal_library(model, library):
    rng = random.Random(1)
    runs = [a + c * n + b for n in (1, 2, 15, 16, 17, 31, 33, 100) for c in " ▁\n" for a, b in (("", ""), ("a", "b"))]
    for text in [*runs, *odd_texts(model, rng, 300)]:
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids(model.encode(text)) == want[1:-1], text
        assert model.decode(np.array(want, "<u4").tobytes()).decode() == library.decode(want), text


def test_any_ids_decode_as_the_library_does(model, library):
    rng = random.Random(2)
    for _ in range(2000):
        some = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259), 0, 1, 2, library.piece_to_id("▁"), library.piece_to_id("▁the")]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(some, "<u4").tobytes()).decode() == library.decode(some), some


def test_compatible_equals_merging_by_hand(model):
    rng = random.Random(3)
    tokens = [i for i in model.parts if i in model.steady]
    for _ in range(20_000):
        left, right = rng.choice(tokens), rng.choice(tokens)
        if rng.random() < 0.5:  # a border that can merge
            left, right = model.parts[left]
        merged = [model.known[c] for c in model.texts[left] + model.texts[right]]
        while model._merge(merged):
            pass
        assert model.compatible(left, right) == (merged == [left, right])


def test_long_texts_equal_library(model, library):
    rng = random.Random(4)
    for text in ("x" * 100_000, "ab" * 50_000, "".join(rng.choice("abcdefghij\n") for _ in range(100_000)), " " * 5000 + "end"):
        assert ids(model.encode(text)) == library.encode(text)


def test_documents_equal_library(spark, library):
    docs = make(spark, ODD + [" lead", "trail ", "▁", "▁a ▁"], extra=True).withColumn("ids", F.lit("own"))
    got = piece_bpe.encode(docs, PATH).orderBy("doc_id").collect()
    for row in got:
        want = library.encode(row["text"] or "", add_bos=True, add_eos=True)
        back = library.decode(want)
        assert ids(row["ids"]) == want and row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
        assert row["round_trip"] == (back == (row["text"] or "")) and row["spans"] == "own"
    assert len(got) == len(ODD) + 4 and [r["round_trip"] for r in got[-2:]] == [False, False]
    bare = piece_bpe.encode(docs, PATH, begin=False, end=False, keep_ids=False)
    assert bare.filter("text is null or text = ''").select("n_tokens").distinct().collect() == [(0,)] and "ids" not in bare.columns
    assert piece_bpe.encode(docs.limit(0), PATH).count() == 0


def test_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in piece_bpe.query(spark, "/root/testdata/sf0.001").collect():
        want = library.encode(texts[row["doc_id"]], add_bos=True, add_eos=True)
        assert (row["n_tokens"], row["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_models_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    other = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        other.ParseFromString(file.read())
    other.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(other.SerializeToString())
    with pytest.raises(ValueError, match="only BPE models"):
        piece_bpe.Pieces(str(tmp_path / "m.model"))
