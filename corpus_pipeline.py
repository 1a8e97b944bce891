"""The training-corpus pipeline: documents in, token counts and digests of what is worth training on out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, quality
from trackspark.llm.tables import discard, fresh, materialise, scope, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a perplexity above the threshold of their language.

    Null and empty texts stay; repeated rows are judged alike; a null language is one of its own.
    """
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("accepted").select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest as written stays, then the smallest id.

    Null, empty and blank texts are equal. Repeated rows, same id and text, stay together; so do equal texts without ids
    where no other row of their group has one.
    """
    return exact_dedup.exact_dedup(docs).filter("kept").select(*docs.columns)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates that links connect the smallest id stays. Documents without an id stay."""
    gone = jaccard_join.near_duplicates(docs).filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(materialise(gone), "doc_id", "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark.

    A text tells its leaks, not an id: rows without an id go as others do, and of rows of one id only those that leak.
    Null and empty texts leak nothing and stay. Equal texts go or stay together.
    """
    (key,) = fresh(docs, "text_md5")
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    leaks = decontaminate.contaminated(keyed.select(key, "text"), table(spark, sf_dir, "benchmark"), id=key).select(key).distinct()
    return keyed.join(materialise(leaks), key, "left_anti").select(*docs.columns)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left. A null text is empty: no tokens. Every row, repeated ones too, is encoded by itself."""
    import public_tokenizers

    out = byte_bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: SQL can't express the perplexity, the SimHash windows or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and a stage's own tables then go."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with scope() as keep:
            docs = keep(materialise(stage(spark, before, sf_dir)))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
