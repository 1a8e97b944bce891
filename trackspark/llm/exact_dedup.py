"""Exact dedup by 128-bit content hash, with the bytes compared inside each hash group (DataFrame functions only).

Rows meet their group's texts in one partial aggregation, so a group of any size sends a row for each
task at most. Grouping by hash and text compares bytes, so different texts of one hash stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deleted before texts are compared: space and the characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
#: A group with more than this share of all rows is hot; there can be only 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
_NO_ID = (1 << 63) - 1
_WIDE = "100000000000000000000"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_groups(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each distinct normalised text: content_hash, text_sha256, group_size, keep_id.

    Of a group the row with the most code points in its own text stays, then the smallest id. A null
    text is empty. A null id counts as larger than any other; keep_id is null if all are.
    """
    length = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("decimal(38,0)")
    number = F.coalesce(F.col(id), F.lit(_NO_ID)).cast("decimal(38,0)")
    rows = docs.select(normalised(F.col(text)).alias("_norm"), length.alias("_len"), (length * F.lit(_WIDE).cast("decimal(21,0)") - number).cast("decimal(38,0)").alias("_rank"))
    rows = rows.select(F.md5("_norm").alias("content_hash"), "_norm", "_len", "_rank")
    groups = rows.groupBy("content_hash", "_norm").agg(F.count("*").alias("group_size"), F.max("_len").alias("_len"), F.max("_rank").alias("_rank"))
    keep = (F.col("_len") * F.lit(_WIDE).cast("decimal(21,0)") - F.col("_rank")).cast("bigint")
    return groups.select("content_hash", F.sha2("_norm", 256).alias("text_sha256"), "group_size", F.nullif(keep, F.lit(_NO_ID)).alias("keep_id"))


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """All columns of docs, with content_hash, text_sha256, group_size, keep_id and kept.

    Null and empty texts, and texts of blanks only, are equal. Repeated rows (same id, same text) count
    in group_size and share their verdict. Own columns with those names are replaced.
    """
    from .tables import fresh, materialise

    docs = docs.drop("content_hash", "text_sha256", "group_size", "keep_id", "kept")
    groups = materialise(exact_groups(docs, text, id).filter("group_size > 1"))
    most = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0] * HOT_SHARE
    norm = normalised(F.col(text))
    rows = docs.withColumns({"content_hash": F.md5(norm), "text_sha256": F.sha2(norm, 256)})
    # At most 1 / HOT_SHARE groups are hot, so that broadcast is bounded; their rows then take a key of
    # their own, so that none of them meets in one partition of the join below.
    hot_key, hot_text, hot_size, hot_id, cold_key, cold_text, size, first, key = fresh(rows, "_hot_key", "_hot_text", "_hot_size", "_hot_id", "_cold_key", "_cold_text", "_size", "_first", "_key")
    named = lambda df, *names: df.select(*(F.col(c).alias(n) for c, n in zip(("content_hash", "text_sha256", "group_size", "keep_id"), names, strict=True)))
    hot = named(groups.filter(F.col("group_size") > most), hot_key, hot_text, hot_size, hot_id)
    cold = named(groups.filter(F.col("group_size") <= most), cold_key, cold_text, size, first)
    rows = rows.join(F.broadcast(hot), (F.col("content_hash") == F.col(hot_key)) & (F.col("text_sha256") == F.col(hot_text)), "left")
    rows = rows.withColumn(key, F.when(F.col(hot_size).isNull(), F.col("content_hash")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    rows = rows.join(cold, (F.col(key) == F.col(cold_key)) & (F.col("text_sha256") == F.col(cold_text)), "left")
    found = F.col(size).isNotNull() | F.col(hot_size).isNotNull()
    keep = F.when(found, F.coalesce(first, hot_id)).otherwise(F.col(id))
    out = rows.withColumns({"group_size": F.coalesce(size, hot_size, F.lit(1)).cast("bigint"), "keep_id": keep, "kept": F.col(id).eqNullSafe(keep)})
    return out.drop(hot_key, hot_text, hot_size, hot_id, cold_key, cold_text, size, first, key)


QUERY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(n) AS text_sha256
FROM d
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
