"""The Merkle manifest against plain Python, in trees of all shapes, and with odd rows."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from trackspark.llm import merkle

FIELDS = merkle.FIELDS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(nodes):
    """Root, and for each leaf the siblings left and right of its node at every level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, k in zip(proofs, at):
            a = k // 8 * 8
            proof.append(("".join(nodes[a:k]), "".join(nodes[k + 1 : a + 8])))
        nodes = [sha("".join(nodes[a : a + 8])) for a in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0] if nodes else None, proofs


def plain(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for lang in langs]
    trees = [tree([leaf(r) for r in group]) for group in groups]
    root, above = tree([t[0] for t in trees])
    out = []
    for group, (subroot, proofs), more in zip(groups, trees, above):
        for r, proof in zip(group, proofs):
            now = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                now["text"] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
            folded, proof = leaf(now), proof + more
            for left, right in proof:
                folded = sha(left + folded + right)
            out.append((r["doc_id"], leaf(r), subroot, root, sha("".join(a + b for a, b in proof)), folded, folded == root))
    return sorted(out, key=str)


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


def got(df):
    return sorted((tuple(r) for r in merkle.verified(df).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9, 1], [64, 65, 1], [512, 513], [4097, 3, 600]])
def test_trees_of_all_shapes(spark, sizes):
    rows = [dict(doc_id=1000 * g + i, source="s", lang="abcdefgh"[g], n_chars=i, text=f"Text {i}" if i % 5 else "small") for g, n in enumerate(sizes) for i in range(n)]
    want = plain(rows)
    assert got(make(spark, rows).repartition(3)) == want
    assert {r[-1] for r in want} == {True, False} or len(want) < 9


def test_many_groups(spark):
    rows = [dict(doc_id=i, source=None, lang=f"l{i % 70}é", n_chars=None, text="T" * (i % 3)) for i in range(210)]
    assert got(make(spark, rows)) == plain(rows)


def test_odd_rows(spark):
    rows = [dict(doc_id=i, source=None if i % 4 else "-", lang=[None, "", "en", "é", "z"][i % 5], n_chars=None if i % 3 else -i, text=[None, "", "ÄÖ a", "Aa\nB", "漢字 Z" * 50][i % 5]) for i in range(40)]
    rows += [dict(rows[7])] * 30 + [dict(doc_id=None, source="s", lang="en", n_chars=1, text="No id")] * 20 + [dict(rows[7], text="Another of that id")]
    df = make(spark, rows)
    assert got(df) == plain(rows)
    clashing = df.withColumns({c: F.lit("own") for c in ("g", "by", "hash", "own", "rank", "total", "at", "kids", "proof", "leaf", "root", "now", "salt", "height", "block", "over")})
    assert got(clashing) == plain(rows)
    assert got(df.limit(0)) == []


def test_very_long_text(spark):
    rows = [dict(doc_id=i, source="s", lang="en", n_chars=1, text="Long " * (400_000 if i == 1 else 1)) for i in range(4)]
    assert got(make(spark, rows)) == plain(rows)


def test_any_change_is_seen(spark):
    rows = [dict(doc_id=i, source="s", lang="en", n_chars=i, text=f"t{i}") for i in range(20)]
    base = merkle.manifest(make(spark, rows), FIELDS, "lang", "doc_id")
    assert base.filter(merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 20
    for change in ({"doc_id": 99}, {"source": None}, {"n_chars": 7}, {"text": "t3 "}, {"lang": "de"}):
        other = merkle.manifest(make(spark, [dict(r, **change) if r["doc_id"] == 3 else r for r in rows]), FIELDS, "lang", "doc_id")
        assert other.first()["root"] != base.first()["root"]


def test_query_equals_plain_python_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    result = merkle.query(spark, sf)
    found = sorted((tuple(r) for r in result.collect()), key=str)
    assert found == plain(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert found == sorted(con.sql(f"SELECT {', '.join(result.columns)} FROM ({merkle.QUERY_SQL})").fetchall(), key=str)
