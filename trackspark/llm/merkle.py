"""A Merkle manifest of a table: a hash of every row, of every group and of all, and for each row the proof that it belongs.

Rows of a group are ranked without bringing a group together. The octal digits of a rank are the way to a row in its
tree. Blocks of consecutive rows meet in one task and are rolled up there: one digit column after the other is grouped
away, and each node nests the structs of its children. Blocks are leaves of the next tree up, until a group is one node.
On the way down, the nested children are transformed to what lies on either side of each and exploded, so that a row gets
its proof from its block; only what is above a block is joined to it, one row for each block.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise

#: Children of a node.
FAN = 8
#: Levels that a block rolls up; it has FAN ** LEVELS leaves at most.
LEVELS = 3
#: Levels that any number of rows in a long needs at most.
HIGHEST = 21
_STEPS = "array<struct<left:string,right:string>>"


def digest(parts: Iterable[Column]) -> Column:
    """Lowercase hex sha256 of texts end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value told apart from all others: '-' if null, else its bytes in UTF-8, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, step: digest([step["left"], node, step["right"]]))


def proof_text(proof: Column) -> Column:
    """All hashes of a proof, level by level, from left to right."""
    return F.concat_ws("", F.transform(proof, lambda step: F.concat(step["left"], step["right"])))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank from 0 in their g by the columns of order, nulls first, and total, the rows of their g.

    Rows are dealt by ranges of (g, order) and numbered where they lie; the counts of each task and g give what goes
    before. Equal rows are dealt by the number of the row, so that a task never has to hold all of them.
    """
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("g", *order, "salt").sortWithinPartitions("g", *order)
    dealt = materialise(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    runs = dealt.groupBy(F.col("g").alias("run_g"), task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("run_g")
    before = F.coalesce(F.sum("n").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("run_g", "task", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    out = dealt.join(runs, F.col("g").eqNullSafe(F.col("run_g")) & (task == F.col("task")))
    return out.select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "total")


def _rolled(nodes: DataFrame, stage: int) -> DataFrame:
    """(g, height, rank, hash, kids) of each block of nodes (g, height, rank, hash, own): its root, with all below it nested."""
    digits = [f"d{i}" for i in range(LEVELS)]
    out = nodes.withColumns({d: F.pmod(F.shiftright("rank", 3 * i), F.lit(FAN)).cast("int") for i, d in enumerate(digits)})
    out = out.withColumn("rank", F.shiftright("rank", 3 * LEVELS)).repartition("g", "rank")
    inside = "own"
    for i, digit in enumerate(digits):
        child = F.struct(F.col(digit).alias("d"), "hash", inside)
        out = out.groupBy("g", "height", "rank", *digits[:i:-1]).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        # A group that is one node already keeps it; else a run becomes a node, though it be a run of one.
        node = F.when(F.col("height") > stage * LEVELS + i, digest([F.concat_ws("", F.col("kids")["hash"])])).otherwise(F.col("kids")[0]["hash"])
        out, inside = out.withColumn("hash", node), "kids"
    return out.select("g", "height", "rank", "hash", "kids")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, lowest first; the last has one block for each g. nodes: g, rank, total, hash, own."""
    height = sum(((F.col("total") > FAN**i).cast("int") for i in range(HIGHEST)), F.lit(0))
    nodes = nodes.select("g", height.alias("height"), "rank", "hash", "own")
    stages: list[DataFrame] = []
    while True:
        stages.append(materialise(_rolled(nodes, len(stages))))
        if (stages[-1].agg(F.max("height")).first()[0] or 0) <= len(stages) * LEVELS:
            return stages
        nodes = stages[-1].select("g", "height", "rank", "hash", F.lit(None).cast("boolean").alias("own"))


def descended(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """hash, own, proof and above's other columns of each leaf; above: over (a g), proof (what is over its root) and others."""
    more = [c for c in above.columns if c not in ("over", "proof")]
    way = above.withColumn("block", F.lit(0).cast("bigint"))
    for stage in range(len(stages) - 1, -1, -1):
        blocks = stages[stage].drop("hash")
        out = blocks.join(way, F.col("g").eqNullSafe(F.col("over")) & (F.col("rank") == F.col("block"))).drop("over", "block")
        for i in range(LEVELS - 1, -1, -1):
            hashes = F.col("kids")["hash"]
            side = lambda first, n: F.concat_ws("", F.slice(hashes, first, n))  # noqa: E731, B023
            beside = F.transform("kids", lambda kid, k: F.struct(kid.alias("kid"), side(F.lit(1), k).alias("left"), side(k + 2, F.lit(FAN)).alias("right")))  # noqa: B023
            out = out.select("g", "height", "rank", "proof", *more, F.explode(beside).alias("x"))
            step = F.when(F.col("height") > stage * LEVELS + i, F.array(F.struct("x.left", "x.right"))).otherwise(F.array().cast(_STEPS))
            inside = "kids" if i else "own"
            out = out.select(
                "g", "height", (F.col("rank") * FAN + F.col("x.kid.d")).alias("rank"), F.concat(step, "proof").alias("proof"), *more,
                F.col("x.kid.hash").alias("hash"), F.col(f"x.kid.{inside}").alias(inside),
            )
        way = out.select(F.col("g").alias("over"), F.col("rank").alias("block"), "proof", *more)
    return out.select("hash", "own", "proof", *more)


def manifest(df: DataFrame, fields: list[str], group: str, order: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, proof) and the columns of keep of each row of df.

    leaf is the digest of the fields; rows of a group ascend by order, nulls first, equal ones by leaf. proof has for each
    level what lies left and right of the row's node, first in its group's tree, then in the tree of groups; an only row
    has none. keep are small columns made of df's. A null group is a group; repeated rows are leaves of their own; no rows
    give no rows. Other columns are not read. Work grows with rows, at one hash of each row and about a seventh for nodes.
    """
    own = {order: F.col(order)} | (keep or {})
    leaves = df.select(F.col(group).alias("g"), F.col(order).alias("by"), digest([field(F.col(c)) for c in fields]).alias("hash"), F.struct(*(c.alias(name) for name, c in own.items())).alias("own"))
    trees = grown(ranked(materialise(leaves), ["by", "hash"]).drop("by"))
    subroots = trees[-1].select(F.lit(0).alias("g"), "hash", F.struct(F.col("g").alias("of")).alias("own"), F.col("g").alias("by"))
    over = grown(ranked(subroots, ["by"]).drop("by"))
    root = over[-1].select(F.col("g").alias("over"), F.array().cast(_STEPS).alias("proof"), F.col("hash").alias("root"))
    above = descended(over, root).select(F.col("own.of").alias("over"), F.col("hash").alias("subroot"), "root", "proof")
    return descended(trees, above).select(*(F.col(f"own.`{name}`").alias(name) for name in own), F.col("hash").alias("leaf"), "subroot", "root", "proof")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked after some texts were tampered with: their A-Z lower-cased where 3 divides crc32 of the id.

    A null id is never tampered with. verified tells whether folding the leaf that is there gives the root.
    """
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest([field(F.translate(c, _CAPITALS, _SMALL) if c == "text" else F.col(c)) for c in FIELDS]))
    out = manifest(docs, FIELDS, "lang", "doc_id", {"now": changed}).withColumn("folded_root", fold(F.coalesce("now", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return verified(table(spark, sf_dir, "documents"))


def _sql(levels: int = 7) -> str:
    """The same in DuckDB, for groups of up to 8 ** levels rows and as many groups."""
    enc = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
    leaf = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"
    parts = ["k0 AS (SELECT i, i AS c FROM range(256) t(i))"]
    parts += [f"k{i + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM k{i})" for i in range(8)]
    bytes_of = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    parts += [
        "crc AS (SELECT list(c ORDER BY i) AS t FROM k8)",
        f"told AS (SELECT *, xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered FROM documents, crc)",
        f"""leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf("text")} AS leaf, CASE WHEN tampered THEN {leaf(f"translate(text, '{_CAPITALS}', '{_SMALL}')")} ELSE {leaf("text")} END AS now FROM told)""",
        "rows0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, row_number() OVER () AS row_id, now AS folded, '' AS proof FROM leaves)",
    ]

    def tree(nodes: str, rows: str, name: str, group: str) -> None:
        parts.append(f"{name}n0 AS ({nodes})")
        for i in range(levels):
            run = f"OVER (PARTITION BY g, r // {FAN} ORDER BY r ROWS BETWEEN"
            parts.append(f"{name}s{i} AS (SELECT g, r, hash, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(hash, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le, coalesce(string_agg(hash, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri FROM {name}n{i})")
            parts.append(f"{name}n{i + 1} AS (SELECT g, r // {FAN} AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(hash, '' ORDER BY r)) ELSE any_value(hash) END AS hash FROM {name}s{i} GROUP BY g, r // {FAN})")
            on = f"s.g = {group} AND s.r = w.{'gr' if name == 'g' else 'r'} // {FAN**i}"
            parts.append(f"{rows}{i + 1} AS (SELECT w.* REPLACE (CASE WHEN n > 1 THEN sha256(le || folded || ri) ELSE folded END AS folded, CASE WHEN n > 1 THEN proof || le || ri ELSE proof END AS proof) FROM {rows}{i} w JOIN {name}s{i} s ON {on})")

    tree("SELECT g, r, leaf AS hash FROM rows0", "rows", "l", "w.g")
    parts.append(f"subs AS (SELECT g AS name, hash AS subroot, row_number() OVER (ORDER BY g) - 1 AS gr FROM ln{levels})")
    parts.append(f"up0 AS (SELECT w.*, subroot, gr FROM rows{levels} w JOIN subs ON name = g)")
    tree("SELECT 0 AS g, gr AS r, subroot AS hash FROM subs", "up", "g", "0")
    return (
        f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} "
        f"SELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = hash AS verified FROM up{levels}, gn{levels}"
    )


QUERY_SQL = _sql()
