"""Near duplicates: an exact Jaccard join of word-shingle sets by parity sketches.

Equal sets are one class first. A set of n shingles is dealt by hash to k blocks, k the power of two below n;
the XOR of the shingle hashes of each block is its sketch word. A shingle in one set only changes one block at
most, so the number of differing words lower-bounds the symmetric difference, which is n // 4 at most for sets
of similarity 0.8. By the pigeonhole principle two such sets have a block in common among any n // 4 + 1 words
of either that come first in one order of all words; sets join on those. A set near the next power of two is
dealt by that as well. Sets below SMALL shingles join on the shingles themselves.

The order puts words that many documents have last. It steers how large buckets get, never which links are found.

In a bucket, all meet its least class (linear in its size); the pairs are filtered by size and by the Hamming
distance of parity sketches of a bit or two for each shingle, and verified by the exact sets. Only pairs of a bucket that these links
leave in different components are compared as well, in blocks, so that no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .sketches import apart
from .tables import lookup, materialise
from .words import by_size, mix, shingle_sets

#: Linked: PERCENT * size of the intersection >= NEAR * size of the union; 100 and 80 are what the blocks rely on.
PERCENT, NEAR = 100, 80
SMALL = 32
#: Bits of a parity sketch at least; else the power of two at or above the number of shingles.
SKETCH = 512
#: A sketch word that this share of documents has is common.
COMMON = 0.002
#: Documents whose words are counted at a time for that.
WINDOW = 4000
#: Sets of one bucket that are compared at a time.
BLOCK = 2048
#: In a bucket of more than LARGE classes, PIVOTS of them meet all others before all pairs are compared, so that
#: what is much alike is one component by then and only pairs between components are left.
LARGE, PIVOTS = 64, 4
_U = np.uint64


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def sketch_words(value: np.ndarray, first: np.ndarray, docs: np.ndarray, level: np.ndarray, scale: int):
    """Words of sets docs at level (0: the shingles themselves): word, index into docs; rising by that."""
    n = np.diff(first)[docs]
    at = np.repeat(first[docs], n) + _ramp(n)
    v, owner = value[at], np.repeat(np.arange(len(docs)), n)
    deep = level[owner] > 0
    k = (level * scale).astype(np.uint64)
    h = mix(v ^ _U(0xA5A5A5A5A5A5A5A5))
    block = ((h >> _U(32)) * k[owner]) >> _U(32)
    base = np.concatenate([[0], np.cumsum(np.where(level > 0, level * scale, n))])
    group = np.where(deep, base[owner] + block.astype(np.int64), base[owner] + np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n))
    order = np.argsort(group, kind="stable")
    group, v, owner, block = group[order], v[order], owner[order], block[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    word = np.bitwise_xor.reduceat(mix(v), start) if len(start) else np.zeros(0, np.uint64)
    owner = owner[start]
    word = mix(word + mix(np.where(level[owner] > 0, block[start], _U(0)) * _U(0x9E3779B97F4A7C15) + level[owner].astype(np.uint64) * _U(0xD1B54A32D192ED03) + _U(scale)))
    return word, owner


def levels(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set index and level of each level that a set of n shingles is dealt by. Below 4 only equal sets are linked."""
    own = np.where(n < SMALL, 0, 1 << np.floor(np.log2(np.maximum(n, 1))).astype(np.int64))
    after = np.where(n < SMALL, SMALL, 2 * own)
    index, up = np.flatnonzero(n >= 4), np.flatnonzero((n >= 4) & (n * 5 // 4 >= after))
    return np.concatenate([index, up]), np.concatenate([own[index], after[up]])


def prefix_size(n: np.ndarray, level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, n // 4 + 1, n - (n * 4 + 4) // 5 + 1)


def _summary(value: np.ndarray, first: np.ndarray):
    """Two hashes of each set; its parity sketch in 64-bit lanes: all lanes, and len + 1 offsets."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    full = n > 0
    if len(value):
        a[full] = np.bitwise_xor.reduceat(mix(value ^ _U(0x51ED270B)), first[:-1][full])
        b[full] = np.add.reduceat(mix(value + _U(0x2545F4914F6CDD1D)), first[:-1][full])
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    at = base[doc] + (mix(value) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=base[-1]).astype(np.uint8) & 1
    return a, b, np.packbits(odd, bitorder="little").view(np.int64), base // 64


def _key(n, a, b):
    return mix(mix(a + n.astype(np.uint64)) + b)


def shingle_classes(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(id, n, a, b, key, lanes, scale) of each document; and (word, docs) rows of common words, id and n null.

    scale is the multiple of the level's blocks with which the set has more words than it may differ in.
    """
    kinds = [("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("lanes", pa.list_(pa.int64())), ("scale", pa.int64()), ("word", pa.int64()), ("docs", pa.int64())]
    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, " + ", ".join(f"{k} {'array<bigint>' if k == 'lanes' else 'bigint'}" for k, _ in kinds)
    names = [id, *(k for k, _ in kinds)]

    def run(batches):
        kept, n_kept, kind = [], 0, None
        for batch in by_size(batches, text):
            kind = batch.schema.field(id).type
            value, first = shingle_sets(batch.column(text))
            n = np.diff(first)
            a, b, lanes, lane = _summary(value, first)
            index, level = levels(n)
            word, owner = sketch_words(value, first, index, level, 1)
            short = np.flatnonzero((np.bincount(owner, minlength=len(index)) < prefix_size(n[index], level)) & (level > 0))
            scale = np.ones(len(n), np.int64)
            for i in short:  # next to never
                while len(sketch_words(value, first, index[i : i + 1], level[i : i + 1], int(scale[index[i]]))[0]) < n[index[i]] // 4 + 1:
                    scale[index[i]] *= 2
            key = _key(n, a, b)
            own = [x.view(np.int64) for x in (a, b, key)]
            blank = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(n), *map(pa.array, own), pa.ListArray.from_arrays(pa.array(lane, pa.int32()), pa.array(lanes)), pa.array(scale), blank, blank], names)
            kept.append(word)
            n_kept += len(n)
            if n_kept >= WINDOW:
                yield _common(kept, n_kept, kind, names, kinds)
                kept, n_kept = [], 0
        if n_kept:
            yield _common(kept, n_kept, kind, names, kinds)

    return docs.select(id, text).mapInArrow(run, schema)


def _common(kept, n_docs: int, kind, names, kinds) -> pa.RecordBatch:
    word, n = np.unique(np.concatenate(kept), return_counts=True)
    often = n >= max(4, COMMON * n_docs)
    m = int(often.sum())
    blank = [pa.nulls(m, kind), *(pa.nulls(m, k) for _, k in kinds[:-2])]
    return pa.RecordBatch.from_arrays([*blank, pa.array(word[often].view(np.int64)), pa.array(n[often])], names)


def words_of(docs: DataFrame, text: str, scale: int, common: np.ndarray) -> DataFrame:
    """(word, key) of the first words of each set, each class once in a task."""
    held = docs.sparkSession.sparkContext.broadcast(common)  # bounded: see COMMON

    def run(batches):
        common, seen = held.value, np.zeros(0, np.uint64)
        for batch in by_size(batches, text):
            value, first = shingle_sets(batch.column(text))
            n = np.diff(first)
            a, b, _, _ = _summary(value, first)
            key = _key(n, a, b)
            _, once = np.unique(key, return_index=True)
            once = once[~np.isin(key[once], seen)]
            seen = np.union1d(seen, key[once])
            index, level = levels(np.where(np.isin(np.arange(len(n)), once), n, 0))
            word, owner = sketch_words(value, first, index, level, scale)
            at = np.searchsorted(common, word)
            at[at == len(common)] = 0
            late = common[at] == word if len(common) else np.zeros(len(word), bool)
            order = np.lexsort((word, late, owner))
            word, owner = word[order], owner[order]
            begin = np.searchsorted(owner, np.arange(len(index)))
            take = np.arange(len(word)) - begin[owner] < prefix_size(n[index], level)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(word[take].view(np.int64)), pa.array(key[index[owner[take]]].view(np.int64))], ["word", "key"])

    return docs.select(text).mapInArrow(run, "word bigint, key bigint")


def _near(n1, n2):
    """Sizes of sets that can be linked."""
    return (PERCENT * F.least(n1, n2)) >= (NEAR * F.greatest(n1, n2))


def _filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of keys (x, y) to pairs of class ids (a, b) that sizes and parity sketches allow.

    Sizes differ by a quarter at most, so sketches by a factor of two at most.
    """
    side = lambda key, to, p: classes.select(F.col("key").alias(key), F.col("id").alias(to), F.col("n").alias(f"{p}_n"), F.col("lanes").alias(f"{p}_l"))
    both = pairs.join(side("x", "a", "p"), "x").join(side("y", "b", "q"), "y").filter("a <> b").filter(_near(F.col("p_n"), F.col("q_n")))
    return both.filter(apart("p_l", "q_l") * 9 <= F.col("p_n") + F.col("q_n")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b: class ids) whose sets are linked. texts: i, t of all classes in question."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        for big in batches:
            for batch in by_size([big], "ta"):
                (u, fu), (v, fv) = shingle_sets(batch.column("ta")), shingle_sets(batch.column("tb"))
                keep = []
                for i in range(batch.num_rows):
                    p, q = u[fu[i] : fu[i + 1]], v[fv[i] : fv[i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(PERCENT * both >= NEAR * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _square(lanes: pa.ListArray) -> np.ndarray:
    """Lanes of all rows, each folded to the fewest that one has. Unsigned: bitwise_count takes absolute values."""
    size = np.diff(lanes.offsets.to_numpy())
    flat, least = lanes.flatten().to_numpy().view(np.uint64), int(size.min())
    at = np.cumsum(size) - size
    out = np.empty((len(size), least), np.uint64)
    for k in np.unique(size):
        rows = np.flatnonzero(size == k)
        out[rows] = np.bitwise_xor.reduce(flat[at[rows, None] + np.arange(k)].reshape(len(rows), k // least, least), axis=1)
    return out


def apart_pairs(members: DataFrame, pivots: int | None = None) -> DataFrame:
    """Pairs (a, b) of class ids of one bucket, in different components, that sizes and sketches allow.

    With pivots, only pairs with so many of a block's sets, others in each bucket.

    members: bucket, m (how many it has), id, component, n, lanes. A bucket is cut into blocks of BLOCK sets, and each pair of
    blocks is one group, so that a group's size is bounded; it is streamed in order, and one is held at a time.
    """
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "component", "n", "lanes")
    group = ["bucket", "low", "high"]
    kind = members.schema["id"].dataType.simpleString()

    def compare(rows: pa.Table):
        ids, comp, n = (rows.column(c).to_numpy() for c in ("id", "component", "n"))
        part = rows.column("part").to_numpy()
        lanes = _square(rows.column("lanes").combine_chunks())
        own = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        left = np.arange(len(ids)) if own else np.flatnonzero(part == rows.column("low")[0].as_py())
        right = left if own else np.flatnonzero(part == rows.column("high")[0].as_py())
        if pivots is not None:
            seed = np.int64(rows.column("bucket")[0].as_py()).view(np.uint64)
            left = left[np.argsort(mix(ids[left].astype(np.uint64) ^ seed))[:pivots]]
        for i in left:
            j = right[(comp[right] != comp[i]) & (ids[right] > ids[i])] if own and pivots is None else right[comp[right] != comp[i]]
            j = j[PERCENT * np.minimum(n[j], n[i]) >= NEAR * np.maximum(n[j], n[i])]
            if len(j):
                j = j[9 * np.bitwise_count(lanes[j] ^ lanes[i]).sum(axis=1, dtype=np.int64) <= n[j] + n[i]]
                if len(j):
                    yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])

    def run(batches):
        held, name, out = [], None, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys[a] != name and held:
                    out += compare(pa.Table.from_batches(held))
                    held = []
                name = keys[a]
                held.append(batch.slice(a, b - a))
            found = np.unique(np.column_stack([np.concatenate([x[k] for x in out]) for k in (0, 1)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            out = out[:1]
        if held:
            out += compare(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _unresolved(shared: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, m, id, component, n, lanes) of buckets of m classes, three or more, in different components."""
    info = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), "n", "lanes")
    info = materialise(info)
    buckets = shared.join(info.select("key", "component"), "key").groupBy("word").agg(F.count("*").alias("m"), F.min("component").alias("p"), F.max("component").alias("q")).filter("m > 2 and p <> q").select("word", "m")
    return shared.select("word", "key").join(buckets, "word").join(info, "key").select(F.col("word").alias("bucket"), "m", "id", "component", "n", "lanes")


def _extended(found: DataFrame, links: DataFrame) -> DataFrame:
    return materialise(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)))


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) of each document: the least id that links reach, its own included.

    Words are runs of other than space and characters 9 to 13, with A-Z as a-z; shingles are five words, the
    whole sequence if it is shorter. Null texts and texts without words have no shingle and are linked with
    nothing. Repeated rows are linked; rows of one id are one document, linked with what any of its texts is. id is a
    whole number; rows without one are linked with nothing, and their component_id is null.
    """
    docs = docs.select(F.col(id).cast("bigint").alias(id), text)
    unnamed = shingle_classes(docs.filter(F.col(id).isNull()), text, id).filter("n is not null").select(id, F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    docs = docs.filter(F.col(id).isNotNull())
    rows = materialise(shingle_classes(docs, text, id))
    sets = rows.filter("n is not null").drop("word", "docs")
    total, scale = sets.agg(F.count("*"), F.max("scale")).first()
    often = rows.filter("word is not null").groupBy("word").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= COMMON * total)
    # A set has fewer words than shingles, so these are 1 / COMMON times the mean number of shingles at most.
    common = np.sort(often.select("word").toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    classes = sets.filter("n > 0").groupBy("key", "n", "a", "b").agg(F.min(id).alias("id"), F.count("*").alias("copies"), F.first("lanes").alias("lanes"))
    classes = materialise(classes)
    by_word = Window.partitionBy("word").orderBy("key")
    shared = words_of(docs, text, int(scale or 1), common)
    shared = shared.select("word", "key", F.lag("key").over(by_word).alias("before"), F.first("key").over(by_word).alias("pivot"), F.max("key").over(Window.partitionBy("word")).alias("top"))
    shared = materialise(shared.filter("pivot <> top and (before is null or before <> key)").select("word", "key", "pivot"))
    ids = shared.select("key").distinct().join(classes.select("key", "id"), "key").select(F.col("id").alias("i")).distinct()
    texts = materialise(docs.select(F.col(id).alias("i"), F.col(text).alias("t")).join(ids, "i", "left_semi"))
    pairs = _filtered(shared.filter("key <> pivot").select(F.col("pivot").alias("x"), F.col("key").alias("y")).distinct(), classes)
    links = materialise(verified(pairs, texts))
    found = materialise(components(links))
    members = _unresolved(shared, classes, found)
    near = materialise(verified(apart_pairs(members.filter(F.col("m") > LARGE), PIVOTS), texts))
    if not near.isEmpty():
        found = _extended(found, near)
        members = _unresolved(shared, classes, found)
    more = materialise(verified(apart_pairs(members), texts))
    if not more.isEmpty():
        found = _extended(found, more)
    place = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "n", "a", "b", "copies", F.coalesce("component", "id").alias("component_id"))
    place = materialise(place.filter("copies > 1 or component_id is not null"))
    out = lookup(sets.select(id, "n", "key", "a", "b"), ["key", "n", "a", "b"], place, "copies")
    return out.select(id, F.col("n").alias("n_shingles"), F.coalesce("component_id", id).alias("component_id")).unionByName(unnamed)


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return near_duplicates(table(spark, sf_dir, "documents"))
