"""Personal data: base patterns, and contextual extraction bootstrapped from what these find.

The base patterns are scanned in linear time over whole texts. Their finds are the seeds: each seed, and each
other token that looks like an identifier, carries lexical patterns of the words around it. Spark then scores
the graph of patterns and instances in rounds: a pattern is trusted for a kind if enough different known
values of that kind occur in it and few unknown ones; an unknown instance in trusted patterns becomes known,
and lends weight to further patterns.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh, materialise

#: In the order in which spans that start alike are listed.
KINDS = ("email", "ip", "card", "phone")
#: A pattern is trusted for a kind from so many different known values, and so large a share of all its values.
LEAST_VALUES, LEAST_SHARE = 3, 0.6
#: An instance is found from this confidence, the noisy-or of its patterns' shares.
CONFIDENCE = 0.6
ROUNDS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[^\s]+")
_JOINED = re.compile(r"[0-9]++(?:[\x20().-]{1,2}+[0-9]++)*+")
_EDGES = "\"'.,;:!?()[]{}<>|#$%&*"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last and (m := _DOMAIN.match(text, at)):
            a = at
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a < at:
                out.append((a, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts = list(_NUMBER.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(x := p[0].lstrip("0")) <= 3 and int(x or "0") <= 255 for p in four):
                out.append((four[0].start(), four[3].end()))
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 14:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base finds, in order."""
    found = ((emails(text) if "@" in text else []), ips(text), cards(text), phones(text))
    return sorted((a, k, b) for k, spans in enumerate(found) for a, b in spans)


def shape(value: str) -> str:
    """What kinds of value have in common: an at sign, dotted digits, or a rough number of digits."""
    digits = sum("0" <= c <= "9" for c in value)
    if "@" in value:
        return "at"
    if value.count(".") >= 3 and digits >= 4:
        return "dots"
    return "few" if digits < 5 else "short" if digits < 10 else "mid" if digits < 14 else "long" if digits < 20 else "hex"


def _enough(text: str, at: int, way: int, words: int) -> str:
    """What goes before (or behind) a place, wide enough for so many whole words, or to the end of the text."""
    size = 64
    while True:
        part = text[max(0, at - size) : at] if way < 0 else text[at : at + size]
        if len(part.split()) > words or len(part) < size:
            return part
        size *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the two words before, and the words on either side; digits as 0."""
    a, b = _enough(text, start, -1, 2), _enough(text, end, 1, 1)
    before = [w.strip(_EDGES).lower() for w in a.split()[-2:]] if a[-1:].isspace() or not a else []
    behind = [w.strip(_EDGES).lower() for w in b.split()[:1]] if b[:1].isspace() or b[:1] in _EDGES else []
    before, behind = [re.sub("[0-9]", "0", w) for w in before if w], [re.sub("[0-9]", "0", w) for w in behind if w]
    out = [" ".join(["L", *before])] if len(before) == 2 else []
    if before and behind:
        out.append(f"M {before[-1]} _ {behind[0]}")
    return out


def instances(text: str, base: list[tuple[int, int, int]]):
    """(kind or -1, start, end, value, shape, patterns) of the base finds and of other likely tokens."""
    for a, k, b in base:
        yield k, a, b, text[a:b], shape(text[a:b]), contexts(text, a, b)
    taken, i = sorted((a, b) for a, _, b in base), 0
    for m in _likely(text):
        raw = m[0]
        a = m.start() + len(raw) - len(raw.lstrip(_EDGES))
        b = m.end() - (len(raw) - len(raw.rstrip(_EDGES)))
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b <= a or (i < len(taken) and taken[i][0] < b):
            continue
        value = text[a:b]
        if own := contexts(text, a, b):
            yield -1, a, b, value, shape(value), own


def _likely(text: str):
    """Tokens with a digit or an at sign, and runs of digits joined by blanks, brackets, dots or hyphens. A text is cut into tokens only around those characters."""
    last = 0
    for hit in re.finditer(r"[0-9@]+", text):
        if hit.start() < last:
            continue
        m = _JOINED.match(text, hit.start())
        if m and m.end() > hit.end() and any(c in " ()" for c in m[0]) and (m.end() == len(text) or not text[m.end()].isalnum()) and (hit.start() == 0 or not text[hit.start() - 1].isalnum()):
            last = m.end()
            yield m
            continue
        a, b = hit.start(), hit.end()
        while a > last and not text[a - 1].isspace():
            a -= 1
        m = _TOKEN.match(text, a)
        last = m.end()
        yield m


def scan(docs: DataFrame, text: str = "text", names: tuple[str, str] = ("base", "likely")) -> DataFrame:
    """All columns of docs but the text, with base (array of kind, start, end) and likely (array of instances), or by other names."""
    base_kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    like_kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("shape", pa.string()), ("patterns", pa.list_(pa.string()))]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), f"`{names[0]}` array<struct<kind:int,start:bigint,end:bigint>>", f"`{names[1]}` array<struct<kind:int,start:bigint,end:bigint,value:string,shape:string,patterns:array<string>>>"])

    def run(batches):
        for batch in batches:
            base, likely = [], []
            for x in batch.column(text):
                one = x.as_py() or ""
                found = base_spans(one)
                base.append([{"kind": k, "start": a, "end": b} for a, k, b in found])
                likely.append([dict(zip(("kind", "start", "end", "value", "shape", "patterns"), x, strict=True)) for x in instances(one, found)])
            keep = [i for i, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(base, base_kind), pa.array(likely, like_kind)], [*(batch.schema.names[i] for i in keep), *names])

    return docs.mapInArrow(run, schema)


def discover(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(row, start, end, kind, confidence) of instances that trusted patterns find.

    edges: row, start, end, kind (-1: unknown), value, shape, pattern. In each round a pattern's share for a
    kind counts different values: those known over all, of one shape. An instance is of the kind for which
    its patterns' noisy-or is highest; ties go to the kind listed first.
    """
    spot = ["row", "start", "end"]
    known = edges.filter("kind >= 0").select("pattern", "shape", "value", "kind").distinct()
    unknown = edges.filter("kind < 0").drop("kind")
    every = edges.select("pattern", "shape", "value").distinct().groupBy("pattern", "shape").agg(F.count("*").alias("n_all"))
    every = materialise(every.filter(F.col("n_all") >= LEAST_VALUES))
    found = None
    for _ in range(rounds):
        trusted = known.groupBy("pattern", "shape", "kind").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_VALUES)
        trusted = trusted.join(every, ["pattern", "shape"]).withColumn("share", F.col("n") / F.col("n_all")).filter(F.col("share") >= LEAST_SHARE)
        hits = unknown.join(trusted.select("pattern", "shape", "kind", "share"), ["pattern", "shape"])
        hits = hits.groupBy(*spot, "value", "shape", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6)))))).alias("confidence"))
        hits = hits.filter(F.col("confidence") >= CONFIDENCE).groupBy(*spot, "value", "shape").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
        found = materialise(hits.select(*spot, "value", (-F.col("best.k")).alias("kind"), "best.confidence"))
        fresh = edges.filter("kind < 0").drop("kind").join(found.select(*spot, "kind"), spot).select("pattern", "shape", "value", "kind")
        known = edges.filter("kind >= 0").select("pattern", "shape", "value", "kind").union(fresh).distinct()
    return found.select(*spot, "kind", "confidence")


def extract(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """All columns of docs but the text, with base and spans: arrays of (kind, start, end), in code points.

    spans are the base finds and those of the method, by start, then kind, then end. A null text is empty.
    Repeated rows are rows of their own; no rows give no rows. Own columns named base or spans are replaced.
    """
    docs = docs.drop("base", "spans")
    row, likely, more = fresh(docs, "row", "likely", "more")
    rows = materialise(scan(docs, text, ("base", likely)).withColumn(row, F.monotonically_increasing_id()))
    edges = rows.select(F.col(row).alias("row"), F.explode(likely).alias("x")).select("row", "x.start", "x.end", "x.kind", F.lower("x.value").alias("value"), "x.shape", F.explode("x.patterns").alias("pattern"))
    found = discover(edges, rounds)
    found = found.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")).alias(more))
    out = rows.drop(likely).join(found, row, "left")
    both = F.concat("base", F.coalesce(more, F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    order = F.array_sort(F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return out.withColumn("spans", F.transform(order, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).drop(row, more)


def _joined(spans):
    name = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])))


def _count(spans, kind: int):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def query(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    out = extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [_count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
