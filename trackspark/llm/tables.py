"""Reading the input tables and materialising intermediate results."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.folders import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables written inside each open scope.
_scopes: list[list[DataFrame]] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, keeps columns compressed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("t-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scope():
    """Deletes at its end the tables materialised inside, also when it fails; what is made of them must be written by then.

    A table given to the yielded function stays, and belongs to the scope around.
    """
    _scopes.append([])

    def keep(df: DataFrame) -> DataFrame:
        _scopes[-1][:] = [x for x in _scopes[-1] if x is not df]
        if len(_scopes) > 1:
            _scopes[-2].append(df)
        return df

    try:
        yield keep
    finally:
        discard(*_scopes.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, as close to the given ones as can be."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with more than this share of all rows is heavy; there can be only 1 / HEAVY of them.
HEAVY = 0.001


def lookup(rows: DataFrame, key: list[str], found: DataFrame, weight: str, share: float = HEAVY) -> DataFrame:
    """rows with found's other columns, null where no key matches. found has a row for each key at most.

    weight says how many of rows have the key, so that there are 1 / share heavy keys at most. Those are
    broadcast; rows that meet one take a salt, so that no partition of the other join holds all of a key.
    """
    value = [c for c in found.columns if c not in (*key, weight)]
    most = (found.agg(F.sum(weight)).first()[0] or 0) * share
    side = found.select(*(F.col(c).alias(f"_k_{c}") for c in key), F.struct(*value).alias("_v"), weight)
    hot, cold = side.filter(F.col(weight) > most).drop(weight), side.filter(F.col(weight) <= most).drop(weight)
    hot = hot.withColumnRenamed("_v", "_hot")
    match = lambda: [F.col(c) == F.col(f"_k_{c}") for c in key]
    out = rows.join(F.broadcast(hot), match(), "left").drop(*(f"_k_{c}" for c in key))
    out = out.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))
    out = out.join(cold.withColumn("_zero", F.lit(0).cast("bigint")), [*match(), F.col("_salt") == F.col("_zero")], "left")
    both = F.coalesce("_hot", "_v")
    return out.withColumns({c: both[c] for c in value}).drop("_hot", "_v", "_salt", "_zero", *(f"_k_{c}" for c in key))
