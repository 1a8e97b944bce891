"""Workspaces: tables kept together, whole or not at all.

A save writes all tables below a new version's folder, then a manifest with the rows and the digest of each, and last of
all moves the name of the version to where loads look. So a save that fails leaves what was there, and a load can tell
tables that are damaged.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.scan import gathered

#: Tables of a workspace, and for each the table whose track_id its own must be in.
WORKSPACE = {"datasets": None, "points": "datasets", "channels": "datasets", "ingest_audit": "datasets", "operation_log": "datasets", "quality_events": "datasets", "fusion_decisions": None}
#: Tables that a workspace for playback only leaves out.
HISTORY = ("operation_log", "fusion_decisions")
#: What the manifest says that it is, and the versions that stay beside the current one.
FORMAT, KEPT = "trackspark-workspace-1", 1


class _Files:
    """Small files and renames in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/"), spark.sparkContext._gateway
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        source = self.fs.open(self.path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def replace(self, name: str, text: str) -> None:
        """A file's whole content at once: readers see the old one or the new one."""
        spare = f"{name}.{uuid.uuid4().hex}"
        self.write(spare, text)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(self.path(spare)), self.fs.makeQualified(self.path(name)), options)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def folders(self, name: str) -> list[tuple[int, str]]:
        """(time, name) of folders, oldest first."""
        if not self.fs.exists(self.path(name)):
            return []
        return sorted((s.getModificationTime(), s.getPath().getName()) for s in self.fs.listStatus(self.path(name)) if s.isDirectory())


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum over their hashes that doesn't depend on their order."""
    one = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(one), F.lit(0).cast("decimal(38,0)"))).first()
    return n, str(total)


def _table(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """Read by the schema that was saved, so that folders' names aren't taken for numbers."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}").select(*schema.names)


def save_workspace(tables: dict[str, DataFrame], path: str, history: bool = True) -> str:
    """Tables as Parquet, points by track; without history for playback only. Returns the version's name.

    Readers see the old workspace until the new one is whole; the one before the current one stays, older ones go.
    """
    if extra := set(tables) - set(WORKSPACE):
        raise ValueError(f"a workspace has no {', '.join(sorted(extra))}")
    if not tables:
        raise ValueError("a workspace has a table at least")
    spark = next(iter(tables.values())).sparkSession
    files, version = _Files(spark, path), uuid.uuid4().hex
    folder = f"{files.root}/versions/{version}"
    try:
        manifest = {"format": FORMAT, "history": history, "tables": {}}
        for name, df in tables.items():
            if history or name not in HISTORY:
                writer = gathered(df, "track_id").sortWithinPartitions("track_id", "seq").write.partitionBy("track_id") if name == "points" else df.write
                writer.parquet(f"{folder}/{name}")
                n, total = digest(_table(spark, folder, name, df.schema))
                manifest["tables"][name] = {"rows": n, "digest": total, "schema": df.schema.jsonValue()}
        files.write(f"versions/{version}/manifest.json", json.dumps(manifest, sort_keys=True))
        files.replace("CURRENT", version)
    except BaseException:
        if files.read("CURRENT") != version:
            files.remove(f"versions/{version}")
        raise
    for _, old in [x for x in files.folders("versions") if x[1] != version][: -KEPT or None]:
        files.remove(f"versions/{old}")
    return version


def _current(spark: SparkSession, path: str) -> tuple[str, dict]:
    files = _Files(spark, path)
    version = files.read("CURRENT")
    text = version and files.read(f"versions/{version}/manifest.json")
    if not text:
        raise ValueError(f"{path} has no workspace")
    manifest = json.loads(text)
    if manifest.get("format") != FORMAT:
        raise ValueError(f"{path} is a workspace of another format, {manifest.get('format')}")
    return f"{files.root}/versions/{version}", manifest


def workspace_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(table, rows, digest) of the current version."""
    _, manifest = _current(spark, path)
    return spark.createDataFrame([(name, x["rows"], x["digest"]) for name, x in sorted(manifest["tables"].items())], "table string, rows bigint, digest string")


def load_workspace(spark: SparkSession, path: str, names: list[str], verify: bool = True) -> dict[str, DataFrame]:
    """Those tables of the current version, with the columns and types that were saved.

    Refuses tables whose rows or digest aren't the manifest's (verify reads them once for that), rows of tracks that
    datasets doesn't know, and datasets that are there twice.
    """
    folder, manifest = _current(spark, path)
    if lost := [n for n in names if n not in manifest["tables"]]:
        raise ValueError(f"the workspace has no {', '.join(lost)}")
    tables = {n: _table(spark, folder, n, StructType.fromJson(manifest["tables"][n]["schema"])) for n in names}
    for name, df in tables.items() if verify else ():
        if digest(df) != (manifest["tables"][name]["rows"], manifest["tables"][name]["digest"]):
            raise ValueError(f"table {name} is damaged")
    if "datasets" in tables:
        ids = tables["datasets"].select("track_id")
        if twice := ids.groupBy("track_id").count().filter("count > 1").first():
            raise ValueError(f"dataset {twice[0]} is there {twice[1]} times")
        for name, df in tables.items():
            if WORKSPACE.get(name) and "track_id" in df.columns and (lost := df.join(ids, "track_id", "left_anti").first()):
                raise ValueError(f"{name} has rows of {lost['track_id']}, which isn't a dataset")
    return tables
