"""Tables that are written together: versioned folders, and one manifest that makes them current.

A folder holds data under `<table>/v<version>/...` and manifests under `_manifests`. Files are only ever
added; a version is there from the moment its manifest is, for all of its tables at once. A writer that fails
midway leaves files that no manifest names, and readers go on with the last version; vacuum() deletes such files.
Two writers of one version: the one that claims the number first goes on, the other raises.

The manifest names folders (a table's buckets, batches or partitions), never files or rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upserts import keep_last

#: Parts of a keyed table by the hash of its keys; an upsert writes those parts anew that it touches.
BUCKETS = 64
BUCKET, BATCH = "_bucket", "_batch"


class Conflict(RuntimeError):
    """Another writer has claimed the version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # the file system, by small steps that Hadoop's ones give

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "tables": {name: {"schema", "keys", "folders": {part: folder}}}} of a version, the last one if none is given; without any an empty one."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}}
        if version is not None and version not in known:
            raise ValueError(f"no version {version} in {self.root}")
        return json.loads(self._get(f"_manifests/{known[-1] if version is None else version}.json"))

    def _begin(self) -> int:
        """Claim the next number; a claim whose manifest never came is passed over."""
        taken = [int(n.removesuffix(".claim")) for n in self._names("_manifests") if n.endswith(".claim")]
        version = max([0, *taken, *self.versions()]) + 1
        try:
            self._put(f"_manifests/{version}.claim", "")
        except Exception as e:
            raise Conflict(f"version {version} of {self.root} is being written") from e
        return version

    def _commit(self, version: int, base: dict, tables: Mapping[str, dict]) -> int:
        if self.manifest()["version"] != base["version"]:
            raise Conflict(f"{self.root} is at version {self.manifest()['version']}, this change began at {base['version']}")
        made = {"version": version, "tables": base["tables"] | dict(tables)}
        self._put(f"_manifests/{version}.tmp", json.dumps(made, indent=1, sort_keys=True))
        if not self._fs.rename(self._path(f"{self.root}/_manifests/{version}.tmp"), self._path(f"{self.root}/_manifests/{version}.json")):
            raise Conflict(f"version {version} of {self.root} could not be made current")
        return version

    # reading

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, name: str, version: int | None = None, schema: str | T.StructType | None = None) -> DataFrame:
        """A table of a version; one that isn't there has no rows (of `schema`, which must be given then). Columns that older parts lack are null."""
        entry = self.manifest(version)["tables"].get(name)
        if entry is None:
            if schema is None:
                raise ValueError(f"no table {name} in {self.root}")
            return self.spark.createDataFrame([], schema)
        return self._read(entry)

    def _read(self, entry: dict, parts: Sequence[str] | None = None) -> DataFrame:
        kind = T.StructType.fromJson(entry["schema"])
        folders = [f"{self.root}/{f}" for p, f in sorted(entry["folders"].items()) if parts is None or p in parts]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    # writing

    def publish(self, tables: Mapping[str, DataFrame], partition_by: str | None = None) -> int:
        """Replace these tables, all at once; others stay. With partition_by, one folder per value inside the table's."""
        base, version = self.manifest(), self._begin()
        made = {}
        for name, df in tables.items():
            folder = f"{name}/v{version}"
            w = df.write.mode("errorifexists")
            (w.partitionBy(partition_by) if partition_by else w).parquet(f"{self.root}/{folder}")
            made[name] = {"schema": df.schema.jsonValue(), "keys": None, "folders": {"": folder}}
        return self._commit(version, base, made)

    def upsert(self, changes: Mapping[str, tuple[DataFrame, Sequence[str]]], buckets: int = BUCKETS) -> int:
        """Merge rows into keyed tables, all at once: the last row of a key wins, new columns are added.

        A table is kept in parts by the hash of its keys. Only the parts that the new rows touch are read and written. A
        table that wasn't keyed like this is read whole and becomes so.
        """
        base, version = self.manifest(), self._begin()
        made = {}
        for name, (new, keys) in changes.items():
            entry = base["tables"].get(name)
            keyed = entry is not None and entry["keys"] == [*keys] and entry.get("buckets") == buckets
            part = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")
            touched = None
            if keyed:  # at most `buckets` numbers
                touched = [str(r[0]) for r in new.select(part).distinct().collect()]
            old = self._read(entry, touched) if entry is not None else self.spark.createDataFrame([], new.schema)
            merged = keep_last(old, new, [*keys])
            folder = f"{name}/v{version}"
            merged.withColumn(BUCKET, part).repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
            folders = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{BUCKET}=")}
            kept = {p: f for p, f in entry["folders"].items() if p not in touched} if keyed else {}
            made[name] = {"schema": merged.schema.jsonValue(), "keys": [*keys], "buckets": buckets, "folders": kept | folders}
        return self._commit(version, base, made)

    def append(self, name: str, df: DataFrame, batch: str, columns: Sequence[str] | None = None) -> int:
        """Add a batch of rows once: a batch whose name is there changes nothing. With `columns`, a ledger's fixed ones: others are ignored, missing ones are null."""
        base = self.manifest()
        entry = base["tables"].get(name)
        if entry is not None and f"b:{batch}" in entry["folders"]:
            return base["version"]
        if columns is not None:
            df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
        version = self._begin()
        folder = f"{name}/v{version}"
        df.write.mode("errorifexists").parquet(f"{self.root}/{folder}")
        wanted = [T.StructType.fromJson(entry["schema"])] if entry is not None else []
        fields = {f.name: f for s in [*wanted, df.schema] for f in s.fields}
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])
        folders = (entry["folders"] if entry is not None else {}) | {f"b:{batch}": folder}
        return self._commit(version, base, {name: {"schema": schema.jsonValue(), "keys": None, "folders": folders}})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the manifests before the last `keep`, and every version's folder that none of the rest names; what went. Not while a writer is at work."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{v}.json"), False)
        named = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for f in t["folders"].values()}
        gone = []
        for table in self._names(""):
            if table.startswith("_"):
                continue
            for v in self._names(table):
                inside = [f"{table}/{v}/{x}" for x in self._names(f"{table}/{v}") if x.startswith(f"{BUCKET}=")]
                for folder in [f for f in inside if f not in named] if any(f in named for f in inside) else [] if f"{table}/{v}" in named else [f"{table}/{v}"]:
                    self._fs.delete(self._path(f"{self.root}/{folder}"), True)
                    gone.append(folder)
        return sorted(gone)
