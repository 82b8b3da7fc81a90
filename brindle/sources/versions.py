"""Tables whose slices are replaced all at once or not at all.

A table is a folder of Parquet data that is only ever added to, and a log with a small manifest for each version: which folder each slice (the value of a partition, or a
bucket of keys) is read from. A writer first writes its slices to a new folder, then the next manifest beside the log, and last renames that into the log. A reader
takes the newest manifest, so it sees the version before or the one after; what a writer that died has left is in no manifest. Two writers of the same version can't both
rename: the later one gets an error and has changed nothing. The file system must rename a file in one step and not over another one (HDFS and local disks do).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SLICE = "__slice"
#: The name of the slice of null.
NULL = "__HIVE_DEFAULT_PARTITION__"


class ConcurrentWrite(RuntimeError):
    """Another writer has made this version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- the log ---

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json") and n[0] != "."]

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, slices: {slice: folder}, notes} of a version, else of the newest; without any version an empty table's."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "slices": {}, "notes": {}}
        fs, path = self._file(f"log/{known[-1] if version is None else version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        fs, target = self._file(f"log/{manifest['version']:012d}.json")
        _, draft = self._file(f"log/.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise ConcurrentWrite(f"{self.path} has a version {manifest['version']} already")
        return manifest["version"]

    # --- reading ---

    def read(self, slices: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The table's rows, or those of some slices: no other folder is opened."""
        return self._rows(self.manifest(version), slices)

    def _rows(self, manifest: dict, slices: Iterable[str] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        schema, wanted = StructType.fromJson(manifest["schema"]), manifest["slices"]
        folders = sorted({f"{self.path}/{f}" for s, f in wanted.items() if slices is None or s in set(slices)})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- writing ---

    def _write(self, rows: DataFrame, by: Column) -> dict[str, str]:
        """Rows written to a new folder, and where each slice is in it. ``by`` names a row's slice."""
        folder = f"data/{uuid.uuid4().hex}"
        # few files for each slice; one that many rows have is split among tasks again
        rows.withColumn(_SLICE, by.cast("string")).hint("rebalance", _SLICE).write.partitionBy(_SLICE).parquet(f"{self.path}/{folder}")
        plain = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {plain(n.removeprefix(f"{_SLICE}=")): f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{_SLICE}=")}

    def replace(self, rows: DataFrame, by: Column, slices: Iterable[str] = (), notes: dict | None = None, before: dict | None = None) -> int:
        """A version in which the slices that ``rows`` has, and ``slices``, hold these rows; all other slices stay as they are.

        before: the manifest that the rows were made from, so that a version which another writer made meanwhile is found out; else the newest one.
        """
        before = before or self.manifest()
        written = self._write(rows, by)
        gone = set(slices) | set(written)
        kept = {s: f for s, f in before["slices"].items() if s not in gone}
        return self._commit({"version": before["version"] + 1, "schema": rows.schema.jsonValue(), "slices": kept | written, "notes": before["notes"] | (notes or {})})

    def overwrite(self, rows: DataFrame, by: Column, notes: dict | None = None) -> int:
        """A version that holds these rows only."""
        before = self.manifest()
        return self.replace(rows, by, before["slices"], notes, before)

    def note(self, notes: dict) -> int:
        """A version with the same rows and further notes."""
        before = self.manifest()
        return self._commit(before | {"version": before["version"] + 1, "notes": before["notes"] | notes})

    def expire(self, slices: Iterable[str]) -> int:
        """A version without some slices; no row is read."""
        before, gone = self.manifest(), set(slices)
        return self._commit(before | {"version": before["version"] + 1, "slices": {s: f for s, f in before["slices"].items() if s not in gone}})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what only versions before the last ``keep`` hold, and what writers that died have left. Not to be run beside a writer. The number of folders that went."""
        known = self.versions()
        stay = {f for v in known[-keep:] for f in self.manifest(v)["slices"].values()}
        gone = 0
        for name in self._names("data"):
            for part in self._names(f"data/{name}"):
                if part.startswith(f"{_SLICE}=") and f"data/{name}/{part}" not in stay:
                    fs, path = self._file(f"data/{name}/{part}")
                    gone += fs.delete(path, True)
        for v in known[:-keep]:
            fs, path = self._file(f"log/{v:012d}.json")
            fs.delete(path, False)
        return gone


class KeyedTable(VersionedTable):
    """A table with one row for each key, dealt to buckets by a hash of the key: an upsert reads and rewrites the buckets of the keys that it brings."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        super().__init__(spark, path)
        self.keys = keys
        self.buckets = self.manifest()["notes"].get("buckets", buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")

    def upsert(self, changes: DataFrame, merge: Callable[[str], Column] | None = None, batch: int | None = None, notes: dict | None = None) -> int | None:
        """Brings in one row for each changed key (null is a key like any other); the version made, or None if there was nothing to do.

        merge: for each other column its new value, from the columns ``old.<c>`` and ``new.<c>`` of a key that is there already; the new one by default.
        batch: the number of a stream's batch. One that is in the table already changes nothing, so a stream that starts again may repeat its last batch.
        notes: what the new version's notes shall hold besides.
        """
        before = self.manifest()
        if batch is not None and before["notes"].get("batch", -1) >= batch:
            return None
        touched = [r[0] for r in changes.select(self.bucket()).distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return None
        values = [c for c in changes.columns if c not in self.keys]
        rows = changes
        if before["slices"]:
            packed = lambda df, name: df.select(*[F.col(k).alias(f"__{name}_{k}") for k in self.keys], F.struct(*values, F.lit(True).alias("__there")).alias(name))
            same = [F.col(f"__new_{k}").eqNullSafe(F.col(f"__old_{k}")) for k in self.keys]
            both = packed(changes, "new").join(packed(self._rows(before, touched), "old"), same, "full")
            both = both.withColumns({k: F.coalesce(f"__new_{k}", f"__old_{k}") for k in self.keys})
            merged = {c: merge(c) if merge else F.col(f"new.{c}") for c in values}
            pick = lambda c: F.when(F.col("new.__there").isNull(), F.col(f"old.{c}")).when(F.col("old.__there").isNull(), F.col(f"new.{c}")).otherwise(merged[c])
            rows = both.select(*self.keys, *[pick(c).cast(changes.schema[c].dataType).alias(c) for c in values])
        return self.replace(rows, self.bucket(), touched, {"buckets": self.buckets} | ({"batch": batch} if batch is not None else {}) | (notes or {}), before)
