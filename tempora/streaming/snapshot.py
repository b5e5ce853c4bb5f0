"""Versioned Parquet snapshots behind one manifest.

A manifest names, for every year, the folders that hold its rows: a base and the deltas after it.
A commit writes data folders first and then renames a new manifest into place; the rename fails
if another writer has made that version, and the commit is tried again on the newer manifest.
Data that no manifest names does not exist for readers, so a half-written batch has no effect,
and the manifest remembers each source's last batch, so a repeated one changes nothing.

A batch adds only its own rows; no stored year is read or rewritten for it. Readers pick the
newest row of a key in years that have deltas and read the others as they are. ``compact`` turns
years with many deltas into one base, ``expire`` deletes what kept manifests do not name.
"""

from __future__ import annotations

import json
import time as clock
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS, DATA = "_manifests", "data"
VERSION = "_version"
EMPTY = {"version": 0, "schema": None, "years": {}, "batches": {}}


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


class Manifests:
    """Numbered JSON manifests of a folder, of which the newest counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def fs(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self, *parts: str) -> list:
        fs, at = self.fs(), self.path(*parts)
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, *parts: str) -> None:
        self.fs().delete(self.path(*parts), True)

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self.entries(MANIFESTS)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version still kept; this is the only one opened."""
        have = self.versions()
        if not have and version is None:
            return {"version": 0}
        v = have[-1] if version is None else version
        stream = self.fs().open(self.path(MANIFESTS, f"v{v:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Rename a manifest into place; :class:`Conflict` if its version is there."""
        jvm = self.spark._jvm
        draft = self.path(MANIFESTS, f".{uuid.uuid4().hex}")
        out = self.fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        final = self.path(MANIFESTS, f"v{manifest['version']:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), no_overwrite)
        except Exception as e:
            self.fs().delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} exists") from e
            raise

    def commit(self, change: Callable[[dict], dict | None]) -> int:
        """Apply ``change`` to the newest manifest and publish it; tried again if another writer was first."""
        while True:
            old = self.read()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old["version"]
            new["version"] = old["version"] + 1
            try:
                self.publish(new)
                return new["version"]
            except Conflict:
                continue


class Snapshot:
    """Newest row per key of a table with a date column, kept by year.

    The newest row of a key has the largest ``order`` columns; equal ones are decided by the later
    commit. Without ``order`` the later commit wins. Rows before ``start`` are left out. Rows
    without a date are kept under year -1.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], time: str, order: tuple[str, ...] = (), start: str | None = None):
        self.spark, self.keys, self.time, self.order, self.start = spark, list(keys), time, tuple(order), start
        self.manifests = Manifests(spark, folder)
        self.folder = self.manifests.folder

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Snapshot:
        """An existing snapshot with the keys and order it was made with."""
        m = cls(spark, folder, [], "").manifest()
        if m["schema"] is None:
            raise FileNotFoundError(folder)
        return cls(spark, folder, m["keys"], m["time"], tuple(m["order"]), m["start"])

    def manifest(self, version: int | None = None) -> dict:
        return EMPTY | self.manifests.read(version)

    def versions(self) -> list[int]:
        return self.manifests.versions()

    # rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        row = F.struct(*rest)
        rank = F.struct(*self.order, *([VERSION] if VERSION in rest else []), row)
        return rows.groupBy(*self.keys).agg(F.max_by(row, rank).alias("_row")).select(*self.keys, "_row.*").select(*rows.columns)

    def _write(self, rows: DataFrame, name: str) -> tuple[str, list[str]]:
        """Rows by year under a fresh folder; its name and its years."""
        at = f"{DATA}/{name}-{uuid.uuid4().hex}"
        year = F.coalesce(F.year(self.time), F.lit(-1))
        rows.withColumn("year", year).write.partitionBy("year").parquet(f"{self.folder}/{at}")
        return at, [n.partition("=")[2] for n in (f.getPath().getName() for f in self.manifests.entries(at)) if n.startswith("year=")]

    def append(self, batch: DataFrame, batch_id: int, source: str = "batch") -> int:
        """Commit the newest rows of a batch; a batch of this source that is not newer than its last one is skipped."""
        base = self.manifest()
        if base["batches"].get(source, -1) >= batch_id:
            return base["version"]
        rows = batch if self.start is None else batch.filter(F.col(self.time) >= F.lit(self.start).cast("date"))
        schema = json.loads(rows.schema.json())
        if base["schema"] is not None and T.StructType.fromJson(base["schema"]) != _nullable(rows.schema):
            raise ValueError("the batch has other columns than the snapshot")
        # the stamp only ranks commits; a retry after a conflict still ranks after what it was based on
        at, years = self._write(self._newest(rows).withColumn(VERSION, F.lit(base["version"] + 1).cast("long")), f"{source}-{batch_id}")

        def change(m: dict) -> dict | None:
            m = json.loads(json.dumps(EMPTY)) | m
            if m["batches"].get(source, -1) >= batch_id:
                return None
            m |= {"schema": json.loads(_nullable(T.StructType.fromJson(schema)).json()), "keys": self.keys, "time": self.time,
                  "order": list(self.order), "start": self.start}
            for y in years:
                m["years"].setdefault(y, []).append(at)
            m["batches"][source] = batch_id
            return m

        return self.manifests.commit(change)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of the newest version, or of one still kept."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(self.folder)
        return self._years(m["years"], T.StructType.fromJson(m["schema"])).drop(VERSION)

    def _years(self, years: dict[str, list[str]], schema: T.StructType) -> DataFrame:
        stored = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])

        def of(several: bool) -> DataFrame:
            paths = [f"{self.folder}/{at}/year={y}" for y, ats in sorted(years.items()) for at in ats if (len(ats) > 1) == several]
            if not paths:
                return self.spark.createDataFrame([], stored)
            return self.spark.read.schema(stored).parquet(*paths)

        if not any(len(ats) > 1 for ats in years.values()):
            return of(False)
        merged = self._newest(of(True))
        return merged.unionByName(of(False)) if any(len(ats) == 1 for ats in years.values()) else merged

    # upkeep

    def compact(self, most_deltas: int = 8) -> int:
        """Rewrite years of more than ``most_deltas`` folders as one; years that change meanwhile keep their new deltas."""
        m = self.manifest()
        long_ = {y: ats for y, ats in m["years"].items() if len(ats) > most_deltas}
        if not long_:
            return m["version"]
        at, _ = self._write(self._years(long_, T.StructType.fromJson(m["schema"])), "base")

        def change(now: dict) -> dict | None:
            for y, ats in long_.items():
                if now["years"].get(y, [])[: len(ats)] != ats:
                    return None  # compacted by another writer
                now["years"][y] = [at, *now["years"][y][len(ats) :]]
            return now

        return self.manifests.commit(change)

    def expire(self, keep: int = 3, older_than_s: float = 3600.0) -> list[str]:
        """Delete all but the last ``keep`` manifests, and data folders that these do not name and that nothing has written to lately."""
        have = self.versions()
        for v in have[:-keep]:
            self.manifests.delete(MANIFESTS, f"v{v:012d}.json")
        named = {at for v in have[-keep:] for ats in self.manifest(v)["years"].values() for at in ats}
        gone, now = [], clock.time()
        for f in self.manifests.entries(DATA):
            name = f"{DATA}/{f.getPath().getName()}"
            if name not in named and now - f.getModificationTime() / 1000 >= older_than_s:
                self.manifests.delete(name)
                gone.append(name)
        return gone


def _nullable(schema: T.StructType) -> T.StructType:
    """Columns as a file gives them back."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
