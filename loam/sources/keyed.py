"""Tables kept by key: rows in hash buckets, and a manifest that names each bucket's files.

A run writes new files for the buckets that its rows fall into, and nothing else; then the next manifest appears, by a rename
that fails where it is there already. So a reader sees a table before or after a run, never in between, a run that fails leaves
files that no manifest names, and a run that another one overtook starts again from the newer table. A run has a name; one that
a manifest says has been applied does nothing when it is replayed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of applied runs that a manifest remembers, the newest; a stream replays its last batch only.
REMEMBERED = 1000


class KeyedTable:
    """A table of at most one row for each key, under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: T.StructType | str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        jvm = spark._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """version, files by bucket, and the names of the last runs."""
        found = self._listed(f"{self.path}/manifests")
        versions = [int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith((".", "_"))]
        if not versions:
            return {"version": 0, "files": {}, "runs": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{max(versions):010d}.json", wholetext=True).first()[0])

    def read(self, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows now, or of a manifest; of some buckets only their files are opened."""
        files = (manifest or self.manifest())["files"]
        names = [f"{self.path}/{n}" for b, held in files.items() if buckets is None or int(b) in buckets for n in held]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def upsert(self, changes: DataFrame, run: str | None = None) -> dict:
        """Put in changes by key, one row for each key; null keys are keys like others. The manifest after it."""
        return self._apply(changes, run, lambda now, new: now.join(new.select(*[F.col(k).alias(f"_{k}") for k in self.key]), self._same(), "left_anti").unionByName(new))

    def insert_new(self, changes: DataFrame, run: str | None = None) -> dict:
        """Put in changes whose keys are not there; what is there stays, and is not written again: new files stand beside the old
        ones. The changes are written once; they are moved again only where some of their keys are there."""
        run = run or uuid.uuid4().hex
        if run in self.manifest()["runs"]:
            return self.manifest()
        first = folder = f"data/{uuid.uuid4().hex}"
        self._write(changes.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]), first)
        touched = self._touched(first)
        while run not in (before := self.manifest())["runs"]:
            known, folder = self.read(before, touched).select(*[F.col(k).alias(f"_{k}") for k in self.key]), first
            new = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{first}/bucket={b}" for b in touched]) if touched else None
            if new is not None and new.select(*self.key).join(known, self._same(), "left_semi").limit(1).count():
                folder = f"data/{uuid.uuid4().hex}"
                self._write(new.join(known, self._same(), "left_anti"), folder)
            files = dict(before["files"])
            for b, names in self._files(folder, touched).items():
                files[b] = [*files.get(b, []), *names]
            self._commit({"version": before["version"] + 1, "files": files, "runs": [*before["runs"], run][-REMEMBERED:]})
        if folder != first:
            self._fs.delete(self._file(f"{self.path}/{first}"), True)
        return before

    def refresh(self, payload: DataFrame, columns: list[str], run: str | None = None) -> dict:
        """Replace some columns of the rows whose keys are in payload; other rows, columns and buckets stay as they are."""

        def put(now: DataFrame, new: DataFrame) -> DataFrame:
            new = new.select(*[F.col(c).alias(f"_{c}") for c in [*self.key, *columns]], F.lit(True).alias("_there"))
            cell = lambda c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            return now.join(new, self._same(), "left").select(*[cell(c) for c in self.schema.names])

        return self._apply(payload, run, put)

    def reset(self) -> dict:
        """An empty table, as a version after the others."""
        before = self.manifest()
        return self._commit({"version": before["version"] + 1, "files": {}, "runs": []}) or self.reset()

    def vacuum(self, keep: int = 10, older: float = 7 * 24 * 3600) -> int:
        """Delete what only versions before the newest `keep` need, and what failed runs left, where it is older than that many
        seconds (a run that is going on has files that no manifest names yet); the number of folders that went."""
        known = sorted(n for n in self._listed(f"{self.path}/manifests") if n.endswith(".json"))
        used = set()
        for name in known[-keep:]:
            held = json.loads(self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).first()[0])
            used |= {f.split("/")[1] for names in held["files"].values() for f in names}
        for name in known[:-keep]:
            self._fs.delete(self._file(f"{self.path}/manifests/{name}"), False)
        gone = 0
        for top in ("data", "drafts"):
            at = self._file(f"{self.path}/{top}")
            for found in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if found.getPath().getName() not in used and time.time() - found.getModificationTime() / 1000 >= older:
                    gone += self._fs.delete(found.getPath(), True)
        return gone

    def _same(self):
        out = F.lit(True)
        for k in self.key:
            out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return out

    def _apply(self, changes: DataFrame, run: str | None, put: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
        run = run or uuid.uuid4().hex
        if run in self.manifest()["runs"]:
            return self.manifest()
        draft = f"drafts/{uuid.uuid4().hex}"  # written first: what makes the changes runs once, however many tries it takes
        self._write(changes, draft)
        touched = self._touched(draft)
        held = [f"{self.path}/{draft}/bucket={b}" for b in touched]
        new = self.spark.read.schema(changes.schema).parquet(*held) if held else self.spark.createDataFrame([], changes.schema)
        while run not in (before := self.manifest())["runs"]:
            folder = f"data/{uuid.uuid4().hex}"
            rows = put(self.read(before, touched), new).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
            self._write(rows, folder, whole=True)
            files = {b: names for b, names in before["files"].items() if int(b) not in touched} | self._files(folder, touched)
            self._commit({"version": before["version"] + 1, "files": files, "runs": [*before["runs"], run][-REMEMBERED:]})
        self._fs.delete(self._file(f"{self.path}/{draft}"), True)
        return before

    def _write(self, rows: DataFrame, folder: str, whole: bool = False) -> None:
        """rows under folder, by bucket; whole: all of a bucket in one file."""
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        (rows.repartition("bucket") if whole else rows).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _touched(self, folder: str) -> list[int]:
        return sorted(int(n.removeprefix("bucket=")) for n in self._listed(f"{self.path}/{folder}") if n.startswith("bucket="))

    def _files(self, folder: str, buckets: list[int]) -> dict[str, list[str]]:
        """The files of a folder by bucket; buckets without any are left out."""
        held = {str(b): [f"{folder}/bucket={b}/{n}" for n in self._listed(f"{self.path}/{folder}/bucket={b}") if n.endswith(".parquet")] for b in buckets}
        return {b: names for b, names in held.items() if names}

    def _listed(self, folder: str) -> list[str]:
        at = self._file(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commit(self, manifest: dict) -> dict | None:
        """Make that the newest manifest; None where another run was first."""
        jvm = self.spark._jvm
        final, draft = (self._file(f"{self.path}/{n}") for n in (f"manifests/{manifest['version']:010d}.json", f"drafts/{uuid.uuid4().hex}"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, rename)
        except Exception as refused:
            if self._fs.exists(final):
                return None
            raise refused
        return manifest
