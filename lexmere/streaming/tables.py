"""Tables that micro-batches write to, made of Parquet folders: an append-only one, and one of buckets with a manifest for each version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmere.session import exists


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the runs that go on from a checkpoint. It is kept in its folder, so a checkpoint that was lost begins a run of another name, whose batch 0 is no other run's."""
    old = [n for n in _names(spark, checkpoint) if n.startswith("run-")]
    if old:
        return old[0][4:]
    name = uuid.uuid4().hex
    fs, at = _fs(spark, f"{checkpoint}/run-{name}")
    fs.create(at, False).close()
    return name


class Appended:
    """An append-only table of rows with distinct keys: one folder for each batch of each run, holding only what that batch brought."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def read(self, without: str = "") -> DataFrame:
        """All whole batches, but for one."""
        done = [f"{self.path}/{n}" for n in _names(self.spark, self.path) if n != without and exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return self.spark.read.schema(self.schema).parquet(*done) if done else self.spark.createDataFrame([], self.schema)

    def add(self, batch: DataFrame, run: str, number: int) -> None:
        """Rows whose key no other batch has; of equal keys in the batch one. Null keys are rows of their own. A batch that runs again overwrites its own folder and leaves the rest."""
        name = f"{run}-{number}"
        keyed = batch.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        # of earlier batches only the key column is read
        new = keyed.join(self.read(name).select(self.key), self.key, "left_anti").select(*self.schema.names)
        new.unionByName(batch.where(F.col(self.key).isNull()).select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/{name}")


class Bucketed:
    """A table in buckets by a hash of one column. A batch rewrites the buckets it touches; a manifest names each bucket's folder, and is written last.

    manifest/{version}.json holds the buckets' folders and, for each run, the
    last batch that is in this version: a batch that runs again is skipped. A
    job that dies before its manifest leaves folders that nothing names, which
    the next `expire` removes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, by: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.by, self.buckets = spark, path, schema, by, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in _names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": {}, "applied": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{version if version is not None else known[-1]:010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _folders(self, manifest: dict, only: set[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{f}/bucket={b}" for b, f in manifest["buckets"].items() if only is None or int(b) in only]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one that is still there."""
        return self._read(self._folders(self.manifest(version)))

    def apply(self, batch: DataFrame, run: str, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Make the next version: merge(old rows of the touched buckets, batch) takes their place. Returns the touched buckets.

        merge must keep rows in their bucket, that is, not change the column
        that buckets are made by. Buckets are few, so their numbers come to the driver.
        """
        now = self.manifest()
        if now["applied"].get(run, -1) >= number:
            return set()
        touched = {r.b for r in batch.select(self._bucket().alias("b")).distinct().collect()}
        if touched:
            folder = f"{run}-{number}"
            merged = merge(self._read(self._folders(now, touched)), batch).select(*self.schema.names).withColumn("bucket", self._bucket())
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            full = {n[7:] for n in _names(self.spark, f"{self.path}/data/{folder}") if n.startswith("bucket=")}
            now["buckets"] = {b: f for b, f in now["buckets"].items() if int(b) not in touched} | {b: folder for b in sorted(full)}
        self._write(now | {"version": now["version"] + 1, "applied": now["applied"] | {run: number}})
        return touched

    def _write(self, manifest: dict) -> None:
        fs, at = _fs(self.spark, f"{self.path}/manifest/{manifest['version']:010d}.json")
        _, temporary = _fs(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(temporary, at):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another job")

    def expire(self, keep: int = 2) -> None:
        """Remove versions but for the last `keep`, and folders that none of those names. Not while a batch is being applied."""
        known = self.versions()
        kept = {f for v in known[-keep:] for f in self.manifest(v)["buckets"].values()}
        for v in known[:-keep]:
            fs, at = _fs(self.spark, f"{self.path}/manifest/{v:010d}.json")
            fs.delete(at, False)
        for n in _names(self.spark, f"{self.path}/data"):
            if n not in kept:
                fs, at = _fs(self.spark, f"{self.path}/data/{n}")
                fs.delete(at, True)
