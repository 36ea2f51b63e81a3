"""Tables whose versions switch as a whole: a reader sees the rows before a change or behind it, never a mixture.

A table is a folder of immutable parts and one manifest for each version::

    <root>/parts/<bucket>-<unique>/…parquet       rows of one bucket of the key
    <root>/versions/<number>.json                 which part holds each bucket, and what the writer says about it

Rows belong to a bucket by the hash of their key. A change writes new parts for the buckets that it touches and no other,
and then a manifest of the next number, written aside and renamed in one step that fails if the number is taken. A
second writer that started from the same version therefore fails and changes nothing; it may read again and repeat.
Parts of old versions stay readable until ``vacuum``. Nothing but manifests passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32


class ConcurrentWrite(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class VersionedTable:
    """A table with the given key columns under ``root``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        folder = self._at("versions")
        if not self.files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, parts by bucket, notes and properties; the empty table is version 0."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "parts": {}, "properties": {}}
        if version not in known:
            raise ValueError(f"version {version} is not there")
        with_text = self.files.open(self._at("versions", f"{version:012d}.json"))
        try:
            return json.loads(bytes(with_text.readAllBytes()).decode())
        finally:
            with_text.close()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _parts(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/parts/{p}" for p in sorted(parts.values())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; what is written later doesn't change them."""
        return self._parts(self.manifest(version)["parts"])

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame], base: dict | None = None, **properties: object) -> int:
        """Replaces the rows of the buckets that the keys of ``touched`` fall into by ``make`` of them; the new version's number.

        make gets the old rows of these buckets, and what it returns must have their keys in the same buckets; rows of
        others are an error. base: the manifest that the change starts from, by default the newest one.
        """
        base = base or self.manifest()
        numbers = sorted(r[0] for r in touched.select(self.bucket()).distinct().collect())  # at most as many as there are buckets
        own = {str(b): base["parts"][str(b)] for b in numbers if str(b) in base["parts"]}
        run = uuid.uuid4().hex
        rows = make(self._parts(own)).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        dealt = rows.withColumn("_bucket", self.bucket())
        staged = f"{self.root}/parts/{run}"
        dealt.repartition(max(1, min(len(numbers), self.buckets)), "_bucket").write.partitionBy("_bucket").parquet(staged)
        made = {}
        for s in self.files.listStatus(self._at("parts", run)):
            name = s.getPath().getName()
            if name.startswith("_bucket="):
                made[name.removeprefix("_bucket=")] = f"{run}/{name}"
        if strays := sorted(set(made) - {str(b) for b in numbers}):
            raise ValueError(f"rows of buckets {strays}, which the change did not touch")
        kept = {b: p for b, p in base["parts"].items() if b not in own and int(b) not in numbers}
        return self._commit(base, kept | made, properties)

    def _commit(self, base: dict, parts: dict[str, str], properties: dict) -> int:
        number = base["version"] + 1
        text = json.dumps({"version": number, "parts": parts, "properties": base["properties"] | properties})
        aside, target = self._at("versions", f".{uuid.uuid4().hex}.tmp"), self._at("versions", f"{number:012d}.json")
        out = self.files.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, target, plain)
        except Py4JJavaError as e:
            self.files.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception) or self.files.exists(target):
                raise ConcurrentWrite(f"version {number} was made by another writer") from None
            raise
        return number

    def upsert(self, rows: DataFrame, base: dict | None = None, **properties: object) -> int:
        """Rows take the place of those with their key; of several new rows of a key one must be chosen by the caller."""
        return self.change(rows, lambda old: old.join(rows.select(*self.key).distinct(), self.key, "left_anti").unionByName(rows.select(*old.columns)), base, **properties)

    def delete(self, keys: DataFrame, base: dict | None = None, **properties: object) -> tuple[int, int]:
        """Number of the rows that the keys hold, counted before, and the new version; no new version if there are none."""
        base = base or self.manifest()
        keys = keys.select(*self.key).distinct()
        n = self._parts(base["parts"]).join(keys, self.key, "left_semi").count()
        return n, self.change(keys, lambda old: old.join(keys, self.key, "left_anti"), base, **properties) if n else base["version"]

    def replace(self, gone: DataFrame, rows: DataFrame, base: dict | None = None, **properties: object) -> int:
        """Takes out the rows of the keys in gone and puts in rows, in one change."""
        keys = gone.select(*self.key).union(rows.select(*self.key)).distinct()
        return self.change(keys, lambda old: old.join(gone.select(*self.key).distinct(), self.key, "left_anti").unionByName(rows.select(*old.columns)), base, **properties)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the newest ``keep``, and parts that none of these names; the number of parts that went.

        To be run by the table's one caretaker while nothing writes: parts of a change under way are not named yet.
        """
        known = self.versions()
        for v in known[:-keep]:
            self.files.delete(self._at("versions", f"{v:012d}.json"), False)
        used = {p for v in known[-keep:] for p in self.manifest(v)["parts"].values()}
        gone = 0
        for run in self.files.listStatus(self._at("parts")) if known else ():
            name = run.getPath().getName()
            mine = [s.getPath().getName() for s in self.files.listStatus(run.getPath())]
            for part in mine:
                if part.startswith("_bucket=") and f"{name}/{part}" not in used:
                    self.files.delete(self._at("parts", name, part), True)
                    gone += 1
            if not any(u.startswith(f"{name}/") for u in used):
                self.files.delete(run.getPath(), True)
        return gone
