"""Versioned tables: Parquet data by key bucket, a JSON log entry for each commit, change rows once enabled."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rivulet.errors import CDFInvalidRangeError, CDFNotEnabledError, CDFSourceNotFoundError, CommitConflictError, TargetAlreadyInitializedError

CHANGE_COLUMNS = ("_change_type", "_commit_version", "_commit_timestamp")


def no_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """A frame without rows that the optimiser knows to be empty: what is joined with it costs no job, and no Python worker
    is started, as createDataFrame([], schema) does."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).where("false")


@dataclass
class VersionedTable:
    """A table at path, hashed by key into buckets; a replacing commit rewrites the buckets it touches, an
    appending one adds files to them.

    Writers put data first and then create the log entry of the next version, which only one of them can: the others get
    CommitConflictError and leave files that nothing refers to. Paths may be of any file system that Hadoop knows.
    """

    spark: SparkSession
    path: str
    key: str

    # ---- files ----

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _entry(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_log")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0] != ".")

    def exists(self) -> bool:
        return bool(self.versions())

    def version(self) -> int:
        if not (v := self.versions()):
            raise CDFSourceNotFoundError(f"no table at {self.path}")
        return v[-1]

    def log(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        fs, p = self._fs(self._entry(version))
        if not fs.exists(p):
            raise CDFInvalidRangeError(f"{self.path} has no version {version}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, entry: dict) -> int:
        """The entry is written beside the log and then takes its name, which fails if another has it: a crash between
        leaves no entry, and no reader sees half of one."""
        jvm, to = self.spark._jvm, self._entry(entry["version"])
        fs, part = self._fs(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        try:
            stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                # a local rename would replace the entry; a link doesn't
                local = lambda p: jvm.java.io.File(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(fs.makeQualified(p)).toString()).toPath()
                jvm.java.nio.file.Files.createLink(local(self._fs(to)[1]), local(part))
            else:
                kinds = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(part, self._fs(to)[1], kinds)
        except Exception as e:
            raise CommitConflictError(f"version {entry['version']} of {self.path} exists") from e
        finally:
            fs.delete(part, False)
        return entry["version"]

    # ---- reads ----

    def history(self) -> list[dict]:
        """Commits, the newest first."""
        return [{k: e[k] for k in ("version", "timestamp", "operation", "metrics")} for e in map(self.log, reversed(self.versions()))]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        entry = self.log(version)
        wanted = None if buckets is None else set(buckets)
        own = [d for b, dirs in entry["buckets"].items() if wanted is None or int(b) in wanted for d in dirs]
        schema = StructType.fromJson(entry["schema"])
        if not own:
            return no_rows(self.spark, schema)
        return self.spark.read.schema(schema).parquet(*own)

    def empty(self) -> bool:
        """The log says that there are no files: no job is needed to know that there are no rows."""
        return not any(self.log()["buckets"].values())

    def properties(self) -> dict[str, str]:
        return self.log()["properties"]

    @property
    def feed_enabled(self) -> bool:
        return self.exists() and self.properties().get("change_feed") == "true"

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Change rows of versions start to end, both included."""
        last = self.version()
        end = last if end is None else end
        if start < 0 or end < start:
            raise CDFInvalidRangeError(f"bad version range {start} to {end}")
        entries = [self.log(v) for v in self.versions() if start <= v <= end]
        if any(e["properties"].get("change_feed") != "true" for e in entries):
            raise CDFNotEnabledError(f"the change feed of {self.path} was off in versions {start} to {end}")
        kinds: dict[str, list[dict]] = {}
        for e in entries:
            if e["changes"]:
                kinds.setdefault(json.dumps(e["schema"]), []).append(e)
        # one scan for all commits of one schema
        out = no_rows(self.spark, self._change_schema(entries[0] if entries else self.log()))
        for own in kinds.values():
            out = out.unionByName(self.spark.read.schema(self._change_schema(own[0])).parquet(*[e["changes"] for e in own]), allowMissingColumns=True)
        return out

    def _change_schema(self, entry: dict) -> StructType:
        return StructType.fromJson(entry["schema"]).add("_change_type", "string").add("_commit_version", "long").add("_commit_timestamp", "timestamp")

    # ---- writes ----

    def bucket(self, n: int):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(n)).cast("int")

    def _write(self, df: DataFrame, n: int) -> dict[str, list[str]]:
        """Files by bucket. Rows are dealt by bucket, but a bucket's size, not their number, sets the tasks that write it."""
        where = f"{self.path}/data/{uuid.uuid4().hex}"
        df.withColumn("_bucket", self.bucket(n)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(where)
        fs, p = self._fs(where)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {x.split("=")[1]: [f"{where}/{x}"] for x in names if "=" in x}

    def create(self, df: DataFrame, buckets: int = 8, overwrite: bool = False, properties: dict[str, str] | None = None) -> int:
        if self.exists() and not overwrite:
            raise TargetAlreadyInitializedError(f"{self.path} exists")
        version = self.version() + 1 if self.exists() else 0
        props = {"buckets": str(buckets), **(properties or {})}
        return self._commit(self._new(version, "CREATE", props, df.schema, self._write(df, buckets), None, {}))

    def _new(self, version, operation, props, schema, buckets, changes, metrics, stamp=None) -> dict:
        stamp = stamp or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        return {"version": version, "timestamp": stamp, "operation": operation, "properties": props, "schema": json.loads(schema.json()), "buckets": buckets, "changes": changes, "metrics": metrics}

    def set_properties(self, properties: dict[str, str]) -> int:
        old = self.log()
        return self._commit(old | {"version": old["version"] + 1, "operation": "SET PROPERTIES", "properties": old["properties"] | properties, "changes": None, "metrics": {}})

    def enable_feed(self) -> int:
        return self.set_properties({"change_feed": "true"})

    def touched(self, source: DataFrame) -> list[int]:
        """Buckets with keys of source: at most as many as the table has."""
        n = int(self.properties()["buckets"])
        return sorted(r["b"] for r in source.select(self.bucket(n).alias("b")).distinct().collect())

    def replace(self, df: DataFrame, buckets: list[int], operation: str, changes: DataFrame | None = None, metrics: dict | None = None, base: int | None = None) -> int:
        """Commits df as the content of the given buckets; changes are kept if the feed is on. base is the version df was
        made from: another commit since then is a conflict."""
        old = self.log(base)
        n = int(old["properties"]["buckets"])
        now = {b: d for b, d in old["buckets"].items() if int(b) not in set(buckets)} | self._write(df, n)
        return self._changed(old, df.schema, operation, now, changes, metrics)

    def _changed(self, old: dict, schema: StructType, operation: str, buckets: dict, changes: DataFrame | None, metrics: dict | None) -> int:
        version, stamp, where = old["version"] + 1, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), None
        if changes is not None and old["properties"].get("change_feed") == "true":
            where = f"{self.path}/changes/{uuid.uuid4().hex}"
            told = changes.withColumn("_commit_version", F.lit(version).cast("long")).withColumn("_commit_timestamp", F.lit(stamp).cast("timestamp"))
            told.write.parquet(where)
        return self._commit(old | self._new(version, operation, old["properties"], schema, buckets, where, metrics or {}, stamp))

    def stage(self, df: DataFrame, base: int | None = None) -> tuple[dict[str, list[str]], DataFrame]:
        """Writes rows as append() does, without a commit: the files by bucket, which only append() can make part of the
        table, and the rows as they were written, to be read as often as needed."""
        old = self.log(base)
        files = self._write(df, int(old["properties"]["buckets"]))
        own = [d for dirs in files.values() for d in dirs]
        return files, self.spark.read.schema(df.schema).parquet(*own) if own else df.limit(0)

    def append(self, df: DataFrame, operation: str = "APPEND", base: int | None = None, staged: dict[str, list[str]] | None = None) -> int:
        """Adds rows as files of their own, in the buckets of their keys; nothing is read or written again. With base,
        another commit since that version is a conflict. staged: df's files, as stage() has written them."""
        old = self.log(base)
        new = self._write(df, int(old["properties"]["buckets"])) if staged is None else staged
        now = {b: old["buckets"].get(b, []) + new.get(b, []) for b in sorted({*old["buckets"], *new})}
        return self._changed(old, StructType.fromJson(old["schema"]), operation, now, df.withColumn("_change_type", F.lit("insert")), None)

    def rebucket(self, n: int) -> int:
        """Deals all rows to n buckets, as a table needs when its buckets have grown; content, properties and metrics stay."""
        old = self.log()
        props, schema = old["properties"] | {"buckets": str(n)}, StructType.fromJson(old["schema"])
        return self._commit(self._new(old["version"] + 1, "REBUCKET", props, schema, self._write(self.read(old["version"]), n), None, old["metrics"]))

    def compact(self) -> int | None:
        """Writes buckets of several folders as one each; the content stays as it is."""
        old = self.log()
        many = [int(b) for b, dirs in old["buckets"].items() if len(dirs) > 1]
        return self.replace(self.read(old["version"], many), many, "COMPACT", base=old["version"]) if many else None
