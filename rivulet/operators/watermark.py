"""Incremental extraction by a composite cursor (time, key)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rivulet.errors import WatermarkExtractionError
from rivulet.functions.canonical import watermark_batch_id
from rivulet.sources import staging
from rivulet.sources.control import ControlStore

START = (None, None)


def high_watermark(df: DataFrame, stamp: str, key: str) -> DataFrame:
    """One row (stamp, key): the largest pair; nulls for an empty table or one without stamps."""
    top = df.where(F.col(stamp).isNotNull()).agg(F.max(F.struct(stamp, key)).alias("m"))
    return top.select(F.col(f"m.{stamp}").alias(stamp), F.col(f"m.{key}").alias(key))


def in_window(stamp: str, key: str, low: tuple, high: tuple) -> Column:
    """low < (stamp, key) <= high, written out so that scans can use it; a null stamp never lies inside."""
    t, k = F.col(stamp), F.col(key)
    cond = (t < F.lit(high[0])) | ((t == F.lit(high[0])) & (k <= F.lit(high[1])))
    if low[0] is not None:
        cond = ((t > F.lit(low[0])) | ((t == F.lit(low[0])) & (k > F.lit(low[1])))) & cond
    return cond


def bounded_window(df: DataFrame, stamp: str, key: str, low: tuple, high: tuple, ordered: bool = False) -> DataFrame:
    out = df.where(in_window(stamp, key, low, high))
    return out.orderBy(stamp, key) if ordered else out


def read_landed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a landed batch; fails if there is none."""
    if not (own := staging.resolve(spark, path)):
        raise WatermarkExtractionError(f"no landed batch at {path}")
    return spark.read.schema(schema).json(own)


class Tables(dict):
    """DataFrames by name with their keys, by default "id": what an Extractor reads from."""

    def __init__(self, tables: dict[str, DataFrame], keys: dict[str, str] | None = None):
        super().__init__({t: (df, (keys or {}).get(t, "id")) for t, df in tables.items()})


@dataclass
class Extractor:
    """Extracts what lies beyond a table's cursor, lands it as JSON lines and moves the cursor, or repeats a failed run's
    very window. Cursor values are kept as text of the columns cast to string."""

    store: ControlStore
    landing: str
    tables: dict[str, tuple[DataFrame, str]]
    stamp: str = "updated_at"
    ordered: bool = False

    def run(
        self, table: str, post_capture: Callable[[], None] | None = None, fail_before_landing: bool = False, fail_before_commit: bool = False
    ) -> dict:
        run_id = str(uuid.uuid4())
        self.store.begin(run_id, table)
        try:
            return self._run(run_id, table, post_capture, fail_before_landing, fail_before_commit)
        except BaseException as e:
            self.store.end(run_id, "FAILED", problem=str(e))
            raise

    def run_all(self) -> dict[str, dict]:
        return {t: self.run(t) for t in self.tables}

    def _run(self, run_id, table, post_capture, fail_before_landing, fail_before_commit) -> dict:
        if table not in self.tables:
            raise WatermarkExtractionError(f"unknown table {table}")
        df, key = self.tables[table]
        state = self.store.cursor(table, self.stamp, key)
        low = (state["stamp"], state["key"])
        types = dict(df.dtypes)
        if old := self.store.recoverable(table):
            high, batch = (old["to_stamp"], old["to_key"]), old["batch"]
            self.store.supersede(old["id"], run_id)
        else:
            top = high_watermark(df, self.stamp, key).select(*[F.col(c).cast("string") for c in (self.stamp, key)]).first()
            high = (top[0], top[1])
            batch = watermark_batch_id(table, low, high)
        out = {"run_id": run_id, "table": table, "batch_id": batch, "low": low, "high": high, "recovered": bool(old)}
        ahead = high[0] is not None and (low[0] is None or self._beyond(df, types, key, low, high))
        if not ahead:
            self.store.end(run_id, "NO_DATA")
            return out | {"status": "NO_DATA", "rows": 0}
        self.store.set_window(run_id, state["version"], batch, low, high)
        if post_capture:
            post_capture()
        bound = lambda w: (None, None) if w[0] is None else (F.lit(w[0]).cast(types[self.stamp]), F.lit(w[1]).cast(types[key]))
        rows = bounded_window(df, self.stamp, key, bound(low), bound(high), self.ordered)
        if fail_before_landing:
            raise WatermarkExtractionError("stopped before landing")
        path = f"{self.landing}/table={table}/batch_id={batch}"
        seen = Observation()

        def whole(staged: str) -> None:
            if (n := seen.get["n"]) != (landed := read_landed(df.sparkSession, staged, df.schema).count()):
                raise WatermarkExtractionError(f"{landed} of {n} rows have landed in {path}")

        # counted as they are written: the source is read once, and may change meanwhile
        staging.replace(df.sparkSession, path, rows.observe(seen, F.count(F.lit(1)).alias("n")).write.json, whole)
        n = seen.get["n"]
        if not n:
            self.store.end(run_id, "NO_DATA")
            return out | {"status": "NO_DATA", "rows": 0}
        if fail_before_commit:
            raise WatermarkExtractionError("stopped before commit")
        self.store.commit(run_id, table, state["version"], high, n, path)
        return out | {"status": "SUCCESS", "rows": n, "path": path}

    def _beyond(self, df: DataFrame, types: dict[str, str], key: str, low: tuple, high: tuple) -> bool:
        one = df.sparkSession.range(1)
        pair = lambda w: F.struct(F.lit(w[0]).cast(types[self.stamp]).alias("t"), F.lit(w[1]).cast(types[key]).alias("k"))
        return one.select(pair(high) > pair(low)).first()[0]
