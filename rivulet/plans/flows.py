"""The declarative pipeline of the billing domain: targets, streaming views and flows by name, its settings, and SQL text."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.merge import ACCEPTED
from rivulet.spec import DOMAIN, FlowSpec, TableSpec, project_events
from rivulet.streaming.auto_cdc import AutoCdc, snapshot_events

#: Columns that say which event a row comes from.
LATEST = {"latest_event_id": "event_id", "latest_event_fingerprint": "event_fingerprint", "latest_source_commit_timestamp": "source_commit_timestamp"}
#: Columns of subscriptions that make a new version.
TRACKED = ("account_id", "plan_name", "billing_cycle", "monthly_amount", "status", "start_date", "end_date")


@dataclass(frozen=True)
class Settings:
    """Where the pipeline reads and writes, and how it treats tombstones and nulls."""

    snapshot: str = ""
    events: str = ""
    target: str = ""
    checkpoints: str = ""
    tombstone_retention_seconds: int = 604_800
    ignore_null_updates: bool = False

    @classmethod
    def of(cls, values: Callable[[str], str | None]) -> Settings:
        found = {}
        for name, default in cls().__dict__.items():
            if (text := values(name)) is not None:
                found[name] = text.strip().lower() == "true" if isinstance(default, bool) else type(default)(text)
        return cls(**found)

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        return cls.of(lambda name: env.get(f"RIVULET_{name.upper()}"))

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Settings:
        """The session's rivulet.* settings, else those of the environment."""
        return cls.of(lambda name: spark.conf.get(f"rivulet.{name}", None) or os.environ.get(f"RIVULET_{name.upper()}"))


def snapshot_view(spark: SparkSession, spec: TableSpec, settings: Settings) -> DataFrame:
    """A table's snapshot files as a stream of events of sequence 0."""
    rows = spark.readStream.schema(spec.ddl).parquet(f"{settings.snapshot}/{spec.name}/*")
    return snapshot_events(rows.withColumns({c: F.lit(None).cast("string") for c in LATEST}))


def events_view(spark: SparkSession, spec: TableSpec, settings: Settings) -> DataFrame:
    """A table's accepted events as a stream of typed rows; only the key falls back to other images."""
    rows = project_events(spark.readStream.schema(ACCEPTED).json(f"{settings.events}/processing_id=*"), spec, key_fallback=False)
    return rows.withColumnsRenamed({old: new for new, old in LATEST.items()})


@dataclass
class Pipeline:
    """What is registered by name, run in the order of registration."""

    settings: Settings
    views: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    targets: dict[str, dict[str, str]] = field(default_factory=dict)
    flows: dict[str, FlowSpec] = field(default_factory=dict)
    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def view(self, name: str, make: Callable[[SparkSession], DataFrame]) -> None:
        if name in self.views:
            raise ValueError(f"view {name} is registered")
        self.views[name] = make

    def target(self, name: str, comment: str, columns: tuple[str, ...]) -> None:
        if name in self.targets:
            raise ValueError(f"target {name} is registered")
        self.targets[name] = {"comment": comment, "tombstone_retention_seconds": str(self.settings.tombstone_retention_seconds)}
        self.columns[name] = columns

    def flow(self, flow: FlowSpec) -> None:
        if flow.name in self.flows or flow.target not in self.targets or flow.source not in self.views:
            raise ValueError(f"flow {flow.name} is registered or lacks its target or source")
        self.flows[flow.name] = replace(flow, properties=self.targets[flow.target] | flow.properties)

    def runner(self, spark: SparkSession, name: str) -> AutoCdc:
        f = self.flows[name]
        return AutoCdc(spark, self.settings.target, f, tuple(c for c in self.columns[f.target] if c not in f.keys))

    def run(self, spark: SparkSession, now: Column | None = None) -> dict[str, int]:
        """Each flow over what is there, hydrations first; then old tombstones go. Returns how many went, by target."""
        order = sorted(self.flows, key=lambda n: not self.flows[n].once)
        for name in order:
            self.runner(spark, name).run(self.views[self.flows[name].source](spark), f"{self.settings.checkpoints}/{name}")
        return {self.flows[n].target: self.runner(spark, n).purge(now) for n in order if not self.flows[n].once}

    def read(self, spark: SparkSession, target: str) -> DataFrame:
        return self.runner(spark, next(n for n, f in self.flows.items() if f.target == target)).result()


def domain_pipeline(settings: Settings) -> Pipeline:
    """Five targets, eight views and ten flows: the current state of each table, and the history of subscriptions."""
    p = Pipeline(settings)
    for t, spec in DOMAIN.items():
        p.view(f"{t}_snapshot_source", lambda spark, spec=spec: snapshot_view(spark, spec, settings))
        p.view(f"{t}_cdc_source", lambda spark, spec=spec: events_view(spark, spec, settings))
        p.target(f"{t}_current", f"current state of {t}", (*spec.columns, *LATEST))
        _flows(p, FlowSpec(f"{t}_current", (spec.key,), ignore_null_updates=settings.ignore_null_updates), t, t)
    spec = DOMAIN["subscriptions"]
    p.target("subscriptions_history", "versions of subscriptions", (*spec.columns, *LATEST))
    _flows(p, FlowSpec("subscriptions_history", (spec.key,), scd_type=2, track_history=TRACKED), "subscriptions", "subscriptions_history")
    return p


def _flows(p: Pipeline, flow: FlowSpec, table: str, prefix: str) -> None:
    flow = replace(flow, tombstone_retention_seconds=p.settings.tombstone_retention_seconds)
    p.flow(replace(flow, name=f"{prefix}_initial_hydration", source=f"{table}_snapshot_source", once=True, delete_when="false"))
    p.flow(replace(flow, name=f"{prefix}_continuous_cdc", source=f"{table}_cdc_source"))


# ---- SQL text ----


def to_sql(f: FlowSpec) -> str:
    """CREATE FLOW text of a flow."""
    lines = [
        f"CREATE FLOW {f.name}", f"AS AUTO CDC{' ONCE' if f.once else ''} INTO {f.target}", f"FROM stream({f.source})", f"KEYS ({', '.join(f.keys)})",
        *(["IGNORE NULL UPDATES"] if f.ignore_null_updates else []), *([f"APPLY AS DELETE WHEN {f.delete_when}"] if f.delete_when != "false" else []),
        f"SEQUENCE BY {f.sequence_by}", f"COLUMNS * EXCEPT ({', '.join(f.except_columns)})", f"STORED AS SCD TYPE {f.scd_type}",
        *([f"TRACK HISTORY ON {', '.join(f.track_history)}"] if f.track_history else []),
    ]
    return "\n".join(lines) + ";"


_CLAUSES = {
    "head": r"CREATE\s+FLOW\s+(?P<name>\w+)\s+AS\s+AUTO\s+CDC(?P<once>\s+ONCE)?\s+INTO\s+(?P<target>\w+)\s+FROM\s+(?:stream\s*\(\s*)?(?P<source>\w+)",
    "keys": r"\bKEYS\s*\(([^)]*)\)", "deletes": r"\bAPPLY\s+AS\s+DELETE\s+WHEN\s+(.+?)(?=\s+(?:SEQUENCE|COLUMNS|STORED)\b|$)", "sequence": r"\bSEQUENCE\s+BY\s+(\w+)",
    "excepts": r"\bEXCEPT\s*\(([^)]*)\)", "kind": r"\bSCD\s+TYPE\s+([12])", "track": r"\bTRACK\s+HISTORY\s+ON\s+\(?([\w\s,]+)\)?",
}


def parse_flows(text: str) -> list[FlowSpec]:
    """The CREATE FLOW statements of a script; other statements and comments are passed over."""
    out = []
    for part in re.sub(r"--[^\n]*", "", text).split(";"):
        own = " ".join(part.split())
        head = re.search(_CLAUSES["head"], own, re.I)
        if not head:
            continue
        found = {k: m[1].strip() for k, p in _CLAUSES.items() if k != "head" and (m := re.search(p, own, re.I))}
        if "keys" not in found or "sequence" not in found:
            raise ValueError(f"flow {head['name']} lacks KEYS or SEQUENCE BY")
        names = lambda k: tuple(x.strip() for x in found.get(k, "").split(",") if x.strip())
        out.append(FlowSpec(
            head["target"], names("keys"), found["sequence"], found.get("deletes", "false"), names("excepts"), int(found.get("kind", 1)), names("track"),
            bool(re.search(r"\bIGNORE\s+NULL\s+UPDATES\b", own, re.I)), bool(head["once"]), name=head["name"], source=head["source"],
        ))
    return out
