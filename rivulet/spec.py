"""Declarative descriptions of tables and change flows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """A table's columns with their SQL types, in order, and its key."""

    name: str
    key: str
    columns: dict[str, str]

    @property
    def ddl(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self.columns.items())


#: Columns that a merged target has besides its own.
LINEAGE = {
    "_last_sequence_number": "bigint", "_last_event_id": "string", "_last_operation": "string", "_last_event_fingerprint": "string",
    "_last_source_commit_timestamp": "string", "_last_processing_id": "string", "_is_deleted": "boolean", "_deleted_at": "string",
}

_STAMPS = {"created_at": "timestamp", "updated_at": "timestamp"}

#: The subscription-billing domain.
DOMAIN = {
    t.name: t
    for t in (
        TableSpec("accounts", "account_id", {"account_id": "string", "account_name": "string", "industry": "string", "country": "string", "status": "string", **_STAMPS}),
        TableSpec(
            "subscriptions", "subscription_id",
            {"subscription_id": "string", "account_id": "string", "plan_name": "string", "billing_cycle": "string", "monthly_amount": "decimal(10,2)",
             "status": "string", "start_date": "date", "end_date": "date", **_STAMPS},
        ),
        TableSpec(
            "invoices", "invoice_id",
            {"invoice_id": "string", "subscription_id": "string", "invoice_date": "date", "due_date": "date", "invoice_amount": "decimal(10,2)", "invoice_status": "string", **_STAMPS},
        ),
        TableSpec(
            "payments", "payment_id",
            {"payment_id": "string", "invoice_id": "string", "payment_date": "date", "payment_amount": "decimal(10,2)", "payment_method": "string", "payment_status": "string", **_STAMPS},
        ),
    )
}


@dataclass(frozen=True)
class FlowSpec:
    """A declarative change flow: keys, order, deletes, columns left out, history columns, null handling. A flow that runs
    once fills its target before the others."""

    target: str
    keys: tuple[str, ...]
    sequence_by: str = "sequence_number"
    delete_when: str = "operation = 'DELETE'"
    except_columns: tuple[str, ...] = ("operation", "sequence_number")
    scd_type: int = 1
    track_history: tuple[str, ...] = ()
    ignore_null_updates: bool = False
    once: bool = False
    tombstone_retention_seconds: int = 604_800
    properties: dict[str, str] = field(default_factory=dict)
    name: str = ""
    source: str = ""


def typed(value: Column, kind: str) -> Column:
    return value.try_cast(kind)


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df's columns of the spec, cast to its types; what can't be cast is null."""
    return df.select(*[typed(F.col(c), t).alias(c) for c, t in spec.columns.items()])


def project_events(events: DataFrame, spec: TableSpec, key_fallback: bool = True) -> DataFrame:
    """Typed columns from JSON images, each parsed once: the key from payload, before image or business key; the others
    from the payload, else the before image and key if key_fallback, else null. Adds the change columns of the event."""
    image = "struct<" + ", ".join(f"`{c}`: string" for c in spec.columns) + ">"
    own = events.where(F.col("table_name") == spec.name).withColumns(
        {"_after": F.from_json("payload_json", image), "_before": F.from_json("before_payload_json", image)}
    )

    def at(name: str, kind: str) -> Column:
        after, before, key = F.col(f"_after.{name}"), F.col(f"_before.{name}"), F.element_at("business_key", name)
        if name == spec.key:
            value = F.coalesce(after, before, key)
        elif key_fallback:
            value = F.coalesce(F.when(F.col("payload_json").isNotNull(), after).otherwise(before), key)
        else:
            value = after
        return typed(value, kind).alias(name)

    keep = ["operation", "sequence_number", "event_id", "event_fingerprint", "source_commit_timestamp"]
    return own.select(*[at(c, t) for c, t in spec.columns.items()], *keep)
