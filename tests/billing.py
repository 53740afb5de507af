"""The billing domain's test data: a snapshot of any size by expressions, and the change scenario."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.spec import DOMAIN, conform

# What the columns may hold; a value that stands several times is as much more frequent.
INDUSTRIES = "Fintech Healthcare E-commerce SaaS Cybersecurity Logistics Edtech Manufacturing".split()
COUNTRIES = "US CA GB DE FR AU SG IN JP BR".split()
ACCOUNT_STATUSES = "ACTIVE ACTIVE ACTIVE ACTIVE TRIAL SUSPENDED".split()
PLANS = {"STARTER": "49.00", "GROWTH": "199.00", "SCALE": "499.00", "ENTERPRISE": "1299.00"}
CYCLES = "MONTHLY MONTHLY MONTHLY ANNUAL".split()
SUBSCRIPTION_STATUSES = "ACTIVE ACTIVE ACTIVE PAUSED CANCELLED".split()
INVOICE_STATUSES = "PAID PAID PAID ISSUED OVERDUE".split()
METHODS = "CREDIT_CARD CREDIT_CARD ACH WIRE_TRANSFER".split()
PAYMENT_STATUSES = "SUCCESS SUCCESS SUCCESS FAILED".split()
SIZES = {"accounts": 40, "subscriptions": 60, "invoices": 120, "payments": 90}
PREFIX = {"accounts": "ACC", "subscriptions": "SUB", "invoices": "INV", "payments": "PAY"}


@dataclass(frozen=True)
class Snapshot:
    """Rows that depend on seed and number alone, in any number of tasks; children belong to parents in turn."""

    spark: SparkSession
    sizes: dict[str, int] | None = None
    seed: int = 42

    def _n(self, table: str) -> int:
        return (self.sizes or SIZES)[table]

    def _pick(self, values: list[str], what: str, i: Column) -> Column:
        k = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(what), i), F.lit(len(values))).cast("int")
        return F.get(F.array(*[F.lit(v) for v in values]), k)

    def _key(self, table: str, i: Column) -> Column:
        return F.format_string(f"{PREFIX[table]}-%04d", i)

    def _parent(self, table: str) -> Column:
        return F.pmod(F.col("id") - 1, F.lit(self._n(table))) + 1

    def _day(self, i: Column, first: str = "2026-01-01") -> Column:
        return F.date_add(F.lit(first).cast("date"), F.pmod(i, F.lit(90)).cast("int"))

    def _rows(self, table: str, columns: dict[str, Column]) -> DataFrame:
        stamp = self._day(F.col("id")).cast("timestamp")
        own = {**columns, "created_at": stamp, "updated_at": stamp}
        return conform(self.spark.range(1, self._n(table) + 1).select(*[c.alias(n) for n, c in own.items()]), DOMAIN[table])

    def accounts(self) -> DataFrame:
        i = F.col("id")
        return self._rows("accounts", {
            "account_id": self._key("accounts", i), "account_name": F.format_string("Company %04d", i), "industry": self._pick(INDUSTRIES, "industry", i),
            "country": self._pick(COUNTRIES, "country", i), "status": self._pick(ACCOUNT_STATUSES, "account", i),
        })

    def _plan(self, i: Column) -> Column:
        return self._pick(list(PLANS), "plan", i)

    def _price(self, i: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for p in PLANS.items() for x in p]), self._plan(i)).cast("decimal(10,2)")

    def _cycle(self, i: Column) -> Column:
        return self._pick(CYCLES, "cycle", i)

    def subscriptions(self) -> DataFrame:
        i = F.col("id")
        status = self._pick(SUBSCRIPTION_STATUSES, "subscription", i)
        return self._rows("subscriptions", {
            "subscription_id": self._key("subscriptions", i), "account_id": self._key("accounts", self._parent("accounts")), "plan_name": self._plan(i),
            "billing_cycle": self._cycle(i), "monthly_amount": self._price(i), "status": status, "start_date": self._day(i),
            "end_date": F.when(status == "CANCELLED", F.date_add(self._day(i), 30)),
        })

    def _invoiced(self, i: Column) -> Column:
        """An invoice's amount, by the number of its subscription: a year's for an annual cycle."""
        return (self._price(i) * F.when(self._cycle(i) == "ANNUAL", 12).otherwise(1)).cast("decimal(10,2)")

    def invoices(self) -> DataFrame:
        i, of = F.col("id"), self._parent("subscriptions")
        return self._rows("invoices", {
            "invoice_id": self._key("invoices", i), "subscription_id": self._key("subscriptions", of), "invoice_date": self._day(i),
            "due_date": F.date_add(self._day(i), 30), "invoice_amount": self._invoiced(of), "invoice_status": self._pick(INVOICE_STATUSES, "invoice", i),
        })

    def payments(self) -> DataFrame:
        i, of = F.col("id"), self._parent("invoices")
        paid = self._pick(INVOICE_STATUSES, "invoice", of) == "PAID"
        return self._rows("payments", {
            "payment_id": self._key("payments", i), "invoice_id": self._key("invoices", of), "payment_date": F.date_add(self._day(of), 10),
            "payment_amount": self._invoiced(F.pmod(of - 1, F.lit(self._n("subscriptions"))) + 1), "payment_method": self._pick(METHODS, "method", i),
            "payment_status": F.when(paid, "SUCCESS").otherwise(self._pick(PAYMENT_STATUSES, "payment", i)),
        })

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t)() for t in DOMAIN}

    def dicts(self) -> dict[str, list[dict]]:
        """The rows as JSON has them: for snapshots of test size."""
        return {t: [json.loads(x[0]) for x in as_json(df).orderBy("value").collect()] for t, df in self.tables().items()}

    def write(self, base: str, files: int = 1) -> None:
        """Parquet under <table>/snapshot.parquet."""
        for t, df in self.tables().items():
            df.coalesce(files).write.mode("overwrite").parquet(f"{base}/{t}/snapshot.parquet")


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text: stamps and dates in ISO form, decimals as text of two places, nulls written out."""
    as_text = {"timestamp": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "date": lambda c: F.date_format(c, "yyyy-MM-dd")}
    cols = [as_text.get(k, lambda c: F.col(c).cast("string"))(c).alias(c) for c, k in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


STAMP = "2026-05-11T00:00:00Z"


def _event(event_id: str, table: str, op: str, key: str, seq: int | None, image: dict | None, before: dict | None, batch: str, **more) -> dict:
    own = {
        "event_id": event_id, "table_name": table, "operation": op, "business_key": {DOMAIN[table].key: key} if table in DOMAIN else {}, "sequence_number": seq,
        "event_timestamp": STAMP, "source_commit_timestamp": STAMP, "batch_id": batch, "source_system": "b2b_saas_postgres", "payload": image, "before_payload": before,
    }
    return own | more


def scenario(rows: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """Three batches of events on a snapshot's dicts: inserts and updates; a delete, a copy, numbers out of order and a late
    event; seven that no rule lets pass."""
    by = {t: {r[DOMAIN[t].key]: r for r in own} for t, own in rows.items()}
    at = lambda t, n: f"{PREFIX[t]}-{n:04d}"

    def insert(t: str, n: int) -> dict:
        key = at(t, n)
        return _event(f"evt_ins_{PREFIX[t].lower()}_{n:04d}", t, "INSERT", key, 1, by[t][at(t, 1)] | {DOMAIN[t].key: key}, None, "batch_001")

    def update(t: str, n: int, seq: int, batch: str, **more) -> dict:
        old = by[t][at(t, n)]
        return _event(f"evt_upd_{PREFIX[t].lower()}_{n:04d}_{seq}", t, "UPDATE", at(t, n), seq, old | more, old, batch)

    first = [insert(t, SIZES[t] + 1) for t in DOMAIN] + [
        update("accounts", 1, 10, "batch_001", status="SUSPENDED"), update("subscriptions", 1, 15, "batch_001", plan_name="ENTERPRISE", monthly_amount="1299.00"),
        update("invoices", 1, 20, "batch_001", invoice_status="OVERDUE"), update("payments", 1, 25, "batch_001", payment_status="FAILED"),
    ]
    paid = by["payments"][at("payments", 2)]
    second = [
        _event("evt_del_pay_0002", "payments", "DELETE", at("payments", 2), 30, None, paid, "batch_002"),
        first[0] | {"batch_id": "batch_002"},
        update("accounts", 2, 102, "batch_002", status="TRIAL"), update("accounts", 2, 101, "batch_002", status="ACTIVE"),
        update("subscriptions", 2, 5, "batch_002", status="PAUSED"),
    ]
    image, b = by["accounts"][at("accounts", 3)], "batch_003_quarantine"
    bad = lambda n, **more: _event(f"evt_bad_{n}", "accounts", "INSERT", at("accounts", 3), 1, image, None, b) | more
    third = [
        bad(1, business_key={}), bad(2, operation="TRUNCATE"), bad(3, payload=None), bad(4, sequence_number=-5), bad(5, sequence_number=None), bad(6, table_name=""),
        bad(7, operation="DELETE", payload=None),
    ]
    return {"batch_001": first, "batch_002": second, b: third}


def write_scenario(spark: SparkSession, batches: dict[str, list[dict]], base: str) -> None:
    """JSON lines under batch_id= and table= folders."""
    rows = [(b, e["table_name"] or "none", json.dumps(e)) for b, events in batches.items() for e in events]
    df = spark.createDataFrame(rows, "batch_id string, `table` string, value string")
    df.coalesce(1).write.mode("overwrite").partitionBy("batch_id", "table").text(base)
