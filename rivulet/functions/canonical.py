"""Canonical text and content-derived identities, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_key(key: Column) -> Column:
    """Compact JSON of a map of strings, sorted by name; {} for null."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(key)))), F.lit("{}"))


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted names; empty for null and for text that isn't JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.lit(""))


def entity_key(table: Column, key: Column) -> Column:
    return F.concat_ws(":", table, key)


def digest(*parts: Column, by: str = "|", null: str = "") -> Column:
    """SHA-256 of parts joined; null parts count as the given text."""
    return F.sha2(F.concat_ws(by, *[F.coalesce(p.cast("string"), F.lit(null)) for p in parts]), 256)


def event_fingerprint(event: dict[str, Column] | None = None) -> Column:
    """Identity of an event's content: batch, file and order of arrival take no part."""
    c = {n: F.col(n) for n in ("event_id", "table_name", "operation", "business_key_canonical", "sequence_number", "event_timestamp", "source_commit_timestamp", "payload_json", "before_payload_json", "source_system")} | (event or {})
    parts = [c[n] for n in ("event_id", "table_name", "operation", "business_key_canonical", "sequence_number", "event_timestamp", "source_commit_timestamp")]
    return digest(*parts, canonical_json(c["payload_json"]), canonical_json(c["before_payload_json"]), c["source_system"])


def change_id(table: str | Column, key: str, columns: list[str]) -> Column:
    """Identity of a change row: table, version, kind, key and all other columns by name."""
    name = F.lit(table) if isinstance(table, str) else table
    rest = [F.col(c) for c in sorted(c for c in columns if c not in ("_change_id", "_source_table"))]
    return digest(name, F.col("_commit_version"), F.col("_change_type"), F.col(key), *rest, by="||", null="__NULL__")


def watermark_batch_id(table: str, low: tuple, high: tuple) -> str:
    parts = [table, *["MIN" if x is None else str(x) for x in (*low, *high)]]
    return f"batch_{table}_{hashlib.sha256(':'.join(parts).encode()).hexdigest()[:16]}"


def manifest_digest() -> Column:
    """Of rows (logical_id, content_sha256): an id of the set of files, whatever their order; an aggregate."""
    own = F.concat_ws(":", "logical_id", "content_sha256")
    return F.concat(F.lit("proc_"), F.substring(F.sha2(F.concat_ws("|", F.array_sort(F.collect_set(own))), 256), 1, 16))


def manifest_digest_wide(files: DataFrame) -> DataFrame:
    """One row (id) for rows (logical_id, content_sha256) of any number: an id of their set, whatever the order and however
    often a row comes. Rows meet in 4096 groups by the hash of logical_id, and the groups' digests in one: no task holds
    more than a group. Its ids differ from those of manifest_digest()."""
    own = F.concat_ws(":", "logical_id", "content_sha256")
    groups = files.groupBy(F.substring(F.sha2("logical_id", 256), 1, 3).alias("g")).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_set(own))), 256).alias("d"))
    whole = F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]))
    return groups.agg(F.concat(F.lit("procw_"), F.substring(F.sha2(whole, 256), 1, 16)).alias("id"))
