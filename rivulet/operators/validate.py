"""Rules for change events: the first broken one, or all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.spec import DOMAIN, TableSpec

OPERATIONS = ("INSERT", "UPDATE", "DELETE")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def _stamp(c: str) -> Column:
    return F.try_to_timestamp(F.col(c))


def sequence() -> Column:
    """The sequence number as the lenient rules read it: numbers cut to integers, digits in texts, true as 1. Integers of
    any size that a long holds are exact; only numbers with a fraction or an exponent go through a double."""
    raw = F.trim(F.trim(F.col("sequence_json")), F.lit('"'))
    return F.when(F.col("sequence_json") == "true", F.lit(1)).when(F.col("sequence_json") == "false", F.lit(0)).otherwise(
        F.when(F.col("sequence_json").startswith('"'), F.trim(raw).try_cast("long")).otherwise(F.coalesce(raw.try_cast("long"), raw.try_cast("double").try_cast("long")))
    )


def _pk(specs: dict[str, TableSpec]) -> Column:
    return F.element_at(F.create_map(*[x for n, s in specs.items() for x in (F.lit(n), F.lit(s.key))]), F.col("table_name"))


def _image(image: str, specs: dict[str, TableSpec]) -> Column:
    out = F.lit(None).cast("string")
    for n, s in specs.items():
        out = F.when(F.col("table_name") == n, F.get_json_object(image, f"$.{s.key}")).otherwise(out)
    return out


def rules(specs: dict[str, TableSpec] = DOMAIN) -> list[tuple[str, Column, Column]]:
    """(code, broken, reason) of the lenient rules in order."""
    op = F.upper(F.trim("operation"))
    key = F.element_at("business_key", _pk(specs))
    missing = lambda c: F.col(c).isNull()
    mismatch = F.lit(False)
    for image in ("payload_json", "before_payload_json"):
        mismatch = mismatch | (F.col(image).isNotNull() & ~_image(image, specs).eqNullSafe(key))
    say = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    shown = F.coalesce(F.col("operation"), F.lit("null"))
    return [
        ("MISSING_EVENT_ID", _blank("event_id"), F.lit("event_id is missing or blank")),
        ("UNKNOWN_TABLE", ~F.coalesce(F.col("table_name").isin(*specs), F.lit(False)), say("unknown table: ", F.coalesce("table_name", F.lit("null")))),
        ("UNSUPPORTED_OPERATION", ~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), say("unsupported operation: ", shown)),
        ("MISSING_BUSINESS_KEY", F.coalesce(F.col("business_key_json").isin("null", "{}"), F.lit(True)), F.lit("business_key is missing or empty")),
        ("INVALID_BUSINESS_KEY", key.isNull() | (F.trim(key) == ""), F.lit("business_key lacks the table's key")),
        ("MISSING_SEQUENCE", F.coalesce(F.col("sequence_json") == "null", F.lit(True)), F.lit("sequence_number is missing")),
        ("INVALID_SEQUENCE", F.coalesce(sequence() <= 0, F.lit(True)), say("sequence_number is no positive integer: ", F.coalesce("sequence_json", F.lit("null")))),
        ("MISSING_EVENT_TIMESTAMP", _blank("event_timestamp"), F.lit("event_timestamp is missing")),
        ("INVALID_EVENT_TIMESTAMP", _stamp("event_timestamp").isNull(), say("event_timestamp can't be read: ", F.coalesce("event_timestamp", F.lit("null")))),
        ("MISSING_COMMIT_TIMESTAMP", _blank("source_commit_timestamp"), F.lit("source_commit_timestamp is missing")),
        ("INVALID_COMMIT_TIMESTAMP", _stamp("source_commit_timestamp").isNull(), say("source_commit_timestamp can't be read: ", F.coalesce("source_commit_timestamp", F.lit("null")))),
        ("MISSING_SOURCE_SYSTEM", _blank("source_system"), F.lit("source_system is missing")),
        ("MISSING_PAYLOAD", op.isin("INSERT", "UPDATE") & missing("payload_json"), say(shown, " without payload")),
        ("MISSING_BEFORE_IMAGE", op.isin("UPDATE", "DELETE") & missing("before_payload_json"), say(shown, " without before image")),
        ("UNEXPECTED_DELETE_PAYLOAD", (op == "DELETE") & F.col("payload_json").isNotNull(), F.lit("DELETE with payload")),
        ("BUSINESS_KEY_PAYLOAD_MISMATCH", mismatch, F.lit("business_key differs from an image")),
    ]


def validate_first(events: DataFrame, specs: dict[str, TableSpec] = DOMAIN) -> DataFrame:
    """Adds quarantine_code and quarantine_reason of the first broken rule, null for valid events."""
    row = lambda code, why: F.struct(F.lit(code).alias("code"), why.alias("reason"))
    broken = F.when(F.col("malformed"), row("MALFORMED_JSON", F.lit("not a JSON object")))
    for name, rule, why in rules(specs):
        broken = broken.when(rule, row(name, why))
    out = events.withColumn("_broken", broken)
    return out.withColumns({"quarantine_code": F.col("_broken.code"), "quarantine_reason": F.col("_broken.reason")}).drop("_broken")


def validate_all(events: DataFrame, specs: dict[str, TableSpec] = DOMAIN) -> DataFrame:
    """Adds errors, the messages of all broken strict rules, and is_valid. Strict: operations in upper case, the sequence a
    JSON integer, a batch id, and no before image on INSERT; images aren't held against the key."""
    op, seq = F.col("operation"), F.col("sequence_json")
    key = F.element_at("business_key", _pk(specs))
    checks = [
        (_blank("event_id"), "event_id is required"),
        (~F.coalesce(F.col("table_name").isin(*specs), F.lit(False)), "table_name is unknown"),
        (~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), "operation is unsupported"),
        (key.isNull() | (F.trim(key) == ""), "business_key lacks the table's key"),
        (~F.coalesce(seq.rlike(r"^-?\d+$") & (seq.try_cast("long") > 0), F.lit(False)), "sequence_number must be a positive integer"),
        (_stamp("event_timestamp").isNull(), "event_timestamp is invalid"),
        (_stamp("source_commit_timestamp").isNull(), "source_commit_timestamp is invalid"),
        (_blank("batch_id"), "batch_id is required"),
        (_blank("source_system"), "source_system is required"),
        (op.isin("INSERT", "UPDATE") & F.col("payload_json").isNull(), "payload is required"),
        ((op == "INSERT") & F.col("before_payload_json").isNotNull(), "INSERT must not have a before image"),
        (op.isin("UPDATE", "DELETE") & F.col("before_payload_json").isNull(), "before image is required"),
        ((op == "DELETE") & F.col("payload_json").isNotNull(), "DELETE must not have a payload"),
    ]
    out = events.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks])))
    return out.withColumn("is_valid", F.size("errors") == 0)
