"""Exact dedup by content-defined chunk recipes; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, join_hot, table

#: A chunk has more than LEAST bytes, but for a text's last one, and MOST at most.
LEAST, MOST = 512, 4096


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """Of UTF-8 in hexadecimal, two digits a byte: a chunk ends, after least bytes or more, with the first three characters
    whose last bytes are 0, 1 and 2 modulo 4. So about one character in 64 ends a chunk, whatever the script, and what
    stands before the chunk has no part in it."""
    last = "".join(f"(?:[0-7]{c}|[C-F].(?:[89AB].){{0,2}}[89AB]{c})(?![89AB])" for c in ("[048C]", "[159D]", "[26AE]"))
    return f"(?:..){{{least},{most - 12}}}?{last}|(?:..){{1,{most}}}"


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A table of (doc_id, text_sha256, chunks): the identifier and the SHA-256 of each chunk that the content-defined
    rule cuts, in order. Texts are read once and stay where they are read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.regexp_extract_all(F.hex(text), F.lit(chunk_pattern(least, most)), F.lit(0))
    chunk = F.transform(cut, lambda c: F.struct(identify(c).cast("string").alias("id"), F.unhex(F.sha2(c, 256)).alias("sha")))
    return table(docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), chunk.alias("chunks")))


def collisions(cut: DataFrame) -> DataFrame:
    """Identifiers that chunks of different SHA-256 share. A chunk counts once in the task that read it."""
    once = cut.select(F.explode("chunks").alias("c")).groupBy("c.id", "c.sha").agg(F.count(F.lit(1)).alias("copies"))
    return table(once.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))


def verified(cut: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe) of recipes(): recipe has the verified identifiers of the text's chunks in order.

    An identifier is verified if all chunks that have it have one SHA-256; any other is followed by the chunk's SHA-256.
    So equal recipes are of equal chunks.
    """
    shared = collisions(cut)
    if shared.isEmpty():
        return cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: c["id"]).alias("recipe"))
    # the set of colliding identifiers is joined, never collected
    rows = table(cut.withColumn("_row", F.monotonically_increasing_id()))
    hit = (
        rows.select("_row", F.explode("chunks").alias("c")).select("_row", "c.id")
        .join(shared, "id", "left_semi").groupBy("_row").agg(F.collect_set("id").alias("_bad"))
    )
    bad = F.coalesce("_bad", F.array().cast("array<string>"))
    spell = F.transform("chunks", lambda c: F.when(F.array_contains(bad, c["id"]), F.concat_ws(":", c["id"], F.hex(c["sha"]))).otherwise(c["id"]))
    return rows.join(hit, "_row", "left").select("doc_id", "text_sha256", spell.alias("recipe"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Groups documents with identical texts; of each group the row with the largest key stays.

    Returns key, keep_id, group_size, kept, text_sha256, one row per input row. A null text counts as empty, and all
    empty texts are one group. Of rows that share key and text, each is returned, and kept holds for all of them.
    A null key is kept only if its group has no other. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Texts of any length are cut and compared whole. A group of any size is dealt by key.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    ids = verified(recipes(slim, identify=identify)).select("doc_id", "text_sha256", F.sha2(F.array_join("recipe", ","), 256).alias("recipe"))
    groups = ids.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = table(groups.where("group_size > 1"))
    out = join_hot(ids, several, "recipe", "group_size", slim.count(), "doc_id")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("doc_id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def keep_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text a row with a larger key has; all columns as they were, whatever their names.

    Of rows that share key and text all stay; a row without a key stays if no other has its text. Only the keys and SHA-256
    of the rows that go are joined.
    """
    k, sha = free(docs, "gone_key", "gone_sha")
    gone = exact_dedup(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).where("NOT kept")
    gone = gone.select(F.col("doc_id").alias(k), F.col("text_sha256").alias(sha))
    same = F.col(key).eqNullSafe(F.col(k)) & (F.sha2(F.coalesce(F.col(text), F.lit("")), 256) == F.col(sha))
    return docs.join(gone.distinct(), same, "left_anti")
