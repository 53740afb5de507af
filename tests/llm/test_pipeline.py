"""Every stage of the pipeline against a plain version of it."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import common
from rivulet.llm.tokens import default_path

BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to the old mill by the river"
LEAK = "what is the name of the longest river that flows through all of these old towns"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id int, recipe string, rid int"


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = np.random.default_rng(3), tmp_path_factory.mktemp("tables")
    words = ["river", "stone", "cloud", "green", "walk", "under", "seven", "paper", "night", "wheel", "salt", "north"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " again", f"{texts[2]} {LEAK} {texts[3]}", None, "", "123 !", " \n\t", BASE, "Was ist das für ein Haus am Fluss " * 400]
    rows = [(k, t, "en", "s", len(t or ""), 1, "r", 2) for k, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, LEAK), (None, "no such words at all in here"), (3, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def plain(name, docs):
    """What each filtering stage keeps of (doc_id, text) rows."""
    if name == "language_id":
        return [r for r in docs if any(c.isalpha() for c in r[1] or "")]
    if name == "exact_dedup":
        top = {}
        for k, t in docs:
            top[t or ""] = max(k, top.get(t or "", k))
        return [(k, t) for k, t in docs if top[t or ""] == k]
    if name == "near_dedup":
        sets, least = {k: shingles(t or "") for k, t in docs}, {k: k for k, _ in docs}
        for _ in docs:
            for a in sets:
                for b in sets:
                    both = len(sets[a] & sets[b])
                    if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                        least[a] = least[b] = min(least[a], least[b])
        return [(k, t) for k, t in docs if least[k] == k]
    w = re.findall(r"\w+", LEAK)
    bad = {" ".join(w[i : i + 10]) for i in range(len(w) - 9)}
    return [(k, t) for k, t in docs if not any(x in " ".join(re.findall(r"\w+", (t or "").lower())) for x in bad)]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        got.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(SCHEMA).parquet(f"{folder}/{k}")
        key = lambda r: (r[0], r[1] or "")
        assert sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=key) == sorted(plain(name, own), key=key), name
        none = spark.createDataFrame([], SCHEMA)
        assert stage(spark, none, folder).count() == 0
    out = corpus_pipeline.run(spark, folder).collect()
    check_packed(out, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 4096)


def check_packed(pieces, texts, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    ids = {k: [*t.encode(x or "", add_special_tokens=False).ids, 2] for k, x in texts}
    parts = {}
    for r in pieces:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        parts[r["doc_id"]] = parts.get(r["doc_id"], 0) + r["length"]
    want = {}
    for k, _ in texts:  # a repeated row is packed twice
        want[k] = want.get(k, 0) + len(ids[k])
    assert parts == want
    at = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(at) == list(range(len(at))) and all(n == length for s, n in at.items() if s < len(at) - 1)


def test_tables_are_owned(spark):
    with common.Tables() as own:
        a = common.table(spark.range(3))
    with common.Tables() as other:
        b = common.table(spark.range(4))
    other.release(spark)
    assert a.count() == 3 and own.paths and not other.paths
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(b._rivulet_path)
    common.drop(a)
    assert spark.range(1).count() == 1


def test_join_hot(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 50).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k <> 7")
    got = common.join_hot(left, right, "k", "n", 1000, "id")
    assert got.columns == ["id", "k", "n", "top"] and got.count() == 1000
    want = left.join(right, "k", "left").select("id", "k", "n", "top")
    assert got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "hashpartitioning(k" in plan and ", _salt" in plan
