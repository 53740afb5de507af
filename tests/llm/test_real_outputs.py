"""Operators' real outputs, clashing columns, repeated ids."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest

from rivulet.llm import decontaminate, exact, language, near, packing, suffixes
from rivulet.llm.common import Tables, free
from rivulet.llm.tokens import default_path

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
LEAK = "what is the name of the longest river that flows through all of these old towns"


def components(rows):
    """{doc_id: least linked doc_id}, rows of one id being linked."""
    sets = [(k, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()) for k, t in rows]
    least = {k: k for k, _ in rows if k is not None}
    for _ in rows:
        for k, a in sets:
            for j, b in sets:
                if None not in (k, j) and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    least[k] = least[j] = min(least[k], least[j])
    return least


def test_rows_that_share_an_id_are_linked(spark):
    b = " ".join(f"w{i}" for i in range(20))
    c = " ".join(f"x{i}" for i in range(20))
    for rows in (
        [(1, A), (1, b), (2, b + " more")],
        [(5, A), (3, A + " more"), (3, b), (9, b + " other"), (9, c), (2, c + " end"), (7, "alone in this"), (None, A), (4, None), (4, c), (4, "")],
    ):
        got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = components(rows)
        assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(k), want.get(k)) for k, _ in rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert sorted(r.n_shingles for r in got) == sorted(max(1, len(t.split()) - 4) if t and t.split() else 0 for _, t in rows)


NAMES = "doc_id long, text string, lang string, gone int, gone_ int, gone_key int, GONE_SHA int, rid int, _rid int, _key int, _sha string, component_id int, row int, set int, ids int"


@pytest.mark.parametrize("step", [exact.keep_exact, near.keep_near, lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, LEAK)], "item_id long, text string")),
                                  lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, LEAK)], "item_id long, text string"), 0), language.keep_identified])
def test_columns_of_any_name_stay(spark, step):
    rows = [(k, t, "en", *range(12)) for k, t in enumerate([A, A + " more", LEAK + " and so on", "words of their own that nothing else has"])]
    docs = spark.createDataFrame([(*r[:10], "s", *r[11:]) for r in rows], NAMES)
    with Tables() as own:
        got = step(docs)
        assert got.columns == docs.columns and got.exceptAll(docs).count() == 0 and got.count() >= 3
    own.release(spark)


def test_free_names(spark):
    df = spark.createDataFrame([], "A int, a_ int, b int")
    assert free(df, "a", "b", "c", "c") == ["a__", "b_", "c", "c_"]


def test_packed_ids_decode_to_the_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = {1: A, 2: "", 3: "the river and the mill " * 900, 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    t, got = Tokenizer.from_file(default_path()), {}
    for r in sorted(packing.pack(docs, length=256).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert got == {k: [*t.encode(x or "", add_special_tokens=False).ids, 2] for k, x in texts.items()}


def test_the_pipeline_ends_with_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(k, x, "en", "s", len(x)) for k, x in enumerate([A, A, LEAK + " and so on", "these are words of their own that nothing else has", "123 456"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    t, got = Tokenizer.from_file(default_path()), {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert {k: t.decode(v[:-1]).replace("</w>", "") for k, v in got.items()} == {1: A, 3: "these are words of their own that nothing else has"}


def test_removed_spans_and_what_is_kept(spark):
    shared = "é passage of more than fifty bytes that two of these documents have in common"
    docs = spark.createDataFrame([(1, f"first {shared} end"), (2, f"{shared} other {shared}"), (3, None), (4, "short")], "doc_id long, text string")
    with Tables() as own:
        found = suffixes.remove_repeats(docs)
        kept = {r.doc_id: bytes(r.kept) for r in suffixes.cut(docs, found).collect()}
        for r in found.collect():
            assert hashlib.sha256(kept[r.doc_id]).hexdigest() == r.kept_sha256 and r.n_spans == len(r.spans) and r.n_removed == sum(s["end"] - s["begin"] for s in r.spans)
    own.release(spark)
    assert kept[1] == f"first {shared} end".encode() and kept[2].strip() == b"other" and kept[3] == b"" and kept[4] == b"short"
