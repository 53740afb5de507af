"""The operators on a small table with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, exact, html, language, licenses, near, packing, shards, store, suffixes
from rivulet.llm.tokens import default_path

BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to the old mill by the river"
TEXTS = [BASE, BASE, BASE + " today", None, "", " \n", "one two", "Licensed under the Apache License, Version 2.0.", "x" * 3000, ("word " * 40 + BASE + " ") * 20, "das ist ein Haus ähnlich ß", "123 !!"]
EXTRA = "part int, i int, key int, bucket int, n int, class int, size int, recipe int, rid int, begin int, lo int, component int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "de" if t and t.startswith("das") else "en", "s", 0, *[7] * 12) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[0]], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(BASE.split()[3:14])), (2, "one two"), (3, None), (4, "")], "item_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_exact(docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(docs).collect()}
    assert {(0, 1, 3, False), (1, 1, 3, True), (3, 4, 2, False), (4, 4, 2, True), (2, 2, 1, True)} <= got
    kept = exact.keep_exact(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11]


def test_shards(docs):
    got = shards.shard(docs, n=3).collect()
    assert len(got) == 13 and len({r["shard"] for r in got if r["doc_id"] in (0, 1)}) == 1
    for k in {r["shard"] for r in got}:
        own = [r["slot"] for r in got if r["shard"] == k]
        assert sorted(own) == list(range(len(own)))
    assert {r["text_crc32"] for r in got if r["doc_id"] in (3, 4)} == {0}


def test_shards_beside_a_hot_group(spark):
    texts = [f"{k:04} " + "a b c d " * 12 for k in range(300)] + ["hot " * 20] * 300
    order = [*range(120), *range(300, 600), *range(120, 300)]
    got = shards.shard(spark.createDataFrame([(k, texts[j]) for k, j in enumerate(order)], "doc_id long, text string"), n=12).groupBy("shard").sum("size").collect()
    sizes = sorted(r[1] for r in got)
    assert len(sizes) == 12 and sizes[-1] == 300 * 96 and sizes[-2] <= 1.3 * sizes[0]


def test_balanced_cuts():
    rng = np.random.default_rng(7)
    for case in range(300):
        steps = rng.integers(1, 30, rng.integers(1, 40)).tolist()
        steps[rng.integers(len(steps))] *= int(rng.integers(1, 12))
        n, points = int(rng.integers(1, 14)), [0, *np.cumsum(steps).tolist()]
        whole = set(points)
        capacity, cuts = shards.least_capacity(lambda got: [(a, z, [(p, True) for p in points if a < p <= z]) for a, z in got], points[-1], max(steps), n)
        own = np.diff([0, *cuts])
        assert len(cuts) == n and cuts[-1] == points[-1] and set(cuts) <= whole and max(own) == capacity, (steps, n)
        assert (own > 0).sum() == min(n, len(steps)), (steps, n, cuts)


def test_repeats(docs):
    own = [(k, (t or "").encode()) for k, t in enumerate(TEXTS)]
    first = {}
    for k, t in own:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], k)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    for k, t in own:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < k:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest())


def test_repeats_of_surroundings_with_equal_short_hashes(spark):
    """The surroundings of the common gram differ in both texts, but 32 bits of their hashes and both sides are equal."""
    mid = "the quick brown fox jumps over the lazy dog and ru"
    texts = [f"vnywuhtdvayizhf{mid}jgvftvzzfomnhdd", f"ybeojocaqsoygfc{mid}vodokjdfvrlwqej"]
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: len(mid)}


def test_decontamination(docs, items):
    for block in (1 << 20, 40):
        got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.mark(docs, items, block)).collect()}
        assert [k for k, r in sorted(got.items()) if r["contaminated"]] == [0, 1, 2, 6, 9]
        assert got[0]["n_hit"] == 11 and got[6]["items_sha256"] == hashlib.sha256(b"2").hexdigest() and got[3]["n_words"] == 0
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == 7


def test_tokens_store_and_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    ids = {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(TEXTS)}
    s = store.write_store(docs)
    for r in store.read_digests(spark, s).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]] + [1], "<u4").tobytes())
    assert all(r["ids"] == ids[r["doc_id"]] + [1] for r in store.read_documents(spark, s).collect())
    got = packing.pack(docs, length=64).collect()
    assert sum(r["length"] for r in got) == sum(len(ids[k]) + 1 for k in [*ids, 0])
    for r in got:
        own = (ids[r["doc_id"]] + [2])[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["offset"] + r["length"] <= 64


def test_near(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs).collect()}
    assert got[2] == (19, 0, False) and got[1][1] == 0 and got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[6] == (1, 6, True)
    assert near.keep_near(docs).columns == docs.columns


@pytest.mark.parametrize("parts", [None, 3])
def test_near_against_brute_force(spark, monkeypatch, parts):
    """Groups about the threshold, so that buckets hold several components; some sets are too long to be listed. Buckets
    are compared whole or, as large ones are, in a grid of parts."""
    if parts:
        monkeypatch.setattr(near, "_parts", lambda *_: F.lit(parts).cast("long"))
    rng, texts = np.random.default_rng(5), []
    for length, copies, changed in ((120, 60, 4), (120, 40, 3), (near.LISTED + 400, 12, 36)):
        base = rng.integers(0, 5000, length)
        for _ in range(copies):
            own = base.copy()
            own[rng.integers(0, length, changed)] = rng.integers(5000, 9000, changed)
            texts.append(" ".join(f"w{x}" for x in own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    least, links = list(range(len(sets))), 0
    for _ in range(len(sets)):
        before = list(least)
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    links += 1
                    least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert links and 3 < len(set(least)) < len(sets)
    got = near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {k: (len(x), least[k]) for k, x in enumerate(sets)}


def test_language(docs):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (3, 4, 5, 11)) and got[0]["lang_pred"] == "en"
    assert sorted(r["doc_id"] for r in language.keep_identified(docs).collect()) == [0, 0, 1, 2, 6, 7, 8, 9, 10]


def test_html():
    assert html.main_text(None) == "" == html.main_text("<nav><a>x</a></nav>")
    page = f"<body><nav>menu</nav><article><h1>Title</h1><p>{BASE} &amp; {BASE}<p>Short.</article><div class='comments'><p>{BASE}</div><footer>&copy; x</footer>"
    assert html.main_text(page) == f"Title\n\n{BASE} & {BASE}\n\nShort."


def test_html_of_marked_wrappers():
    text = f"{BASE} and {BASE}"
    for name in ("content-sidebar-wrap", "has-sidebar", "no-comments", "with-header"):
        for kind in ("main", "article"):
            page = f"<div class='{name}'><div><{kind}><h1>T</h1><p>{text}</p><div class='comments'><article><p>{text} x</article></div></{kind}><p>{text} y</div><div class='comments'><article>{text} z</article></div></div>"
            assert html.main_text(page) == f"T\n\n{text}"
    assert html.main_text(f"<div class='comments'><article><p>{text}</article></div><article><p>{text} a</article>") == f"{text} a"
    assert html.main_text(f"<nav class=x><main><p>{text}</main></nav>") == ""
    for beside in ("<div class='share'>Share this</div>", "<div class='ad'>Buy</div>", "<header>By me</header>"):
        assert html.main_text(f"<article><h1>T</h1><p>Short text.</p>{beside}</article>") == "T\n\nShort text."
        assert html.main_text(f"<article><h1>T</h1>{beside}<p>Short text.</p></article>") == "T\n\nShort text."


def test_licenses(spark):
    files = [("1", "a/LICENSE", "Released under the MIT License."), ("2", "a/b/x", BASE), ("3", "c/x", None), ("4", None, ""), ("5", "a/b/y", BASE + "\nLicensed under CC BY-NC 4.0.\n" + BASE)]
    got = {r["id"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(files, "id string, path string, text string")).collect()}
    assert got == {"1": "MIT", "2": "MIT", "3": None, "4": None, "5": "CC-BY-NC-4.0"}


def test_licenses_of_lines_without_stems(spark):
    """The first lines of wrapped notices name no licence by a stem of that word."""
    files = [("1", "a/x", BASE + "\nThis Source Code Form is subject to the terms of the Mozilla Public\n" + BASE), ("2", "b/x", BASE + "\nThis work is under a Creative Commons Attribution 4.0 International\n" + BASE)]
    got = {r["id"]: r["own"] for r in licenses.license_scan(spark.createDataFrame(files, "id string, path string, text string")).collect()}
    assert got == {"1": "MPL-2.0", "2": "CC-BY-4.0"}


def test_licenses_over_lines_and_inside_them(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are\n * met:"
    inside = f"{BASE}. Licensed under CC BY-NC 4.0. {BASE}"
    whole = licenses.full_texts()
    files = [("gpl", "a/x", f"{BASE}\n{gpl}\n{BASE}"), ("bsd", "b/x", f"{BASE}\n{bsd}\n{BASE}"), ("nc", "c/x", inside)]
    files += [(name, f"{name}/LICENSE", f"Copyright (c) 2020 A. Author\n\n{text}") for name, text in whole.items()] + [(f"in {name}", f"{name}/b/x", BASE) for name in whole]
    got = {r["id"]: (r["own"], r["is_file"], r["license"]) for r in licenses.license_scan(spark.createDataFrame(files, "id string, path string, text string")).collect()}
    assert (got["gpl"][0], got["bsd"][0], got["nc"][0]) == ("GPL-3.0", "BSD-3-Clause", "CC-BY-NC-4.0")
    assert {k: v for k, v in got.items() if k in whole} == {name: (name, True, name) for name in whole}
    assert all(got[f"in {name}"] == (None, False, name) for name in whole)


def test_license_frequencies_are_of_all_lines():
    b = pa.RecordBatch.from_arrays([pa.array(["this is the first\nthis is not\n\nunder the licensed", None, ""])], names=["text"])
    n = {}
    for out in licenses._frequencies(licenses.vocabulary())(iter([b])):
        for k, v in zip(out.column("term").to_pylist(), out.column("n").to_pylist(), strict=True):
            n[k] = n.get(k, 0) + v
    assert (n["this"], n["is"], n["the"], n["under the"], n["licensed"], n[""]) == (2, 2, 2, 1, 1, 4)


def test_empty(docs, items):
    none = docs.limit(0)
    for out in (exact.exact_dedup(none), shards.shard(none), suffixes.remove_repeats(none), decontaminate.mark(none, items), packing.pack(none),
                near.near_duplicates(none), store.token_store(none), language.identify(none)):
        assert out.count() == 0


def test_sort():
    m = np.frombuffer(b"".join((b"a" * 30 + bytes([97 + k % 3]) * 20) for k in range(9)), np.uint8).reshape(9, 50)
    order, unequal = suffixes.deep_shallow_sort(m)
    assert [bytes(m[k]) for k in order] == sorted(map(bytes, m)) and unequal.sum() == 3
    assert near.shingles(pa.array(["a b", None]))[1].tolist() == [0, 1, 1]
