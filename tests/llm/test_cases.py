"""Cases of single operators: nulls, ties, long and hostile texts, damage."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import common, decontaminate, exact, html, language, licenses, near, packing, shards, store, suffixes
from rivulet.llm.tokens import Encoder, default_path

BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to the old mill by the river"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# ---- 1 ----

NOTICES = {
    "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0", "Licensed under CC BY 3.0.": "CC-BY-3.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under the Apache License, Version 1.1.": "Apache-1.1", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
    "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.": "GPL-2.0",
    "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.": "GPL-3.0",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "AGPL-3.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: ISC": "ISC",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "Version 2 of the story": None, "nothing of the kind": None,
}


def test_notices_of_a_family(spark):
    rows = [(str(k), f"f{k}/x", f"{BASE}\n{t}\n{BASE}", 1) for k, t in enumerate(NOTICES)]
    rows += [("same", "f0/x", f"{BASE}\n{next(iter(NOTICES))}", 1)] * 2
    got = {r["id"]: r["own"] for r in licenses.license_scan(spark.createDataFrame(rows, "id string, path string, text string, folder int")).collect()}
    assert {k: got[str(k)] for k in range(len(NOTICES))} == dict(enumerate(NOTICES.values()))
    assert licenses.license_scan(spark.createDataFrame([], "id string, path string, text string")).count() == 0


def test_cosine_against_plain_vectors():
    m = licenses.Matcher({"this": 5, "is": 7}, 40)
    idf = {w: np.log(41 / ({"this": 5, "is": 7}.get(w, 0) + 1)) + 1 for w in licenses.vocabulary()}
    vec = lambda t: {w: c * idf.get(w, np.log(41) + 1) for w, c in licenses.terms(t).items()}
    cos = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    for text in ("Licensed under the MIT License", "This work is licensed by its author", "Released under the GNU General Public License version 3"):
        want = max(cos(vec(text), vec(n)) for ns in licenses.TEMPLATES.values() for n in ns)
        assert m.notices.match(text.lower().split())[1] == pytest.approx(want)


# ---- 2 ----


def least_capacity(sizes, n):
    """By all cuts: best[k][i] is the least largest shard of the first i groups in k shards."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    best = [[0] + [float("inf")] * len(sizes)]
    for _ in range(n):
        best.append([min(max(best[-1][j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)])
    return best[n][-1]


def test_shards_by_brute_force(spark):
    rng = random.Random(4)
    texts = [rng.choice([None, "", "x" * rng.randint(1, 900), "same"]) for _ in range(60)]
    got = shards.shard(frame(spark, [*enumerate(texts), (None, "nul"), (None, "nul"), (5, "twice")]), n=7).collect()
    assert len(got) == 63
    groups = {}
    for k, t in [*enumerate(texts), (None, "nul"), (None, "nul"), (5, "twice")]:
        g = groups.setdefault(t or "", [-1 if k is None else k, 0])
        g[0], g[1] = min(g[0], -1 if k is None else k), g[1] + len((t or "").encode()) + 16
    by = {}
    for r in got:
        by[r["shard"]] = by.get(r["shard"], 0) + r["size"]
    ordered = [size for _, size in sorted(groups.values())]
    assert max(by.values()) == least_capacity(ordered, 7) and min(by.values()) >= max(by.values()) - 2 * max(ordered)
    assert len({r["shard"] for r in shards.shard(frame(spark, [(1, "a"), (2, "b")]), n=9).collect()}) == 2


# ---- 4 ----

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def marked(docs, items):
    ws = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = ws(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = {}
    for k, t in docs:
        w, hit, own = ws(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if x := wins.get(tuple(w[a : a + n])):
                    own |= x
                    hit.update(range(a, a + n))
        out[k] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_by_brute_force(spark):
    rng, voc = random.Random(1), ["a", "b", "c", "dé", "E"]
    items = [(None, "a b c d e f g h i j k l"), (None, "x y"), (1, "a " * 12), (2, "b"), (3, None), (4, ""), (5, "a b c d e f g h i j"), (6, " ".join(rng.choice(voc) for _ in range(400)))]
    docs = [(k, " ".join(rng.choice(voc) for _ in range(rng.randint(0, 200)))) for k in range(60)]
    docs += [(500, None), (501, ""), (502, "a b c d e f g h i j k l x y"), (503, "a " * 9), (504, "a " * 10), (505, items[-1][1])]
    want, bench = marked(docs, items), spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, n int")
    df = frame(spark, [(*x, 1, 2, 3) for x in docs], "doc_id long, text string, rid int, n int, _rid int")
    for size in (decontaminate.INDEX_BYTES, 10):
        got = {r[0]: tuple(r[1:]) for r in decontaminate.digest(decontaminate.mark(df, bench, size)).collect()}
        assert got == want
        assert decontaminate.mark(df, bench.limit(0), size).where("size(spans) > 0").count() == 0
    assert decontaminate.mark(df.limit(0), bench, 10).count() == 0


def test_decontamination_of_repetitive_texts(spark):
    text = "the quick brown fox jumps " * 40_000
    got = decontaminate.digest(decontaminate.mark(frame(spark, [(1, text)]), spark.createDataFrame([(1, text), (None, text)], "item_id long, text string"))).first()
    assert (got["n_words"], got["n_hit"], got["n_items"]) == (200_000, 200_000, 2)


# ---- 5 ----


def test_html_cases():
    two = f"{BASE} and {BASE}"
    assert html.main_text(f"<article><p title=it's fine>{two}</p></article>") == two
    ja = "これは日本語の記事です。とても長い文章が続きます。" * 6
    assert html.main_text(f"<nav><a>x</a></nav><div><p>{ja}</p></div>") == ja
    page = f"<article><header><h1>Title</h1><p>By me</p></header><section id='related-work' class='related-work'><h2>Related work</h2><p>{two}</p></section></article>"
    assert html.main_text(page) == f"Title\n\nRelated work\n\n{two}"
    assert html.main_text(f"<article><p>{two}</p><div class='related-posts'><p>{two} x</p></div><div id=comments><p>{two} y</p></div></article>") == two
    assert html.main_text("<article><p>cut <a href='x") == "cut"
    assert html.main_text("<article><p>1 < 2 <3") == html.main_text("<article><p>1 &lt; 2 &lt;3") == "1 < 2 <3"


@pytest.mark.parametrize("page", ["<p title=\"x>" * 100_000, "<b>" * 100_000 + "</p>" * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<p a" * 100_000, "<!--" * 100_000, "<div>" * 100_000])
def test_html_is_linear(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 5


def test_html_table(spark):
    rows = [(1, "u", None, 0), (1, "u", None, 0), (2, None, f"<article><p>{BASE}</p></article>", 0)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == [(1, "", 0), (1, "", 0), (2, BASE, len(BASE))]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- 6, 8 ----


def test_encoder_by_the_library():
    rng, lib = random.Random(2), Encoder(default_path()).tokenizer
    marks = [*"abcXYZ019 .,'!?-_<|>=\t\n\réÉßñÄ×÷̸́  KİςΣдж日한\U0001f600½ﬁ\x00\x1c\x85", "'s", "'ll", "<|endoftext|>", "don't"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" * 5000, ""]
    for cap in (1_000_000, 50):
        own = Encoder(default_path(), cap)
        assert not own.whole
        for a in range(0, len(texts), 500):
            part = texts[a : a + 500]
            ids, at = own.encode(*common.utf8(pa.array(part)))
            assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]


def test_store_detects_damage(spark, tmp_path):
    rng = random.Random(1)
    docs = frame(spark, [(k, " ".join(rng.choice(BASE.split()) for _ in range(2500))) for k in range(20)] + [(None, "n"), (3, BASE)])
    with common.Tables() as own:
        s = store.write_store(docs)
    got = sorted(store.read_digests(spark, s).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, *range(4, 20)]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]

    def broken(name, change):
        path = f"{tmp_path}/{hashlib.md5(str(change).encode()).hexdigest()}"
        for part in ("parts", "recipes", "manifest"):
            df = spark.read.parquet(f"{s}/{part}")
            df = change(df) if part == name else df
            (df.write.partitionBy("kind") if part == "parts" else df.write).parquet(f"{path}/{part}")
        return path

    changes = [
        ("parts", lambda df: df.where("n_tokens > 300")), ("parts", lambda df: df.withColumn("payload", F.concat("payload", F.lit(b"\0\0")))),
        ("recipes", lambda df: df.where("doc_id IS NULL OR doc_id <> 4")), ("recipes", lambda df: df.withColumn("keys", F.reverse("keys"))),
        ("recipes", lambda df: df.where("part > 0")), ("manifest", lambda df: df.withColumn("n_docs", F.col("n_docs") + 1)),
    ]
    assert max(r[0] for r in store.recipes(spark, s).select(F.size("keys")).collect()) > 1
    for name, change in changes:
        with pytest.raises(Exception, match="damaged|missing|differ|no end"):
            store.read_digests(spark, broken(name, change)).collect()
    own.release(spark)


def test_crc_of_joined_parts():
    import zlib

    rng, shift = np.random.default_rng(1), store.Shift()
    parts = [rng.integers(0, 256, 4 * n).astype(np.uint8).tobytes() for n in (1, 4095, 4096, 4097, 20000, 300)]
    n = np.array([len(p) // 4 for p in parts])
    own = store._times(np.array([zlib.crc32(p) for p in parts], np.uint32), shift(n.sum() - np.cumsum(n)))
    assert np.bitwise_xor.reduce(own) == zlib.crc32(b"".join(parts))


def test_hilbert_neighbours_touch():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert(points, 3)
    order = points[np.argsort(key)]
    assert sorted(key) == list(range(side**3)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# ---- 7, 9, 10 ----


def test_near_null_ids(spark):
    got = near.near_duplicates(frame(spark, [(None, BASE), (None, BASE), (1, BASE), (2, BASE), (2, "else")])).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(None, None, True)] * 2 + [(1, 1, True), (2, 1, False), (2, 1, False)], key=str)


def test_language_cases(spark):
    rows = [(k, t, "en" if "the" in t else "de") for k, t in enumerate([BASE, "das ist ein Haus am Fluss mit einem Boot", f"{BASE} too", "wir gehen heute nicht mehr nach Hause"] * 8)]
    rows += [(None, "ein Haus", "de"), (90, "ein Haus", None), (90, "ein Haus", None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (None, 90)} == {"de"} and all(0 <= r["score"] <= 1 for r in got)
    none = language.identify(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    two = [(k, "same words", lang) for k, lang in ((0, "b"), (1, "a"), (3, "b"), (4, "a"))]
    assert {r["lang_pred"] for r in language.identify(spark.createDataFrame(two, "doc_id long, text string, lang string")).collect()} == {"a"}


@pytest.mark.parametrize("identify", [F.xxhash64, F.length, lambda c: F.lit(1)])
def test_exact_with_colliding_identifiers(spark, identify):
    texts = [BASE, BASE[::-1], BASE, None, "", "ab", "ba", "x" * 20_000, "x" * 19_999 + "y", "x" * 20_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, BASE), (None, "only")]
    got = exact.exact_dedup(frame(spark, rows), identify=identify).collect()
    top = {}
    for k, t in rows:
        top.setdefault(t or "", []).append(k)
    for r in got:
        same = next(x for t, x in top.items() if r["doc_id"] in x and hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(same) and r["keep_id"] == max((k for k in same if k is not None), default=None)
    assert len(got) == len(rows)


# ---- 3 ----


def hot_rows(n=700):
    """Documents with one of few passages of 36 to 60 bytes, whose neighbours of up to 20 bytes are random or some others' too."""
    rng = random.Random(5)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passages = [text(60)] * 3 + [text(50), text(47), text(36)]
    near = [text(20) for _ in range(6)]
    side = lambda: text(20) if rng.random() < 0.5 else text(rng.randrange(8)) + rng.choice(near)
    return [(k, side() + rng.choice(passages) + (side() if rng.random() < 0.9 else "")) for k in range(n)]


def removed(rows):
    """By brute force: doc_id, n_removed, kept_sha256."""
    first, out = {}, {}
    for k, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(k, first.get(t[p : p + 50], k))
    for k, t in rows:
        gone = set()
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < k:
                gone.update(range(p, p + 50))
        out[k] = (len(gone), hashlib.sha256("".join(c for i, c in enumerate(t) if i not in gone).encode()).hexdigest())
    return out


def test_repeats_of_hot_grams(spark, monkeypatch):
    """A third of all rows around one anchor: dealt by their bytes, with the same result as by brute force."""
    rows = hot_rows()
    dealt = []
    monkeypatch.setattr(suffixes, "table", lambda df: dealt.append(common.table(df)) or dealt[-1])
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got == removed(rows)
    hot, parts = dealt[-2], dealt[-1]
    assert 0 < hot.count() < 4 * common.tasks(spark) and parts.where("starts IS NOT NULL").count() and parts.where("starts IS NULL").count()


@pytest.mark.parametrize("at_once, most", [(1, 5), (3, 40), (8192, 32768)])
def test_sorting_a_gram_in_portions(monkeypatch, at_once, most):
    """Portions, with one string of each kind carried on, settle what sorting all rows at once does."""
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    monkeypatch.setattr(suffixes, "MOST", most)
    rng = random.Random(3)
    kinds = ["".join(rng.choice("ab") for _ in range(54)) for _ in range(9)]
    rows = sorted((rng.randrange(3), k // 2, bytes([1 + k]), "") for k in range(90))
    rows = [(g, d, r, rng.choice(kinds[3 * g : 3 * g + 3]).encode()) for g, d, r, _ in rows]  # equal strings have equal grams
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array([(100).to_bytes(8, "little")] * 90)], names=["gram", "doc_id", "row", "text", "places"])
    found = {(d, r, int(p)) for b in suffixes._sorted_spans(iter([batch.slice(0, 33), batch.slice(33)])) for d, r, s in zip(*(c.to_pylist() for c in b.columns), strict=True) for p in np.frombuffer(s, "<i8")}
    least = {}
    for g, d, _, t in rows:
        for p in range(5):
            least[g, t[p : p + 50]] = min(d, least.get((g, t[p : p + 50]), d))
    want = {(d, r, 100 + p) for g, d, r, t in rows for p in range(5) if least[g, t[p : p + 50]] < d}
    assert found == want
