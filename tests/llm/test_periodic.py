"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rivulet.llm import periodic


def plain(s, least=6, exponent=4):
    n, best = len(s), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j > i and j - i >= p:
                best.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((i, size, p) for (i, size), p in best.items() if size >= least and size >= exponent * p)


def symbols(rnd):
    k, n = rnd.choice([1, 2, 2, 3, 5]), rnd.randint(0, 60)
    s = [rnd.randrange(k) for _ in range(n)]
    w = [rnd.randrange(k) for _ in range(rnd.randint(1, 7))]
    return s[: n // 2] + w * rnd.randint(0, 9) + s[n // 2 :] + w[: rnd.randint(0, len(w))] + s[: rnd.randint(0, n)]


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (3, 3), (7, 2)])
def test_runs(least, exponent):
    rnd = random.Random(least)
    for _ in range(1500):
        s = symbols(rnd)
        assert periodic.runs(s, least, exponent) == plain(s, least, exponent)


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (6, 3)])
def test_stretches_hold_all_runs(least, exponent):
    rnd = random.Random(7)
    for _ in range(200):
        rows = [symbols(rnd) for _ in range(3)]
        h = np.array([hash((x, 1)) & (1 << 63) - 1 for r in rows for x in r], np.uint64)
        row = np.repeat(np.arange(3), [len(r) for r in rows])
        cuts, at = periodic._stretches(h, row, least, exponent), 0
        for r in rows:
            for begin, size, _ in plain(r, least, exponent):
                assert any(a <= at + begin and at + begin + size <= z for a, z in cuts)
            at += len(r)


def test_factors_are_the_longest_earlier_pieces():
    rnd = random.Random(2)
    for _ in range(300):
        s = symbols(rnd)
        at = 0
        for b, e, source in periodic.factors(s):
            assert b == at and (source is None) == (s[b] not in s[:b])
            if source is not None:
                assert source < b and s[source : source + e - b] == s[b:e]
                assert e == len(s) or not any(s[i : i + e - b + 1] == s[b : e + 1] for i in range(b))
            at = e
        assert at == len(s)


def want(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(w)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain(w)
        gone = {i for b, size, p in found for i in range(b + p, b + size)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        out.append((doc_id, len(found), *best, milli, sha("".join(f"{b},{z},{p}\n" for b, z, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def test_query_on_texts(spark):
    rnd = random.Random(3)
    word = ["a", "b", "Ünïcode", "x y", "c.", "\u0085"]
    sep = [" ", "\n", "\t ", "\x0b", " \r\n"]
    rows = [(i, "".join(word[x % 6] + rnd.choice(sep) for x in symbols(rnd))) for i in range(300)]
    rows += [(None, "x " * 20), (None, None), (1, None), (2, ""), (3, " \n"), (4, "z " * 6), (4, "z " * 6), (5, "z " * 5), (6, "  lead  and  gaps  ")]
    rows += [(7, " ".join(str(i % 997) for i in range(6000)))]
    got = periodic.digest(periodic.find_runs(periodic.plant(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want(rows)


def test_edges(spark):
    assert periodic.digest(periodic.find_runs(periodic.plant(spark.createDataFrame([], "doc_id long, text string")))).collect() == []
    clash = spark.createDataFrame([("k", "ha " * 7 + "end", 1, "x")], "doc_id string, text string, runs int, n_words string")
    row = periodic.find_runs(clash).collect()[0]
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (8, [(0, 7, 1)], "ha end")
    long = " ".join(f"w{i}" for i in range(200_000)) + " loop" * 1000
    row = periodic.find_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).select("runs").collect()[0]
    assert [tuple(r) for r in row.runs] == [(200_000, 1000, 1)]
    with pytest.raises(ValueError):
        periodic.find_runs(clash, exponent=1)
