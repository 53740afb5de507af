"""Licence scans: TF-IDF cosine of headers and licence files to templates, inherited from the nearest ancestor folder."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, batches, join_hot, table

#: Notices by licence, as public licence texts and their usual headers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal.",),
}

def _family() -> dict[str, tuple[str, ...]]:
    """Notices of further licences and versions, by rule."""
    out: dict[str, tuple[str, ...]] = {}
    kinds = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
             "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    for kind, words in kinds.items():
        for version, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            out[f"CC-{kind}-{version}"] = (
                f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {words} {version} {port} License.", f"SPDX-License-Identifier: CC-{kind}-{version}",
            )
    gnu = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
    names = {"GPL": ("program", "General Public License"), "LGPL": ("library", "Lesser General Public License"), "AGPL": ("program", "Affero General Public License")}
    for short, versions in {"GPL": ("3.0", "2.0"), "LGPL": ("3.0", "2.1"), "AGPL": ("3.0",)}.items():
        for version in versions:
            what, name = names[short]
            v = version.removesuffix(".0")
            out[f"{short}-{version}"] = (
                gnu.format(what=what, name=name, v=v), f"This work is licensed under the GNU {name}, version {v}.", f"Licensed under the {short}v{v}.",
                f"SPDX-License-Identifier: {short}-{version}-only", f"SPDX-License-Identifier: {short}-{version}-or-later",
            )
    for name in ("Apache-1.1", "MPL-1.1", "BSD-2-Clause", "ISC", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0"):
        out[name] = (f"SPDX-License-Identifier: {name}",)
    out["Apache-1.1"] += ("Licensed under the Apache License, Version 1.1.", "Apache Software License, Version 1.1")
    out["MPL-1.1"] += ("The contents of this file are subject to the Mozilla Public License Version 1.1",)
    out["BSD-2-Clause"] += ("Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License.")
    out["BSD-3-Clause"] = ("Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.")
    out["ISC"] += ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.")
    out["Unlicense"] += ("This is free and unencumbered software released into the public domain.",)
    out["BSL-1.0"] += ("Distributed under the Boost Software License, Version 1.0.",)
    out["EPL-2.0"] += ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",)
    return out


for _name, _notices in _family().items():
    TEMPLATES[_name] = (*TEMPLATES.get(_name, ()), *(n for n in _notices if n not in TEMPLATES.get(_name, ())))

#: Words that tell licences of one family apart: a part that has one its template lacks isn't of that licence.
APART = frozenset("nd noderivs noderivatives nc noncommercial sa sharealike lesser library affero".split())
_DECIMAL = re.compile(r"[0-9]+\.[0-9]+")
_SHORT = re.compile(r"(?:l|a)?gplv?([0-9])")


def marks(words: list[str]) -> frozenset[str]:
    """What tells a licence from others of its family: words, and version numbers without a last .0."""
    out = {w for w in words if w in APART}
    for before, w in zip(["", *words], words, strict=False):
        own = _VERSION.sub("", w)
        if _DECIMAL.fullmatch(own):
            out.add(own.removesuffix(".0"))
        elif own.isdigit() and (before in ("version", "v", "gpl", "lgpl", "agpl") or own != w):
            out.add(own)
        elif m := _SHORT.fullmatch(w):
            out.add(m[1])
    return frozenset(out)


#: Least cosine of a part of a text to a template, and least share of a text's words in such parts for a licence file.
COSINE, FILE_SHARE = 0.75, 0.3
#: Least cosine of a title to a notice that says which licence it names.
NAMED = 0.4
#: Most lines in a row that are judged as one part.
JOINED = 4

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_VERSION = re.compile(r"^v(?=\d)")
#: Characters read at once, so that arrays stay small however large a batch is.
_AT_ONCE = 1 << 18


def full_texts() -> dict[str, str]:
    """Whole licences by name, as far as they are kept here. A text close to one of them may be of another licence of its
    family, which its title then says (see title())."""
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "texts").glob("*.txt"))}


#: Words in which a licence's title is looked for.
TITLE = 60


def title(words: list[str]) -> list[str]:
    """The words up to "license" and the three behind, in which a whole licence names itself and its version; none if it
    doesn't begin with such a title."""
    for i, w in enumerate(words[:TITLE]):
        if w in ("license", "licence"):
            return words[max(0, i - 6) : i + 4]
    return []


def terms(line: str | list[str]) -> Counter:
    found = [_VERSION.sub("", w) for w in (_WORD.findall(line.lower()) if isinstance(line, str) else line)]
    return Counter(found) + Counter(f"{a} {b}" for a, b in zip(found, found[1:], strict=False))


def vocabulary(templates=TEMPLATES) -> set[str]:
    texts = [n for notices in templates.values() for n in notices] + list(full_texts().values())
    return {w for n in texts for w in terms(n)}


class _Words(dict):
    def __missing__(self, word: str) -> int:
        return self.get(word[1:], 0) if word[0] == "v" and word[1:2].isdigit() else 0


class Terms:
    """Numbers of known terms: 0 is any unknown one, then come words and pairs of words."""

    def __init__(self, known: set[str]):
        words = sorted(w for w in known if " " not in w)
        self.word = _Words((w, k) for k, w in enumerate(words, 1))
        code = {t: self.word[a] * (len(words) + 1) + self.word[b] for t in known if " " in t for a, b in [t.split(" ")]}
        pairs = sorted(code, key=code.get)
        self.pairs = np.array([code[t] for t in pairs], np.int64)
        self.names = ["", *words, *pairs]

    def read(self, texts: list[str | None]) -> Reading:
        words: list[str] = []
        line_at, spaced, text_at = [0], [], [0]
        for text in texts:
            for line in (text or "").lower().splitlines():
                words += _WORD.findall(line)
                line_at.append(len(words))
                spaced.append(line.count(" ") + 1)
            text_at.append(len(spaced))
        one = np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))
        two = np.zeros(len(one), np.int64)
        both = np.flatnonzero((one[:-1] > 0) & (one[1:] > 0))
        if len(self.pairs) and len(both):
            code = one[both] * (len(self.word) + 1) + one[both + 1]
            k = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            two[both] = np.where(self.pairs[k] == code, k + len(self.word) + 1, 0)
        return Reading(words, one, two, np.array(line_at), np.array(spaced, np.int64), np.array(text_at))


class Reading:
    """The words of some texts in order; one and two: the numbers of each word and of it with the next; where lines begin
    among the words, each line's parts between spaces, and where texts begin among the lines."""

    def __init__(self, words, one, two, line_at, spaced, text_at):
        self.words, self.one, self.two, self.line_at, self.spaced, self.text_at = words, one, two, line_at, spaced, text_at

    def lines_by_term(self, size: int) -> np.ndarray:
        line = np.repeat(np.arange(len(self.spaced)), np.diff(self.line_at))
        pair = np.flatnonzero(self.two[:-1])
        pair = pair[line[pair] == line[pair + 1]]
        word = np.flatnonzero(self.one)
        seen = np.unique(np.concatenate((line[word] * size + self.one[word], line[pair] * size + self.two[pair])))
        return np.bincount(seen % size, minlength=size)


def _portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    a = n = 0
    for z, text in enumerate(texts):
        n += len(text or "")
        if n > _AT_ONCE:
            yield texts[a : z + 1]
            a, n = z + 1, 0
    yield texts[a:]


def _frequencies(known: set[str]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(known)
        seen = np.zeros(len(own.names), np.int64)
        lines = 0
        for b in batches(frames):
            for some in _portions(b.column("text").to_pylist()):
                read = own.read(some)
                lines += len(read.spaced)
                seen += read.lines_by_term(len(seen))
        out = [*((own.names[k], int(seen[k])) for k in np.flatnonzero(seen).tolist()), ("", lines)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out]), pa.array([n for _, n in out], pa.int64())], names=["term", "n"])

    return run


class _Index:
    """TF-IDF vectors of some texts, of length 1."""

    def __init__(self, texts: list[tuple[str, str]], idf: dict[str, float], other: float, terms_: Terms):
        self.idf, self.other = idf, other
        self.names = [name for name, _ in texts]
        self.words = [len(_WORD.findall(t.lower())) for _, t in texts]
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        number = {t: k for k, t in enumerate(terms_.names)}
        self.weights = np.zeros((len(texts), len(number)))  # of one occurrence of a term in the product with a text
        for i, (_, t) in enumerate(texts):
            v = {w: c * idf[w] for w, c in terms(t).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for w, x in v.items():
                self.index[w].append((i, x / norm))
                self.weights[i, number[w]] = idf[w] * x / norm
        self.marks = [marks(_WORD.findall(t.lower())) for _, t in texts]
        self.memo: dict[str, tuple[str | None, float]] = {}

    def match(self, words: list[str], apart: bool = False) -> tuple[str | None, float]:
        """The closest licence and its cosine; of equal ones the first given. With apart, only licences that have all
        marks of the words count."""
        text = " ".join(words)
        if (old := self.memo.get(text)) is not None:
            return old
        v = {w: c * self.idf.get(w, self.other) for w, c in terms(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        score: dict[int, float] = defaultdict(float)
        for w, x in v.items():
            for i, y in self.index.get(w, ()):
                score[i] += x * y / norm
        own = marks(words) if apart else frozenset()
        best = min(((-round(s, 12), i) for i, s in score.items() if own <= self.marks[i] or not apart), default=None)
        out = (best[0], self.names[best[1]]) if best else (0.0, None)
        if len(self.memo) < 10_000 and len(text) < 500:
            self.memo[text] = (out[1], -out[0])
        return out[1], -out[0]


class Matcher:
    """Sparse TF-IDF vectors of the templates; frequencies are lines by term, in lines in all."""

    def __init__(self, frequencies: dict[str, int], lines: int, templates=TEMPLATES):
        idf = {w: math.log((lines + 1) / (frequencies.get(w, 0) + 1)) + 1 for w in vocabulary(templates)}
        other = math.log(lines + 1) + 1  # of a term in no template
        self.terms = Terms(set(idf))
        self.squares = np.array([idf.get(w, other) ** 2 for w in self.terms.names])
        self.notices = _Index([(name, n) for name, notices in templates.items() for n in notices], idf, other, self.terms)
        self.whole = _Index(list(full_texts().items()), idf, other, self.terms)
        self.titles = {name: marks(title(_WORD.findall(t.lower()))) for name, t in full_texts().items()}
        self.named = {name: frozenset().union(*(marks(_WORD.findall(n.lower())) for n in notices)) for name, notices in templates.items()}

    def scan(self, texts: list[str | None]) -> list[tuple[str | None, float, bool]]:
        """Licence and cosine of the closest part of each whole text, and whether the text is a licence file."""
        return [x for some in _portions(texts) for x in self._scan(self.terms.read(some))]

    def _entire(self, words: list[str]) -> tuple[str | None, float]:
        """The licence whose whole text words are. Texts of one family agree nearly all along: where the title bears other
        marks than the closest text's, the licence is the one that the title names among the notices, or none."""
        name, score = self.whole.match(words)
        own = marks(title(words))
        if name is None or score < COSINE or not own or own == self.titles[name]:
            return name, score
        other, near = self.notices.match(title(words), apart=True)
        return (other, score) if other and near >= NAMED and own <= self.named[other] else (None, 0.0)

    def _scan(self, read: Reading) -> Iterator[tuple[str | None, float, bool]]:
        """A part's product with a template is a sum over its terms, and its length is at least the root of the sum of its
        terms' squares. So running sums bound every part's cosine from above; parts whose bound suffices are judged."""
        n = len(read.words)
        begin = read.line_at[read.text_at]  # of texts among the words
        text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        lines = np.repeat(np.arange(len(begin) - 1), np.diff(read.text_at))

        def sums(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair = weight[read.two]
            return np.append(0.0, np.cumsum(weight[read.one] + pair)), pair

        def over(sums_: tuple[np.ndarray, np.ndarray], a: np.ndarray, z: np.ndarray) -> np.ndarray:
            return sums_[0][z] - sums_[0][a] - sums_[1][z - 1]  # the last word's pair leads out of the part

        def enough(a: np.ndarray, z: np.ndarray) -> np.ndarray:
            return COSINE * np.sqrt(np.maximum(over(square, a, z), 0)) * (1 - 1e-6) - 1e-6

        def bar_of(m: int) -> np.ndarray:
            return COSINE * np.sqrt(np.maximum(square[0][m:] - square[0][:-m] - square[1][m - 1 :], 0)) * (1 - 1e-6) - 1e-6

        square, most = sums(self.squares), sums(self.notices.weights.max(axis=0))
        found: set[tuple[int, int]] = set()
        for k in range(1, JOINED + 1):  # runs of lines
            a, z = read.line_at[:-k], read.line_at[k:]
            own = (z > a) & (lines[: len(a)] == lines[k - 1 :])
            a, z = a[own], z[own]
            k = np.flatnonzero(over(most, a, z) >= enough(a, z))
            found.update(zip(a[k].tolist(), z[k].tolist(), strict=True))
        for m in sorted({m for size in self.notices.words for m in (size, size - size // 5, size + size // 4)}):  # runs of words
            if m > n:
                break
            a = np.flatnonzero(most[0][m:] - most[0][:-m] - most[1][m - 1 :] >= bar_of(m))
            a = a[text[a] == text[a + m - 1]]
            found.update(zip(a.tolist(), (a + m).tolist(), strict=True))
        best: dict[int, tuple[float, str, bool]] = {}
        covered = np.zeros(n + 1, np.int64)
        for a, z in found:
            name, score = self.notices.match(read.words[a:z], apart=True)
            if name and score >= COSINE:
                covered[a] += 1
                covered[z] -= 1
                # a notice that names its version tells more than a part of it that doesn't
                told = bool(marks(read.words[a:z]))
                t = int(text[a])
                best[t] = min(best.get(t, (0.0, "", False)), (-score, name, told), key=lambda x: (not x[2], x[0], x[1]))
        entire: set[int] = set()
        full = np.flatnonzero(begin[1:] > begin[:-1])
        bar = enough(begin[full], begin[full + 1])
        near = np.zeros(len(full), bool)
        for weight in self.whole.weights if len(full) else ():
            near |= over(sums(weight), begin[full], begin[full + 1]) >= bar
        for t in full[near].tolist():
            name, score = self._entire(read.words[begin[t] : begin[t + 1]])
            if name and score >= COSINE:
                entire.add(t)
                best[t] = (-score, name, True)
        inside = np.append(0, np.cumsum(np.cumsum(covered[:-1]) > 0))
        at = read.line_at
        share = read.spaced * (inside[at[1:]] - inside[at[:-1]]) / np.maximum(at[1:] - at[:-1], 1)
        for t, (a, z) in enumerate(zip(read.text_at[:-1].tolist(), read.text_at[1:].tolist(), strict=True)):
            if t not in best:
                yield None, 0.0, False
            else:
                score, name, _ = best[t]
                yield name, -score, t in entire or bool(share[a:z].sum() >= FILE_SHARE * read.spaced[a:z].sum())


def _scan(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames):
            got = shared.value.scan(b.column("text").to_pylist())
            cols = [b.column("id"), b.column("path"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "path", "own", "score", "is_file"])

    return run


def folder_of(path: Column) -> Column:
    """The folder of a file: "" for the root that relative paths share, "/" for the absolute one."""
    own = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when((own == "") & path.startswith("/"), "/").otherwise(own)


def inherited(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """(folder, inherited, inherited_from): of each folder its own licence or that of its nearest ancestor with one. The
    root of relative paths, "", and that of absolute ones, "/", are ancestors of their own kind alone.

    folders has each path once; licensed has (folder, license), each folder once. Every folder is joined with its
    ancestors by path, a row for each level; folders below one root that many share are dealt apart.
    """
    root = F.when(F.col("folder").startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(F.regexp_replace("folder", "^/", ""), "/", -1), lambda p: (p != "") | (F.col("folder").contains("//")))
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(root, F.array_join(F.slice(parts, F.lit(1), n), "/")))
    levels = F.concat(F.array(root), F.when(F.size(parts) > 0, below).otherwise(F.array().cast("array<string>")))
    up = table(folders.select("folder", F.explode(levels).alias("at")))
    shares = up.groupBy("at").agg(F.count(F.lit(1)).alias("rows"))
    right = licensed.select(F.col("folder").alias("at"), "license").join(shares, "at")
    hit = join_hot(up, right, "at", "rows", up.count(), "folder").where("license IS NOT NULL")
    near = hit.groupBy("folder").agg(F.max_by(F.struct("at", "license"), F.length("at")).alias("m"))
    return near.select("folder", F.col("m.license").alias("inherited"), F.col("m.at").alias("inherited_from"))


def license_scan(files: DataFrame) -> DataFrame:
    """id, path, own, score, is_file, license, inherited_from for every row of files (id, path, text).

    own is the licence of the part closest to a template, if its cosine is at least COSINE and it has no version or other mark that the template lacks; parts with marks come before those without. Parts are every line, every run
    of up to JOINED lines, and from every word on the runs of about as many words as a template has, over line ends; the
    whole text is also held against whole licences. Inverse frequencies are over all lines. Texts with a FILE_SHARE or more
    of their words in such parts, and those close to a whole licence, are licence files and license their folder; of several in one, the one most of them name counts,
    of equal numbers the first by name. license is own, else that of the nearest ancestor folder with one, else null. A
    null or empty text has no own licence; a null path has no folder and inherits nothing. Repeated rows are judged each.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = files.sparkSession
    arrow_limits(spark)
    own = files.select("id", "path", "text")
    counted = own.select("text").mapInArrow(_frequencies(vocabulary()), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r["term"]: r["n"] for r in counted}
    matcher = spark.sparkContext.broadcast(Matcher(n, n.get("", 0)))
    kind = dict(own.dtypes)
    found = table(own.mapInArrow(_scan(matcher), f"id {kind['id']}, path {kind['path']}, own string, score double, is_file boolean")
                  .withColumn("folder", folder_of(F.col("path"))))
    matcher.unpersist()
    votes = found.where("is_file AND folder IS NOT NULL").groupBy("folder", "own").agg(F.count(F.lit(1)).alias("n"))
    licensed = votes.groupBy("folder").agg(F.min(F.struct(-F.col("n"), "own")).alias("m")).select("folder", F.col("m.own").alias("license"))
    placed = found.where("folder IS NOT NULL")
    files_in = placed.groupBy("folder").agg(F.count(F.lit(1)).alias("rows"))
    near = inherited(files_in.select("folder"), licensed).join(files_in, "folder")
    out = join_hot(placed.withColumn("_file", F.monotonically_increasing_id()), near, "folder", "rows", placed.count(), "_file")
    out = out.unionByName(found.where("folder IS NULL"), allowMissingColumns=True)
    licence = F.coalesce("own", "inherited")
    return out.select("id", "path", "own", "score", "is_file", licence.alias("license"), F.when(F.col("own").isNull(), F.col("inherited_from")).alias("inherited_from"))
