"""Whole licences and inheritance along paths."""

import random

import pytest

from rivulet.llm import licenses
from rivulet.llm.common import Tables


@pytest.fixture(scope="module")
def matcher():
    return licenses.Matcher({"the": 900, "of": 500, "to": 500, "and": 500, "a": 400}, 2000)


TEXTS = licenses.full_texts()


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_whole_texts_name_themselves(matcher, name):
    holder = "Copyright (c) 2021 The Authors of Something.\n\n"
    for text in (TEXTS[name], holder + TEXTS[name], TEXTS[name].replace("\n", " ")):
        own, score, is_file = matcher.scan([text])[0]
        assert (own, is_file) == (name, True) and score > 0.9


def regents(text):
    return "Copyright (c) The Regents of the University of California.\nAll rights reserved.\n\n" + text.replace("COPYRIGHT HOLDERS", "REGENTS").replace("COPYRIGHT HOLDER", "REGENTS").replace("copyright holder", "University")


def test_siblings(matcher):
    gpl, bsd = TEXTS["GPL-3.0"], TEXTS["BSD-3-Clause"]
    third = bsd[bsd.index("3. Neither") : bsd.index("THIS SOFTWARE")]
    cases = {
        gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General", "GNU Affero General"): "AGPL-3.0",
        gpl.replace("GENERAL PUBLIC", "LESSER GENERAL PUBLIC").replace("General Public", "Lesser General Public"): "LGPL-3.0",
        gpl.replace("Version 3, 29 June 2007", "Version 2, June 1991"): "GPL-2.0",
        bsd.replace(third, ""): "BSD-2-Clause",
        regents(bsd): "BSD-3-Clause",
        regents(bsd.replace(third, "")): "BSD-2-Clause",
        TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE IS", third + "THIS SOFTWARE IS"): "BSD-3-Clause",
        TEXTS["Apache-2.0"].replace("Version 2.0, January 2004", "Version 1.1, January 2000"): "Apache-1.1",
        TEXTS["MPL-2.0"].replace("Version 2.0", "Version 1.1", 1): "MPL-1.1",
    }
    got = [x[0] for x in matcher.scan(list(cases))]
    assert got == list(cases.values())


def plain(files):
    """The licence of each file's folder or nearest ancestor folder, walking up."""
    votes = {}
    for path, licence in files:
        if path is not None and licence:
            votes.setdefault(folder(path), []).append(licence)
    best = {f: min(set(v), key=lambda x: (-v.count(x), x)) for f, v in votes.items()}
    out = []
    for path, licence in files:
        at, found = None if path is None else folder(path), None
        while at is not None and found is None:
            found = best.get(at)
            at = None if at in ("", "/") else folder(at)
        out.append((path, licence or found))
    return sorted(out, key=str)


def folder(path):
    head, cut, _ = path.rpartition("/")
    return "/" if cut and not head else head


def test_inheritance_against_walking_up(spark):
    rnd = random.Random(4)
    notice = {"MIT": "SPDX-License-Identifier: MIT", "MPL-2.0": "SPDX-License-Identifier: MPL-2.0", None: "nothing of the kind is said here"}
    paths = ["x.txt", "sub/y.txt", "sub/deep/er/z.txt", "/x.txt", "/abs/z.txt", "/abs/a/b.txt", "other/q.txt", None, "noslash"]
    for _ in range(120):
        paths.append(rnd.choice(["", "/"]) + "/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) + ".txt")
    for licensed in (["LICENSE"], ["/LICENSE"], ["sub/LICENSE", "/abs/LICENSE"], ["a/LICENSE", "a/b/LICENSE", "/a/LICENSE", "LICENSE"]):
        files = [(p, None) for p in paths] + [(p, rnd.choice(["MIT", "MPL-2.0"])) for p in licensed] + [("a/b/NOTICE", "MIT")]
        rows = [(i, p, notice[n]) for i, (p, n) in enumerate(files)]
        with Tables() as own:
            got = licenses.license_scan(spark.createDataFrame(rows, "id long, path string, text string")).select("path", "license").collect()
        own.release(spark)
        assert sorted(map(tuple, got), key=str) == plain(files)


def test_a_hot_folder_and_a_hot_root(spark):
    rows = [(i, f"all/{'here' if i % 2 else i}/{i}.txt", "no such words") for i in range(600)] + [(-1, "all/LICENSE", "SPDX-License-Identifier: MIT")]
    with Tables() as own:
        got = licenses.license_scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()
    own.release(spark)
    assert len(got) == 601 and {r["license"] for r in got} == {"MIT"} and {r["inherited_from"] for r in got} == {"all", None}
