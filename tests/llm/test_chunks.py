"""Content-defined chunks: cut where the bytes say so, in any script."""

import random
import re

from rivulet.llm import exact

PATTERN = re.compile(exact.chunk_pattern(64, 512))


def cut(raw):
    return [bytes.fromhex(m[0]) for m in PATTERN.finditer(raw.hex().upper())]


def plain(raw, least=64, most=512):
    begins = [i for i, x in enumerate(raw) if x & 0xC0 != 0x80]
    ends = {i: z for i, z in zip(begins, [*begins[1:], len(raw)])}
    out, at = [], 0
    while at < len(raw):
        z = min(len(raw), at + most)
        for i in range(at + least, at + most - 12 + 1):
            k, fine = i, True
            for want in (0, 1, 2):
                fine = fine and k in ends and raw[ends[k] - 1] & 3 == want
                k = ends.get(k, -1)
            if fine:
                z = k
                break
        out.append(raw[at:z])
        at = z
    return out


def texts():
    rnd = random.Random(1)
    yield from (b"", b"x", b"a" * 5000, ("".join(map(chr, range(1, 900))) * 9).encode())
    for letters in ("abcdefghij .,", "абвгдежзик ", "的一是在不了有和人这", "กขคงจฉช"):
        yield "".join(rnd.choice(letters) for _ in range(4000)).encode()


def test_chunks_by_a_plain_rule():
    for raw in texts():
        assert cut(raw) == plain(raw) and b"".join(cut(raw)) == raw


def test_most_chunks_outlive_an_insertion():
    for raw in list(texts())[4:]:
        old, new = cut(raw), cut(b"\x01\x02" + raw)
        assert len(old) > 10 and len(set(old) & set(new)) > 0.7 * len(old)


def test_recipes_in_spark(spark):
    rows = list(enumerate(t.decode("utf-8", "replace") for t in texts()))
    got = {r.doc_id: len(r.chunks) for r in exact.recipes(spark.createDataFrame(rows, "doc_id long, text string"), 64, 512).collect()}
    assert got == {k: len(plain(t.encode())) for k, t in rows}
