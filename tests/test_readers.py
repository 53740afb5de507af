"""Lines of large files, read in many splits."""

import json

from rivulet.sources.events import read_events, read_lines


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """About 13 MB: 200,000 lines, blank ones, \\r\\n and letters of several bytes, in splits of 64 KB."""
    lines = ["" if i % 1000 == 7 else f"{i} zeile ü {'x' * (i % 90)}" + ("\r" if i % 3 == 0 else "") for i in range(200_000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name == "a" else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        df = read_lines(spark, str(tmp_path / "*.jsonl"))
        rows = df.collect()
        splits = spark.read.text(str(tmp_path / "*.jsonl")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 100
    for name in ("a", "b"):
        got = {r.ingestion_order: r.raw_record for r in rows if r.source_file.endswith(f"{name}.jsonl")}
        assert got == {i: x.rstrip("\r") for i, x in enumerate(lines) if x}


def test_what_stands_behind_the_object_is_malformed(spark, tmp_path):
    good, bad = json.dumps({"event_id": "e", "payload": {"a": [1, {"b": "}"}]}}), []
    for tail in ("}", "]", ",", ', "k": 1', "],[1", "},{", " {}", " x", ",null", '}, {"x": 1'):
        bad.append(good + tail)
    bad += ["", "[" + good + "]", "1", "null", '"x"', '{"a": 1, "a": 2}', '{"a": NaN}', "{"]
    (tmp_path / "x.jsonl").write_text("\n".join([good, good + " ", " " + good, *bad]))
    rows = read_events(spark, str(tmp_path / "x.jsonl")).orderBy("ingestion_order").collect()
    assert [r.malformed for r in rows] == [False] * 3 + [True] * (len(bad) - 1)
    assert [r.event_id for r in rows[:3]] == ["e"] * 3
