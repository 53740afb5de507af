"""Folders that are replaced as a whole: written beside their place, then renamed. Readers meet the old content or the new
one, never half of either, and never none."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _left(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Folders beside path that a writer has left; their names begin with a dot, so that no reader lists them."""
    fs, p = _at(spark, path)
    parent = p.getParent()
    if not fs.exists(parent):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(parent) if s.getPath().getName().startswith(f".{kind}-{p.getName()}-"))


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    if not fs.rename(p, _at(spark, new)[1]):
        raise OSError(f"can't rename {old} to {new}")


def resolve(spark: SparkSession, path: str) -> str | None:
    """Where path's content is: there, or in the folder that a writer had moved away when it stopped; None if nowhere."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return path
    old = _left(spark, path, "replaced")
    return old[0] if old else None


def recover(spark: SparkSession, path: str) -> None:
    """Puts back what a writer that stopped had moved away, and removes what it had begun. For writers: a folder has one."""
    fs, p = _at(spark, path)
    for old in _left(spark, path, "replaced"):
        if not fs.exists(p):
            _rename(spark, old, path)
    for kind in ("replaced", "staged"):
        for rest in _left(spark, path, kind):
            fs.delete(_at(spark, rest)[1], True)


def replace(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], None] | None = None) -> None:
    """write puts the content into a folder that it is given; once that, and check of it, is done, the folder takes path's
    name. Whatever stops it before leaves path as it was. Renames of folders need to be whole, as those of HDFS and local
    disks are; a store of objects alone needs a table with a log instead."""
    recover(spark, path)
    fs, p = _at(spark, path)
    mark = uuid.uuid4().hex
    staged, away = (f"{p.getParent()}/.{kind}-{p.getName()}-{mark}" for kind in ("staged", "replaced"))
    try:
        write(staged)
        if check:
            check(staged)
    except BaseException:
        fs.delete(_at(spark, staged)[1], True)
        raise
    fs.mkdirs(p.getParent())
    if fs.exists(p):
        _rename(spark, path, away)
    _rename(spark, staged, path)
    fs.delete(_at(spark, away)[1], True)
