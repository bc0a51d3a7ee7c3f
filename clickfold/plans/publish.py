"""Replacing what an earlier run wrote (``SELECT ... INTO`` over a dropped table), without a moment in between.

Every run writes a new version folder ``v<number>`` below a root and marks it complete when all of it is
there; readers take the highest complete version. Older versions go after the mark, so two runs leave one
copy, and a run that fails leaves the earlier version as it was. Marking is one file creation, which is
atomic on HDFS and on object stores alike; no rename is needed. One run at a time may write below a root.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

COMPLETE = "_COMPLETE"


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> dict[int, bool]:
    """Number of every version below ``root``, and whether it is complete."""
    path, files = _files(spark, root)
    if not files.exists(path(root)):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(path(root)) if s.isDirectory()]
    numbers = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)]
    return {n: files.exists(path(f"{version_path(root, n)}/{COMPLETE}")) for n in numbers}


def version_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/v{number:08d}"


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the highest complete version below ``root``; None if there is none."""
    complete = [n for n, done in _versions(spark, root).items() if done]
    return version_path(root, max(complete)) if complete else None


def publish(spark: SparkSession, root: str, write: Callable[[str], object]):
    """Run ``write(folder)`` for a new version of ``root`` and return its result; older versions go once it
    is complete. If ``write`` fails, its folder goes and the earlier version stays."""
    path, files = _files(spark, root)
    older = _versions(spark, root)
    folder = version_path(root, max(older, default=0) + 1)
    try:
        result = write(folder)
    except BaseException:
        files.delete(path(folder), True)
        raise
    files.create(path(f"{folder}/{COMPLETE}")).close()
    for number in older:
        files.delete(path(version_path(root, number)), True)
    return result
