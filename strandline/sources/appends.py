"""Appends to text targets: parts are staged, moved in, and committed by a small manifest that knows header and next id.

``<target>/_commits/<number>.json`` stands for one finished write; readers pass over names with an underscore.  Parts of an append
are named by its number, so those that an unfinished one left behind are known, and the next append takes them away first.  One
writer at a time appends to a target.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Commit:
    """What a target holds after write ``number``: the id that its next gene gets, and whether there is a header."""

    number: int
    next_gene_id: int = 1
    header: bool = False


def _fs(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _fs(spark, name)
    return fs.exists(path)


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def last_commit(spark: SparkSession, target: str, before: int | None = None) -> Commit | None:
    """The latest commit (of a number below ``before``); None for a target without any."""
    numbers = [int(n.removesuffix(".json")) for n in _names(spark, f"{target}/_commits") if n.endswith(".json")]
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return None
    text = spark.read.text(f"{target}/_commits/{max(numbers):09d}.json").first()[0]
    return Commit(**json.loads(text))


def commit(spark: SparkSession, target: str, made: Commit) -> None:
    """Puts a manifest in place by a rename, in place of one of that number."""
    staged, fs = _fs(spark, f"{target}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    final, _ = _fs(spark, f"{target}/_commits/{made.number:09d}.json")
    fs.delete(final, False)
    if not fs.rename(staged, final):
        raise OSError(f"cannot commit {final}")


def _prefix(number: int) -> str:
    return f"part-a{number:09d}-"


def recover(spark: SparkSession, target: str) -> None:
    """Takes away staged folders and the parts of appends that were not committed."""
    last = last_commit(spark, target)
    done = last.number if last else 0
    for name in _names(spark, target):
        unfinished = name.startswith("part-a") and name[6:15].isdigit() and int(name[6:15]) > done
        if unfinished or name.startswith("_staged-"):
            path, fs = _fs(spark, f"{target}/{name}")
            fs.delete(path, True)


def append_text(rows: DataFrame, target: str, column: str = "line", order: tuple[str, ...] = (), gzip: bool = False, next_gene_id: int = 1, header: bool = False) -> Commit:
    """Adds the lines of ``rows`` to a target, which need not exist, and commits them.  If that fails, nothing of them stays."""
    spark = rows.sparkSession
    recover(spark, target)
    last = last_commit(spark, target)
    made = Commit(last.number + 1 if last else 1, next_gene_id, header)
    staged = f"{target}/_staged-{uuid.uuid4().hex}"
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    try:
        rows.select(column).write.option("compression", "gzip" if gzip else "none").text(staged)
        for k, name in enumerate(n for n in _names(spark, staged) if n.startswith("part-")):
            source, fs = _fs(spark, f"{staged}/{name}")
            final, _ = _fs(spark, f"{target}/{_prefix(made.number)}{k:05d}.{'txt.gz' if gzip else 'txt'}")
            if not fs.rename(source, final):
                raise OSError(f"cannot move {source}")
        commit(spark, target, made)
    finally:
        recover(spark, target)  # after a commit, the staged folder only
    return made
