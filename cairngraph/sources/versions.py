"""A store of tables in immutable versions.

A version is a set of folders that no later write touches, and one small file
that names them, written last. Readers see the version whose file they read, or
an older one, but never part of a write; a write that fails leaves folders that
no version names. A version may hold some owners' rows alone (the files that a
partial build has made anew) and take all others from the one before it.

    root/data/<random>/<table>/   rows of one write
    root/versions/<number>.json   {"tables": {name: [segment, ...]}, "note": ...}

A segment is ``{"rows": folder, "owners": folder or None}``: rows of earlier
segments go whose owner is listed, or all if none are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a table that are read together; a write beyond them stores the whole table.
SEGMENTS = 8


def _files(spark: SparkSession, path: str):
    """The path in the file system it belongs to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    at, fs = _files(spark, f"{root}/versions")
    if not fs.exists(at):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _told(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{number}.json", wholetext=True).first()[0])


def note(spark: SparkSession, root: str, number: int | None = None) -> str | None:
    """What the version's writer noted."""
    known = versions(spark, root)
    return _told(spark, root, known[-1] if number is None else number)["note"] if known else None


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table of the newest version, or of the one given."""
    known = versions(spark, root)
    if not known or (number is not None and number not in known):
        raise ValueError(f"no version {number} at {root}" if known else f"no version at {root}")
    return _joined(spark, _told(spark, root, known[-1] if number is None else number)["tables"][name])


def _joined(spark: SparkSession, segments: list[dict]) -> DataFrame:
    out = spark.read.parquet(segments[0]["rows"])
    for s in segments[1:]:
        gone = spark.read.parquet(s["owners"]).select(F.col("owner").alias("_owner"))
        kept = out.join(gone, out[s["by"]].eqNullSafe(gone["_owner"]), "left_anti")
        out = kept.unionByName(spark.read.parquet(s["rows"]))
    return out


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], owners: dict[str, DataFrame] | None = None, by: str = "file", told: str | None = None, after: int | None = None) -> int:
    """Store tables as the next version and give its number.

    With ``owners`` a table replaces the rows of the owners(by) listed for it
    and keeps all others of the version before; tables that are not named stay
    as they are. ``after`` is the version that the writer has read: another
    one published meanwhile is an error, and nothing is lost or mixed.
    """
    known = versions(spark, root)
    last = known[-1] if known else 0
    if after is not None and after != last:
        raise RuntimeError(f"version {last} was published after {after}")
    held = _told(spark, root, last)["tables"] if last else {}
    folder = f"{root}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        rows = f"{folder}/{name}"
        only = (owners or {}).get(name)
        if only is None or name not in held:
            df.write.parquet(rows)
            held[name] = [{"rows": rows, "owners": None, "by": by}]
            continue
        df.write.parquet(rows)
        only.select(F.col(by).alias("owner")).distinct().write.parquet(f"{folder}/{name}-owners")
        held[name] = [*held[name], {"rows": rows, "owners": f"{folder}/{name}-owners", "by": by}]
        if len(held[name]) > SEGMENTS:
            _joined(spark, held[name]).write.parquet(f"{folder}/{name}-whole")
            held[name] = [{"rows": f"{folder}/{name}-whole", "owners": None, "by": by}]
    at, fs = _files(spark, f"{root}/versions/{last + 1}.json")
    text = json.dumps({"tables": held, "note": told})
    draft, _ = _files(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise RuntimeError(f"version {last + 1} was published meanwhile")
    return last + 1


def forget(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Drop all versions but the newest ``keep``, and the folders that none of those names; how many versions.

    Readers of a dropped version fail; folders of a write that has not been
    published yet are dropped too, so nothing should be writing.
    """
    known = versions(spark, root)
    gone, kept = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
    for number in gone:
        at, fs = _files(spark, f"{root}/versions/{number}.json")
        fs.delete(at, False)
    used = {folder for n in kept for segments in _told(spark, root, n)["tables"].values() for s in segments for folder in (s["rows"], s["owners"]) if folder}
    at, fs = _files(spark, f"{root}/data")
    for write in fs.listStatus(at) if fs.exists(at) else ():
        for table in fs.listStatus(write.getPath()):
            name = f"{root}/data/{write.getPath().getName()}/{table.getPath().getName()}"
            if name not in used:
                fs.delete(table.getPath(), True)
    return len(gone)
