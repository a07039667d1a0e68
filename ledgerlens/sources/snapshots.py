"""Versioned snapshots of stored tables, switched by one manifest.

A root folder holds

- ``parts/<id>``: immutable Parquet folders, each written by one build;
- ``manifests/<version>.json``: the parts of every table of a version.

A build writes its parts first and publishes its manifest last, by renaming a
finished file to a version that must not exist yet. So readers see all tables of
a build or none, a build that dies leaves readers where they were, and of two
builds of one version the second fails. A reader is pinned to the version it
opened: its parts are not touched until ``expire`` lets go of the version.

A part of a table stored by day serves the days that the manifest gives it, so
days can be replaced by a new part without a rewrite of the others.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "_date"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class _Files:
    """The file system of a folder (any that Spark reads)."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, where: str):
        return self.jvm.org.apache.hadoop.fs.Path(where)

    def names(self, where: str) -> list[tuple[str, int]]:
        """(name, modification time in ms) of what lies in a folder; nothing if there is none."""
        if not self.fs.exists(self.path(where)):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.path(where))]

    def read(self, where: str) -> str:
        stream = self.fs.open(self.path(where))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, where: str, text: str) -> None:
        """Make a file appear as a whole; an error if it is there already."""
        draft = self.path(f"{where}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        how[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(draft, self.path(where), how)
        finally:
            self.fs.delete(draft, False)

    def delete(self, where: str) -> None:
        self.fs.delete(self.path(where), True)


@dataclass(frozen=True)
class Part:
    """A folder of a table: the days it serves (none: not stored by day), its schema (as
    JSON, so that an empty folder can be read) and its figures when it was written."""
    path: str
    days: tuple | None
    schema: str
    figures: dict = field(default_factory=dict)
    whole: bool = True                      # serves all that was written


def read_part(spark: SparkSession, root: str, part: Part) -> DataFrame:
    """The rows of the days that a part serves."""
    df = spark.read.schema(T.StructType.fromJson(json.loads(part.schema))).parquet(f"{root}/{part.path}")
    if part.days is None or part.whole:
        return df
    known = [F.lit(d).cast("date") for d in part.days if d is not None]
    keep = F.col(DAY).isin(*known) if known else F.lit(False)
    return df.where(keep | F.col(DAY).isNull() if None in part.days else keep)


@dataclass(frozen=True)
class Snapshot:
    """One version of the tables."""
    spark: SparkSession
    root: str
    version: int
    tables: dict[str, tuple[Part, ...]]

    def read(self, table: str) -> DataFrame:
        """The table's rows, with ``_date`` if it is stored by day: a part is pruned to its days before any file is opened."""
        frames = [read_part(self.spark, self.root, part) for part in self.tables[table]]
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def figures(self, table: str) -> list[dict] | None:
        """The figures taken while the table was written; none if a part serves only some of what it was written with."""
        return [p.figures for p in self.tables[table]] if all(p.whole for p in self.tables[table]) else None


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifests/{version:012d}.json"


def _versions(files: _Files, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n, _ in files.names(f"{root}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def open_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The given version, by default the last; none where no build has been finished."""
    root = root.rstrip("/")
    files = _Files(spark, root)
    version = version if version is not None else max(_versions(files, root), default=None)
    if version is None:
        return None
    tables = json.loads(files.read(_manifest(root, version)))["tables"]
    return Snapshot(spark, root, version, {
        name: tuple(Part(**{**p, "days": None if p["days"] is None else tuple(p["days"])}) for p in parts)
        for name, parts in tables.items()})


def new_part(spark: SparkSession, root: str) -> str:
    """A path, relative to the root, for a part to be written to."""
    return f"parts/{uuid.uuid4().hex}"


def days_of(spark: SparkSession, root: str, path: str) -> tuple | None:
    """The days of a written part by its folders; none if it is not stored by day."""
    found = [n.partition("=")[2] for n, _ in _Files(spark, root).names(f"{root.rstrip('/')}/{path}") if n.startswith(f"{DAY}=")]
    return tuple(sorted((None if d == _NO_DAY else d for d in found), key=str)) if found else None


def publish(spark: SparkSession, root: str, tables: dict[str, list[Part]], base: Snapshot | None = None) -> Snapshot:
    """Make a version of the tables, those of ``base`` that are not given included (a
    table given without parts is left out); an error if another build has published after ``base`` was opened."""
    root = root.rstrip("/")
    files = _Files(spark, root)
    version = base.version + 1 if base else max(_versions(files, root), default=0) + 1
    merged = {**(base.tables if base else {}), **{k: tuple(v) for k, v in tables.items()}}
    merged = {k: v for k, v in merged.items() if v}
    text = json.dumps({"version": version, "tables": {
        name: [asdict(p) for p in parts]
        for name, parts in merged.items()}})
    files.publish(_manifest(root, version), text)
    return Snapshot(spark, root, version, merged)


def replaced(parts: tuple[Part, ...], days: tuple, new: Part) -> list[Part]:
    """A table's parts with the given days served by a new one."""
    out = []
    for p in parts:
        if p.days is None:
            raise ValueError("a table that is not stored by day is replaced as a whole")
        left = tuple(d for d in p.days if d not in days)
        if left:
            out.append(replace(p, days=left, whole=p.whole and left == p.days))
    return out + [new]


def expire(spark: SparkSession, root: str, keep: int = 2, grace_seconds: float = 86_400) -> list[str]:
    """Let go of all but the last ``keep`` versions, and of parts that no version
    left names; parts younger than ``grace_seconds`` stay, as a build may be
    writing them. Returns the parts removed."""
    root = root.rstrip("/")
    files = _Files(spark, root)
    versions = _versions(files, root)
    for v in versions[:-keep] if keep else versions:
        files.delete(_manifest(root, v))
    used = {p.path for v in (versions[-keep:] if keep else []) for parts in open_snapshot(spark, root, v).tables.values() for p in parts}
    old = (time.time() - grace_seconds) * 1000
    gone = [f"parts/{n}" for n, at in files.names(f"{root}/parts") if f"parts/{n}" not in used and at <= old]
    for path in gone:
        files.delete(f"{root}/{path}")
    return gone
