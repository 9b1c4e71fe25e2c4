"""Ledger of sealed data versions: an entry is added only if no one else has added one meanwhile.

Each entry is a small file of its own, numbered without gaps. To seal, all entries are read, the rules
are checked against them, and the next file is created only if it isn't there yet; who loses reads
again and checks again. So of two jobs that seal at once one wins, and the other sees what it sealed.
Needs a file system on which a rename to an existing name fails (or hard links, for a mounted folder).
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.operators import lifecycle as L
from trafficwarden.sources.readers import read_ledger

ENTRY = "n long, kind string, version string, parent string, bump string, label_space array<string>, n_rows long, content_hash string, reason string, partitions map<string,long>, golden_hash string, protected boolean, created_at string"


def _fresh(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _linked(path: str, text: str) -> bool:
    """Create a whole file on a mounted folder, unless it is there."""
    folder = os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    try:
        with open(part, "x") as f:
            f.write(text)
        os.link(part, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(part)


def _renamed(spark: SparkSession, path: str, text: str) -> bool:
    """Create a whole file on any file system of Spark's, unless it is there."""
    target, fs = _fresh(spark, path)
    fs.mkdirs(target.getParent())
    part = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(part, target, none)
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(part, False)


class VersionLedger:
    """Data versions under a folder that all jobs share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def entries(self) -> DataFrame:
        """All entries, a row for each seal and removal."""
        return read_ledger(self.spark, self.root, ENTRY)

    def versions(self) -> DataFrame:
        """Sealed versions that haven't been removed."""
        rows = self.entries()
        gone = rows.filter("kind = 'remove'").select("version")
        return rows.filter("kind = 'seal'").join(gone, "version", "left_anti")

    def _added(self, entry: dict) -> bool:
        """Whether the entry could be added under its number."""
        path = f"{self.root}/{entry['n']:08d}.json"
        target, fs = _fresh(self.spark, path)
        text = json.dumps(entry | {"created_at": datetime.now(timezone.utc).isoformat()}) + "\n"
        mounted = fs.getUri().getScheme() == "file"
        return _linked(target.toUri().getPath(), text) if mounted else _renamed(self.spark, path, text)

    def _next(self) -> int:
        return (self.entries().agg(F.max("n")).first()[0] or 0) + 1

    def seal(
        self, label_space: list[str], n_rows: int, content_hash: str, parent: str | None = None, reason: str = "",
        partitions: dict[str, int] | None = None, golden_hash: str | None = None, protected: bool = False,
    ) -> dict:
        """The new version: 1.0 for the first; new labels raise the major number, other changes the minor one.

        The parent is the latest version unless given. ValueError where the content is sealed already,
        the parent is unknown, or the version that follows it exists (another job was first).
        """
        while True:
            number, versions = self._next(), self.versions()  # the number first: what comes after it makes us try again
            latest = L.latest_version(versions).first()
            of = parent or (latest.version if latest and latest.version else None)
            candidate = self.spark.createDataFrame([(of, label_space, content_hash)], "parent string, label_space array<string>, content_hash string")
            found = L.seal(versions, candidate).first()
            if found.error:
                raise ValueError(f"{found.error}: {content_hash if 'content' in found.error else of}")
            if versions.filter(F.col("version") == found.version).count():
                raise ValueError(f"version exists: {found.version}")
            entry = {"n": number, "kind": "seal", "version": found.version, "parent": of, "bump": found.bump, "label_space": sorted(label_space), "n_rows": n_rows, "content_hash": content_hash, "reason": reason, "partitions": partitions or {}, "golden_hash": golden_hash, "protected": protected}
            if self._added(entry):
                return entry

    def remove(self, version: str) -> None:
        """Take a version out. ValueError where it is unknown or protected."""
        while True:
            number = self._next()
            error = L.removable(self.versions(), self.spark.createDataFrame([(version,)], "version string")).first().error
            if error:
                raise ValueError(f"{error}: {version}")
            if self._added({"n": number, "kind": "remove", "version": version}):
                return

    def with_content(self, content_hash: str) -> dict | None:
        """The version of this content, if it is sealed."""
        found = self.versions().filter(F.col("content_hash") == content_hash).limit(1).collect()
        return found[0].asDict() if found else None
