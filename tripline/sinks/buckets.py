"""A keyed catalog in hash buckets, of which a merge rewrites only those that it touches.

Rows are dealt to a fixed number of buckets by a hash of their key, so a track with a third of all
rows is in all of them alike. A version is a manifest: the files of each bucket. A merge reads the
buckets that hold keys of the changes, writes them anew into a folder of its own, and commits a
manifest that names the new files for those and the old files for all others. Files that no
manifest names do not exist for readers, so a job that dies leaves nothing behind but bytes.

Of two writers the one that comes second finds the version taken. If the other one changed
other buckets, its manifest is taken as the new base and only the commit is repeated; otherwise
the second fails with nothing lost, to be run again on the new version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripline.operators.resolve import KEY
from tripline.operators.upsert import upsert_media
from tripline.session import NO_DICTIONARIES, discard, materialize, settings
from tripline.sinks.catalog import commit, commit_path, current_version, file_system

BUCKETS = 256
#: Rows of one file; a bucket of more has several.
FILE_ROWS = 5_000_000
#: Rows are in this order inside a file, so that row groups can be skipped.
ORDER = ("track_id", "taken_at")
#: Sides that are dealt by a part of the join's key are not exchanged by all of it.
_MEET_IN_BUCKETS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


class WriteConflict(RuntimeError):
    """Another writer has changed the same buckets since this one read them."""


@dataclass
class Manifest:
    version: int
    key: list[str]
    buckets: int
    schema: StructType
    #: Paths below the root, by bucket; buckets without rows have none.
    files: dict[int, list[str]]

    def text(self) -> str:
        files = {str(b): paths for b, paths in sorted(self.files.items()) if paths}
        return json.dumps({"version": self.version, "key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(), "files": files})


def load(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The manifest of the current (or a given) version."""
    chosen = current_version(spark, root) if version is None else version
    found = json.loads(spark.read.text(commit_path(root, chosen), wholetext=True).first()[0])
    files = {int(b): paths for b, paths in found["files"].items()}
    return Manifest(chosen, found["key"], found["buckets"], StructType.fromJson(found["schema"]), files)


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, manifest: Manifest, only: Sequence[int] | None = None) -> DataFrame:
    chosen = manifest.files if only is None else {b: manifest.files.get(b, []) for b in only}
    paths = [f"{root}/{p}" for files in chosen.values() for p in files]
    if not paths:
        return spark.createDataFrame([], manifest.schema)
    return spark.read.schema(manifest.schema).parquet(*paths)


def read_catalog(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current (or a given) version."""
    return _read(spark, root, load(spark, root, version))


def _dealt(rows: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", bucket_of(key, buckets)).repartition("_bucket")


def _write(dealt: DataFrame, root: str) -> dict[int, list[str]]:
    """Files of a new folder, by bucket."""
    spark, folder = dealt.sparkSession, f"data/{uuid.uuid4().hex}"
    order = [c for c in ORDER if c in dealt.columns]
    dealt.sortWithinPartitions("_bucket", *order).write.options(maxRecordsPerFile=FILE_ROWS, **NO_DICTIONARIES).partitionBy("_bucket").parquet(f"{root}/{folder}")
    fs, path = file_system(spark, f"{root}/{folder}")
    out: dict[int, list[str]] = {}
    for part in fs.listStatus(path):
        name = part.getPath().getName()
        if name.startswith("_bucket="):
            files = sorted(f.getPath().getName() for f in fs.listStatus(part.getPath()))
            out[int(name.split("=")[1])] = [f"{folder}/{name}/{f}" for f in files if f.endswith(".parquet")]
    return out


def create_catalog(table: DataFrame, root: str, key: Sequence[str] = KEY, buckets: int = BUCKETS) -> int:
    """The first version. ``table`` is unique in ``key``."""
    files = _write(_dealt(table, key, buckets), root)
    made = Manifest(1, list(key), buckets, table.schema, files)
    if not commit(table.sparkSession, root, 1, made.text()):
        raise WriteConflict(f"{root} has a first version already")
    return 1


def merge_catalog(
    changes: DataFrame, root: str, now: Column | None = None, apply: Callable = upsert_media, base: Manifest | None = None
) -> int:
    """Insert or overwrite by key; returns the version that holds the changes. Changes without a
    row make no version. ``apply(current, changes, now, key)`` gives the new rows of a bucket, whose number
    is the first column of the key.
    ``base``: what the changes were made from, if that is not the current version."""
    spark = changes.sparkSession
    base = load(spark, root) if base is None else base
    changes = materialize(changes, "changes")
    # One number for each bucket at most.
    touched = sorted(r[0] for r in changes.select(bucket_of(base.key, base.buckets)).distinct().collect())
    if not touched:
        discard(changes)
        return base.version
    # Both sides are dealt to their buckets, where they meet and are written: one exchange of each.
    old, new = (_dealt(rows, base.key, base.buckets) for rows in (_read(spark, root, base, touched), changes))
    with settings(spark, _MEET_IN_BUCKETS):
        files = _write(apply(old, new, now, ["_bucket", *base.key]), root)
    discard(changes)
    latest = base
    while True:
        kept = {b: paths for b, paths in latest.files.items() if b not in set(touched)}
        made = Manifest(latest.version + 1, base.key, base.buckets, base.schema, kept | files)
        if commit(spark, root, made.version, made.text()):
            return made.version
        latest = load(spark, root, made.version)
        if any(latest.files.get(b) != base.files.get(b) for b in touched):
            raise WriteConflict(f"version {made.version} of {root} has changed the same buckets")
