"""Catalog snapshots: every write is a new version, made current by a commit file.

A write goes to a folder of its own, so an attempt that died is never in the way of the next.
The commit file of a version is created, not overwritten: of two writers one wins, and the
other fails with nothing lost. It names the folder and the schema, so a version without a
single row can be read.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_system(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _commits(spark: SparkSession, root: str) -> list[int]:
    """Versions that have a whole commit file, oldest first."""
    fs, folder = file_system(spark, f"{root}/commits")
    if not fs.exists(folder):
        return []
    names = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n, size in names if n.endswith(".json") and size)


def commit_path(root: str, version: int) -> str:
    return f"{root}/commits/{version:020d}.json"


def current_version(spark: SparkSession, root: str) -> int:
    """Latest committed version; 0 before the first."""
    return max(_commits(spark, root), default=0)


def commit(spark: SparkSession, root: str, version: int, text: str) -> bool:
    """Make a version current by creating its commit file; False if another writer has it."""
    fs, path = file_system(spark, commit_path(root, version))
    if fs.exists(path):
        if fs.getFileStatus(path).getLen():
            return False
        fs.delete(path, False)  # of a writer that died between creating and filling it
    try:
        out = fs.create(path, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def write_snapshot(table: DataFrame, root: str) -> int:
    """Write the table as the next version, then commit it. Readers of the version before are
    not disturbed, and a job that dies leaves no current version half written.

    Rows are laid out by track and time within local years, so time filters prune folders and
    row groups, and a track with a third of all rows spreads over many files.
    """
    spark = table.sparkSession
    version = current_version(spark, root) + 1
    folder = f"v{version}-{uuid.uuid4().hex}"
    rows = table
    if "local_date" in table.columns:
        rows = rows.withColumn("local_year", F.year("local_date"))
    order = [c for c in ("local_year", "track_id", "taken_at", "cell_id") if c in rows.columns]
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.write
    if "local_year" in rows.columns:
        writer = writer.partitionBy("local_year")
    writer.parquet(f"{root}/{folder}")
    text = json.dumps({"version": version, "folder": folder, "schema": table.schema.jsonValue()})
    if not commit(spark, root, version, text):
        raise FileExistsError(f"version {version} of {root} is another writer's")
    return version


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current (or a given) version."""
    chosen = current_version(spark, root) if version is None else version
    text = spark.read.text(commit_path(root, chosen), wholetext=True).first()[0]
    found = json.loads(text)
    schema = StructType.fromJson(found["schema"])
    return spark.read.schema(schema).parquet(f"{root}/{found['folder']}").select(*schema.fieldNames())
