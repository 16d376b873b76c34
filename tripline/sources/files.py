"""File listings, sidecar files and saved timeline documents."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions.text import directory_of, name_of, stem_of
from tripline.sources.sidecars import parse_sidecars


def source_uri(uri: str) -> str:
    """The URI the file systems of Spark know: ``s3://`` is served as ``s3a://``, the rest
    (``gs://``, ``hdfs://``, local paths) as is."""
    return "s3a://" + uri[len("s3://") :] if uri.startswith("s3://") else uri


def routed(uri: Column) -> Column:
    """``source_uri`` of a column, such as the addresses of an inventory or of a catalog."""
    return F.when(uri.startswith("s3://"), F.concat(F.lit("s3a://"), F.substring(uri, len("s3://") + 1, 1 << 30))).otherwise(uri)


def _decoded(path: Column) -> Column:
    """The plain path of a URL-encoded one; a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _relative(path: Column, root: str) -> Column:
    """Plain path below the root; the root itself may be reported with or without a scheme."""
    plain = F.regexp_replace(path, r"^[a-zA-Z0-9]+:/*", "/")
    start = "/" + source_uri(root).split(":", 1)[-1].strip("/") + "/"
    return F.when(plain.startswith(start), F.substring(plain, len(start) + 1, 1 << 30)).otherwise(
        name_of(plain)
    )


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file below the root: path, dir, name, size, mtime. Only the listing is used; the
    contents are pruned from the scan. Spark's own index leaves out names that begin with ``_``
    or ``.`` and what lies below such folders; those are listed by the file system and added.
    Both keep the listing on the driver: for billions of files use ``list_inventory``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(source_uri(root)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    hidden = _hidden_files(spark, source_uri(root), glob)
    if hidden:
        more = spark.createDataFrame(hidden, "path string, size long, ms long")
        rows = rows.unionByName(more.select("path", "size", F.timestamp_millis("ms").alias("mtime")))
    return _listing(rows, root)


def list_inventory(inventory: DataFrame, root: str) -> DataFrame:
    """The same from an inventory table (path, size, mtime), as object stores write them: no
    listing, no driver, any number of files."""
    start = source_uri(root).rstrip("/") + "/"
    return _listing(inventory.where(F.col("path").startswith(start)), root)


def _hidden_files(spark: SparkSession, root: str, glob: str | None) -> list[tuple[str, int, int]]:
    """(path, size, mtime in ms) of files whose name, or a folder of whose path, begins with
    ``_`` or ``.``. One look-up per depth; folders found are listed in depth."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, tuple[str, int, int]] = {}

    def keep(status) -> None:
        path = status.getPath()
        if glob is None or fnmatch.fnmatchcase(path.getName(), glob):
            found[path.toString()] = (path.toString(), status.getLen(), status.getModificationTime())

    # Characters of the root that a glob would read as its own.
    base = re.sub(r"([*?\[\]{}\\])", r"\\\1", root.rstrip("/"))
    while fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "/*")) or []:
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "/[_.]*")) or []:
            if status.isFile():
                keep(status)
                continue
            below = fs.listFiles(status.getPath(), True)
            while below.hasNext():
                keep(below.next())
        base += "/*"
    return list(found.values())


def _listing(rows: DataFrame, root: str) -> DataFrame:
    return rows.withColumn("path", _relative(F.col("path"), root)).select(
        "path", directory_of(F.col("path")).alias("dir"), name_of(F.col("path")).alias("name"),
        "size", "mtime",
    )


def _texts(spark: SparkSession, root: str, glob: str, whole: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.text(source_uri(root), wholetext=whole).withColumn(
        "path", _relative(_decoded(F.col("_metadata.file_path")), root)
    )


def read_sidecar_documents(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """Sidecar texts below the root: path, dir, name, json. One document per file, or, where
    ``packed``, one per line as {"path": ..., "json": ...} with the path that the document had
    (small files are costly to list and open by the billion; and Spark's readers do not open
    files whose name begins with ``_`` or ``.``, which packing keeps)."""
    docs = _texts(spark, root, "*.json" if not packed else "*", whole=not packed)
    if packed:
        docs = docs.select(F.from_json("value", "path string, json string").alias("p")).select("p.path", F.col("p.json").alias("value"))
    return docs.select("path", F.col("value").alias("json")).select(
        "path", directory_of(F.col("path")).alias("dir"), name_of(F.col("path")).alias("name"),
        "json",
    )


def pack_sidecars(documents: DataFrame) -> DataFrame:
    """Documents (path, json) as the lines that ``packed`` readers take."""
    return documents.select(F.to_json(F.struct("path", "json")).alias("value"))


def read_sidecars(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """Typed sidecars; what cannot be parsed is there with ``valid`` = false."""
    return parse_sidecars(read_sidecar_documents(spark, root, packed))


KNOBS_DDL = (
    "struct<start:string,end:string,level:string,region:array<string>,merge_km:double,"
    "min_hours:double>"
)
_HEADER_DDL = (
    f"id string, title string, prompts array<string>, generated_at string, build {KNOBS_DDL}"
)


def _overview(docs: DataFrame) -> DataFrame:
    return docs.select(
        "id",
        F.coalesce("title", "id").alias("title"),
        F.coalesce("generated_at", F.lit("")).alias("generated_at"),
        "stay_count",
        "build",
    )


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Saved documents of one JSON file each: id (the file stem), title, generated_at,
    stay_count, build. Unreadable files are left out."""
    docs = _texts(spark, root, "*.json", whole=True)
    doc = F.col("_doc")
    parsed = docs.withColumn("_doc", F.try_parse_json("value")).where(
        F.schema_of_variant(doc).startswith("OBJECT")
    )
    stays = F.try_variant_get(doc, "$.stays", "array<variant>")
    return _overview(
        parsed.select(
            stem_of(name_of(F.col("path"))).alias("id"),
            F.try_variant_get(doc, "$.title", "string").alias("title"),
            F.try_variant_get(doc, "$.generated_at", "string").alias("generated_at"),
            F.coalesce(F.size(stays), F.lit(0)).cast("long").alias("stay_count"),
            F.try_variant_get(doc, "$.build", KNOBS_DDL).alias("build"),
        )
    )


def read_document_lines(spark: SparkSession, root: str, by: str = "timeline_id") -> DataFrame:
    """The same of documents written as lines (``sinks.export.write_timelines``), by any number of
    tasks: the head line is parsed, the stay lines are counted."""
    lines = spark.read.parquet(source_uri(root)).select(by, F.col("line").alias("value"))
    is_head = F.col("value").startswith('{"id":')
    head = F.from_json(F.regexp_replace("value", r',"stays":\[$', "}"), _HEADER_DDL)
    found = lines.groupBy(F.col(by).cast("string").alias("id")).agg(
        F.max_by("value", F.when(is_head, 1)).alias("value"),
        F.count_if(F.col("value").rlike(r'^,?\{"label":')).alias("stay_count"),
    )
    return _overview(found.withColumn("_h", head).select(
        "id", "_h.title", "_h.generated_at", "stay_count", "_h.build"
    ))


def scan_timelines(documents: DataFrame) -> DataFrame:
    """Saved timelines, newest first."""
    return documents.drop("build").orderBy(F.desc("generated_at"), "id")


def load_knobs(documents: DataFrame) -> DataFrame:
    """Stored knobs with id and title; documents without knobs are left out."""
    return documents.where(F.col("build").isNotNull()).select("id", "title", "build.*")
