"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Instants are UTC everywhere; local days are derived explicitly.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join side with a hot key is split even where the next step groups by the
    # same key; the extra exchange costs less than one task with a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Texts and paths take ten times their compressed size in a task: pieces small enough that
    # neither the sorts of a task nor its shuffle buffers spill, however large the tables.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "16m",
    # Written stages hold texts and paths: fewer bytes on the shared folder for about the same time.
    "spark.sql.parquet.compression.codec": "zstd",
    # Many folders are listed by this many tasks instead of one task a folder (10 000 at most).
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM only interprets a method of more bytes than this, ten times slower than compiled code;
    # such a step runs as smaller methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan here relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in
    ``spark.checkpoint.dir``. Only where that is unset, and driver and executors are one
    process, a local one is made."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        base = spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tripline-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path of its own under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: While a stage is written, its shuffle files go as soon as the statement has ended.
_DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Instants are plain longs.
_LONGS = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}
#: Paths, names and hashes are hardly twice in a file: a dictionary of them is built and thrown away.
NO_DICTIONARIES = {"parquet.enable.dictionary": "false"}
#: The stages of an ingest are such.
PLAIN_STAGES = {"sidecars", "cues", "names", "exact", "met", "settled", "rows", "changes"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session has ``values`` for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def write_stage(df: DataFrame, path: str, plain: bool = False) -> None:
    """Write ``df`` for later steps. ``plain``: most of it are paths, names, hashes and instants."""
    with settings(df.sparkSession, _DROP_SHUFFLES | (_LONGS if plain else {})):
        df.write.options(**(NO_DICTIONARIES if plain else {})).parquet(path)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives
    lost executors, and gives every later reader the very same rows. Its shuffle files go
    once it is written; nothing reads them again."""
    path = scratch_path(df.sparkSession, label)
    write_stage(df, path, label in PLAIN_STAGES)
    stage = df.sparkSession.read.schema(df.schema).parquet(path)
    stage.stage_path = path
    return stage


def discard(*stages: DataFrame) -> None:
    """Delete materialized stages once everything that reads them has been written itself."""
    for stage in stages:
        spark = stage.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage.stage_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
