"""Ingest listings as they land: the incremental ingest, run per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tripline.operators import resolve
from tripline.plans.ingest import ingest
from tripline.session import tune
from tripline.sinks.buckets import create_catalog, merge_catalog, read_catalog
from tripline.sinks.catalog import current_version


def ingest_stream(
    listings: DataFrame,
    documents: DataFrame,
    exif: DataFrame,
    tz_cells: DataFrame,
    catalog_root: str,
    checkpoint: str,
    **options,
) -> StreamingQuery:
    """``listings`` is a stream of listing rows, whole folders at a time, since a sidecar is
    looked for among the files next to it. A batch with changes becomes the next catalog version,
    of which only the buckets of its keys are written. A batch that is run twice changes
    nothing: its files are unchanged and skipped."""

    def run(batch: DataFrame, _epoch: int) -> None:
        spark = tune(batch.sparkSession)
        if not current_version(spark, catalog_root):
            create_catalog(spark.createDataFrame([], resolve.CATALOG_DDL), catalog_root)
        here = documents.join(batch.select("track_id", "path").distinct(), ["track_id", "path"], "left_semi")
        result = ingest(batch, here, exif, tz_cells, read_catalog(spark, catalog_root), **options)
        merge_catalog(result.changes, catalog_root, options.get("now"))

    return (
        listings.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
