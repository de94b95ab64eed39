"""Files arriving in a folder are analysed as they land (Structured Streaming).

The reference analyses one file per run. Here a file stream lists new files
(only their paths and sizes are read by the stream: ``binaryFile`` prunes the
unselected ``content`` column) and ``foreachBatch`` runs the batch pipeline
on each new file, writing its report tables under
``<out_dir>/<file name>/<table>``, where the name carries its extension and a
digest of the folder, so equal stems do not overwrite one another. Progress lives
under ``<out_dir>/_progress``, so a restarted query resumes without re-processing
finished files.
"""

from __future__ import annotations

import hashlib
import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.session import ensure_checkpoint_dir


def _process_file(spark: SparkSession, path: str, out_dir: str, lineage: str) -> None:
    from tidemark.plans import report
    from tidemark.sources.files import read_table
    raw = read_table(spark, path, lineage="core" if lineage == "core" else "adaptive")
    where, name = os.path.split(urlparse(path).path)
    name = f"{name}-{hashlib.sha1(where.encode()).hexdigest()[:8]}"
    target = os.path.join(out_dir, name)
    if lineage == "core":
        from tidemark.plans.core import run_core
        res = run_core(raw)
        report.write_tables(report.core_tables(res), target)
    else:
        from tidemark.plans.adaptive import run_adaptive
        res = run_adaptive(raw)
        report.write_tables(report.adaptive_tables(res), target)


def watch_folder(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str | None = None,
                 lineage: str = "adaptive", glob: str = "*.csv", available_now: bool = False,
                 max_files_per_trigger: int = 1):
    """Start the stream; returns the ``StreamingQuery``.

    ``available_now=True`` processes what is there and stops (batch-like runs
    and tests); otherwise the query keeps watching the folder.
    """
    ensure_checkpoint_dir(spark)
    ckpt = checkpoint or os.path.join(out_dir, "_progress")
    schema = T.StructType([T.StructField("path", T.StringType()),
                           T.StructField("modificationTime", T.TimestampType()),
                           T.StructField("length", T.LongType()),
                           T.StructField("content", T.BinaryType())])
    files: DataFrame = (spark.readStream.format("binaryFile").schema(schema)
                        .option("pathGlobFilter", glob)
                        .option("maxFilesPerTrigger", max_files_per_trigger)
                        .load(in_dir)
                        .select("path", "length"))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # one row per new file: the list is as long as the files in the trigger
        for row in batch.select("path").collect():
            _process_file(spark, row["path"], out_dir, lineage)

    writer = files.writeStream.foreachBatch(run_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
