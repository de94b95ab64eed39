"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job here relies on. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small) and splits skewed
# partitions; the UI stays off because no server may be opened.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of frames no longer referenced are removed by the cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # keep plan text (logs, listener events) bounded for long pipelines
    "spark.sql.maxPlanStringLength": "200000",
}


def get_spark(master: str | None = None, app: str = "tidemark",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` is only set when given, so on a cluster the submit-time master
    wins. ``shuffle_partitions`` should be sized to the data (about 128 MB of
    shuffle per partition); locally it defaults to the core count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; create a scratch one only
    when a session of one machine has none (local runs and tests). On a cluster a
    machine-local folder would lose data, so a missing setting is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="tidemark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df: DataFrame, how: str = "persist") -> DataFrame:
    """Pin a frame that several later stages read.

    ``checkpoint`` (what the pipelines use) writes it as Parquet to the shared folder
    (``boundary``). ``persist`` keeps it in executor memory/disk (lost blocks are recomputed
    from lineage); ``none`` is a no-op.
    """
    if how == "checkpoint":
        return boundary(df, "stage")
    if how == "none":
        return df
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def boundary(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    A stage boundary: the lineage is cut (executors that replace lost ones read the written
    table), later stages read only the columns they use, and the folder is removed when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    # by position: names may differ in case only
    kinds = [F.lit(None).cast("string") if t == "void" else F.col(f"c{i}") for i, (_, t) in enumerate(df.dtypes)]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[k.alias(f"c{i}") for i, k in enumerate(kinds)])
    plain.write.options(**options).parquet(path)
    removed_at_end(spark, path)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._boundary = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``boundary`` returned, once all that was made of them is written or collected; others are left."""
    for df in tables:
        if path := getattr(df, "__dict__", {}).get("_boundary"):
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Has the folder deleted when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, so a Python worker's memory does not follow the row size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def default_buckets(spark: SparkSession) -> int:
    """Range buckets for distributed ranks: one per shuffle partition."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always set in practice
        n = 200
    return max(4, min(n, 4096))


def ship_package(spark: SparkSession) -> None:
    """Make ``tidemark`` importable on every executor's Python workers.

    Pandas UDFs (the isolation forest) pickle functions of this package by
    reference; the workers import it. ``addPyFile`` of a zip of the package is
    the standard way to ship it (cluster or local, any working directory).
    """
    import zipfile

    sc = spark.sparkContext
    key = "tidemark.shipped"
    if sc.getLocalProperty(key) == "1" or getattr(sc, "_tidemark_shipped", False):
        return
    import tidemark
    pkg = os.path.dirname(os.path.abspath(tidemark.__file__))
    root = os.path.dirname(pkg)
    out_dir = tempfile.mkdtemp(prefix="tidemark-pkg-", dir=os.environ.get("TMPDIR", "/tmp"))
    zpath = os.path.join(out_dir, "tidemark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    sc._tidemark_shipped = True
