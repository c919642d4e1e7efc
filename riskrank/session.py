"""SparkSession construction and the shared checkpoint folder.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
file system). Only when it is unset and the master is local (tests, benches) is a
scratch folder created under /tmp.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "riskrank",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use ``spark.checkpoint.dir`` when the cluster names one; else a local scratch
    folder, which is only allowed for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="riskrank-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


#: Tables with so many rows at most (one per model, class or field) are broadcast.
SMALL_SIDE_ROWS = 1000


def small_side(df):
    """``df`` marked for broadcast when it has at most ``SMALL_SIDE_ROWS`` rows, else as it is."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(SMALL_SIDE_ROWS + 1).count() <= SMALL_SIDE_ROWS else df


#: Tables of a few numbers a row are broadcast up to so many rows (about 50 bytes each on an executor).
NARROW_SIDE_ROWS = 2_000_000


def narrow_side(df):
    """``df`` (a key and a few numbers) marked for broadcast when it has at most ``NARROW_SIDE_ROWS`` rows, so that
    the wide rows it joins need not move; else as it is."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.count() <= NARROW_SIDE_ROWS else df


#: Rows of whole texts that cross to Python at once.
TEXT_BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session: a batch of texts is held several times over by each Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``df`` written to the shared checkpoint folder and read back: the lineage is cut, and
    Spark knows its bytes when it chooses between a broadcast and a shuffled join."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
