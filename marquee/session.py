"""Spark session helpers: one place for the configuration every job relies on.

Cluster rules:
* the checkpoint folder is whatever the cluster names in ``spark.checkpoint.dir``;
  we only pick our own when it is unset (local tests);
* lineage is cut with ``DataFrame.checkpoint()`` (reliable, written to that folder),
  never with ``localCheckpoint`` (lost with the executor);
* scratch outputs (sink round trips) go under the same shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "marquee") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing a local one only if unset."""
    d = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getConf().get(_CKPT_KEY, None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{_CKPT_KEY} is not set: executors of {master} need a shared folder")
        # local runs / tests only: one machine, so its own folder is shared
        d = tempfile.mkdtemp(prefix="marquee-ckpt-")
        spark.conf.set(_CKPT_KEY, d)
    jsc = spark.sparkContext._jsc
    if jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a materialised table."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/marquee-scratch/{uuid.uuid4().hex}/{name}"


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and the reader knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); eager so later jobs reuse it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
