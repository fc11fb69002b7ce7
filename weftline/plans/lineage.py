"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; only where that is unset
    (tests, notebooks in local mode) fall back to a private temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="weftline-ckpt-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` reliably (it survives the loss of executors) and forget its lineage.

    A checkpointed plan still carries the constraints of the plan it came from; over the rounds of
    a loop they grow exponentially in the driver. The result is therefore read through a plain
    scan of the checkpointed rows, which has none.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=eager)._jdf
    rows = kept.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept.schema(), False), spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
