"""Session helpers: tables of a directory, the cluster's shared folder, bounded Arrow batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only where none is named (tests), one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="stowage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, so that a batch of very long values fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores dealt out to all of them, before work that costs far more than
    the rows' way there (splits of one row group leave all but one task empty). Larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df
