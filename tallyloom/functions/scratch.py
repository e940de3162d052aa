"""Written intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Without the setting a session whose executors are threads of the driver gets a temporary folder;
    any other, ``local-cluster`` too, is refused, as its executors share no local disk.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once, read back: later passes scan only their columns and lost executors
    cost no recomputation of the lineage above.

    ``release`` drops the copy once nothing reads it any more.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def release(df: DataFrame) -> None:
    """Delete the copy that ``materialize`` returned; other tables are left alone."""
    path = getattr(df, "stored_at", None)
    if path:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
        del df.stored_at
