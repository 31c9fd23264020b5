"""Tables that an operator writes on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession


#: By application: the folder of a local one that has no setting, and the tables that were written.
_FOLDERS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = defaultdict(list)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = spark.sparkContext.applicationId  # the setting itself can't be changed in a session
    if own not in _FOLDERS:
        _FOLDERS[own] = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return _FOLDERS[own]


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that operators wrote on the way in this application, and say how many.

    For callers that have stored their results: DataFrames that read these tables can't be computed any more.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/factloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN[df.sparkSession.sparkContext.applicationId].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
