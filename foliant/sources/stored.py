"""Tables between steps: written once in the folder that the cluster shares, and reread.

A step whose result several others read would else run once for each of them.
The folder is the one that ``spark.checkpoint.dir`` names; only a purely local session without
it may use a temporary folder of its machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    conf, app = spark.sparkContext.getConf(), spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not shared:
        if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="foliant-"))
    return f"{shared.rstrip('/')}/foliant-tables-{app}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table that is read again; a lost executor repeats its own tasks only."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
