"""Intermediate tables in the folder that the whole cluster shares.

Operators that must cut lineage or read a result twice write it as a Parquet
table below ``spark.checkpoint.dir``.  Spark's commit protocol makes such a
write all-or-nothing, so a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a purely local session may fall back to a temp folder."""
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="foliant-")
    return f"file://{_OWN[app]}"


#: Bytes of an Arrow batch: two tasks of an executor then hold little beside their tables.
BATCH_BYTES = 16 << 20


def with_small_batches(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of at most BATCH_BYTES; a smaller setting stays.

    A precondition of the queries, set for the session and left so: results are computed when they are
    asked for, so there is no later moment at which it could be put back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None) or ""
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliant-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that no result depends on any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def paths_of(df: DataFrame) -> list[str]:
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; earlier results become unreadable."""
    drop_path(spark, _root(spark))
