"""The library's entities read from the star-schema test tables.

Each function selects columns right after the scan, so that filters and column
pruning reach the Parquet reader.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Position of a row of ``lineitem`` in its order; these six columns are unique.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as conversions: the kind of event is the input format, the tens of ``props.k`` the output format."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("input_format"), F.concat(F.lit("k"), F.floor(k / 10).cast("string")).alias("output_format"),
        (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"), F.col("ts").alias("created_at"),
    )


def as_of(events: DataFrame) -> datetime.datetime:
    """The latest event: one number from Parquet statistics or a partial aggregate."""
    return events.agg(F.max("created_at")).first()[0]


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as chats; usage is the number of their successful events."""
    usage = conversion_events(spark, sf_dir).where("success").groupBy("user_id").agg(F.count("*").cast("int").alias("usage_times"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), (F.col("c_nationkey") % 3).alias("type"))
    return people.join(usage, "user_id", "left").select("user_id", "user_name", "type", F.coalesce("usage_times", F.lit(0)).alias("usage_times"))


def analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by format over successful events: each counts once for its input and once for its output."""
    done = conversion_events(spark, sf_dir).where("success")
    sides = done.select(F.explode(F.array(F.struct(F.col("input_format").alias("format"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("output_format").alias("format"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("s"))
    return sides.groupBy(F.col("s.format").alias("format")).agg(F.sum("s.i").cast("int").alias("input_times"), F.sum("s.o").cast("int").alias("output_times"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with ``pos``, its position in the order."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order))
