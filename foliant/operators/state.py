"""Row mutations as functions of a table and a log of changes.

Parquet has no rows to update, and a log scales where row locks don't: current
state is a table joined with the aggregate of a log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_missing(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` and those rows of ``new`` whose key it doesn't have, one of each key; columns that ``new`` lacks are null."""
    fresh = new.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def seed_formats(analytics: DataFrame, formats: DataFrame) -> DataFrame:
    """Every format has a row of counters."""
    zero = F.lit(0)
    return insert_missing(analytics, formats.select("format", zero.alias("input_times"), zero.alias("output_times")), "format")


def insert_chats(chats: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Chats seen for the first time, by the earliest arrival (``seq``); chats that are there never change."""
    first = arrivals.groupBy("user_id").agg(F.min_by(F.struct("user_name", "type"), "seq").alias("s"))
    fresh = first.select("user_id", "s.user_name", "s.type", F.lit(0).alias("usage_times")).join(chats.select("user_id"), "user_id", "left_anti")
    return chats.unionByName(fresh)


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def deletion_flags(table: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """``requests`` (key, seq) with ``found``: the first request for a row that exists finds it, later ones don't."""
    first = requests.groupBy(key).agg(F.min("seq").alias("_first"))
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    joined = requests.join(first, key).join(known, key, "left")
    return joined.select(key, "seq", (F.coalesce("_known", F.lit(False)) & (F.col("seq") == F.col("_first"))).alias("found"))


def add_counts(table: DataFrame, log: DataFrame, key: str, counters: dict[str, Column]) -> DataFrame:
    """``table`` with each counter raised by the sum of its expression over the ``log`` rows of the key; unknown keys are ignored."""
    sums = log.groupBy(key).agg(*[F.sum(expression).alias(f"_{name}") for name, expression in counters.items()])
    joined = table.join(sums, key, "left")
    raised = {n: (F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).cast(table.schema[n].dataType) for n in counters}
    return joined.withColumns(raised).select(*table.columns)


def upsert_latest(table: DataFrame, log: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """One row for each key of either side: the latest values in the ``log``, else those in the ``table``."""
    latest = log.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_new"))
    joined = table.join(latest, key, "full_outer")
    return joined.select(key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{v}")).otherwise(F.col(v)).alias(v) for v in values])


def languages(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """``users`` with their language, ``en`` where none is set."""
    joined = users.join(preferences.select("user_id", "language"), "user_id", "left")
    return joined.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("en")))


def json_object(text: Column) -> Column:
    """A variant object, or null where the text is malformed or no object."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).like("OBJECT%"), parsed)
