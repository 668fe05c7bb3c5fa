"""Usage statistics over chats, counters and the conversion log.

Everything is a function of an explicit ``as_of`` time, cutoffs are inclusive,
and top lists break ties by name.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Uses that make a repeat user and a power user.
REPEAT_USES, POWER_USES = 2, 10
#: Fixed value: code points of an error message that are kept.
ERROR_LENGTH = 2000


def percent(part: Column, total: Column) -> Column:
    """100 * part / total to one decimal, half to even; 0 where total is 0."""
    return F.when(total > 0, F.bround(100.0 * part / F.when(total > 0, total), 1)).otherwise(F.lit(0.0))


def recent(events: DataFrame, as_of: datetime.datetime, days: float) -> DataFrame:
    return events.where(F.col("created_at") >= F.lit(as_of - datetime.timedelta(days=days)))


def top_pairs(events: DataFrame, limit: int, success: bool | None = None) -> DataFrame:
    """The most frequent (input_format, output_format), optionally of one outcome."""
    chosen = events if success is None else events.where(F.col("success") == F.lit(success))
    counted = chosen.groupBy("input_format", "output_format").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "input_format", "output_format").limit(limit)


def top_formats(analytics: DataFrame, counter: str, limit: int) -> DataFrame:
    """The formats with the highest counter; those at 0 are left out."""
    return analytics.where(F.col(counter) > 0).select("format", F.col(counter).cast("long").alias("count")).orderBy(F.desc("count"), "format").limit(limit)


def chat_counts(chats: DataFrame) -> DataFrame:
    """One row of user counts, in one pass."""
    used = F.col("usage_times")
    counted = chats.agg(F.count("*").alias("all_users"), F.count_if(used > 0).alias("converted_users"), F.count_if(used >= REPEAT_USES).alias("repeat_users"), F.count_if(used >= POWER_USES).alias("power_users"))
    return counted.select(
        "*", (F.col("all_users") - F.col("converted_users")).alias("inactive_users"),
        percent(F.col("converted_users"), F.col("all_users")).alias("converted_percent"), percent(F.col("repeat_users"), F.col("converted_users")).alias("repeat_percent"),
    )


def event_counts(events: DataFrame, as_of: datetime.datetime, recent_days: float, week_days: float = 7) -> DataFrame:
    """One row over the log: users active in the week and the recent period, attempts, outcomes and the mean duration (cut to whole)."""
    scanned = recent(events, as_of, max(recent_days, week_days))
    inside = F.col("created_at") >= F.lit(as_of - datetime.timedelta(days=recent_days))
    in_week = F.col("created_at") >= F.lit(as_of - datetime.timedelta(days=week_days))
    # One row for each user first: a distinct count then needs no second shuffle of the log.
    users = scanned.groupBy("user_id").agg(
        F.max(in_week).alias("week"), F.max(inside).alias("recent"), F.count_if(inside).alias("attempts"), F.count_if(inside & F.col("success")).alias("successes"),
        F.sum(F.when(inside, F.col("duration_ms").cast("decimal(28,6)"))).alias("duration"), F.count(F.when(inside, F.col("duration_ms"))).alias("timed"),
    )
    total = users.agg(
        F.count_if(F.col("week") & F.col("user_id").isNotNull()).alias("active_7d"), F.count_if(F.col("recent") & F.col("user_id").isNotNull()).alias("active_recent"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("successes"), F.lit(0)).alias("successes"), F.sum("duration").alias("duration"), F.coalesce(F.sum("timed"), F.lit(0)).alias("timed"),
    )
    return total.select(
        "active_7d", "active_recent", "attempts", "successes", (F.col("attempts") - F.col("successes")).alias("failures"), percent(F.col("successes"), F.col("attempts")).alias("success_percent"),
        F.when(F.col("timed") > 0, F.col("duration") / F.when(F.col("timed") > 0, F.col("timed"))).cast("long").alias("avg_duration_ms"),
    )


def _largest(count: Column, limit: int, *names: str) -> Column:
    """Within an aggregate: the rows with the highest positive count, ties by name, as an ordered array of structs.  For rows of few kinds."""
    row = F.struct((-count).alias("order"), *names, count.cast("long").alias("count"))
    return F.transform(F.slice(F.array_sort(F.collect_list(F.when(count > 0, row))), 1, limit), lambda x: F.struct(*[x[c].alias(c) for c in (*names, "count")]))


def log_summary(events: DataFrame, as_of: datetime.datetime, recent_days: float, top_limit: int, week_days: float = 7) -> DataFrame:
    """One row with all that ``event_counts`` says and the lists of (failed) pairs, from one scan of the log.

    Where it is read the log becomes a row for each user, pair and outcome; of these, users and pairs are counted in one more pass.
    """
    scanned = recent(events, as_of, max(recent_days, week_days))
    inside = F.col("created_at") >= F.lit(as_of - datetime.timedelta(days=recent_days))
    in_week = F.col("created_at") >= F.lit(as_of - datetime.timedelta(days=week_days))
    cells = scanned.groupBy("user_id", "input_format", "output_format", "success").agg(
        F.max(in_week).alias("week"), F.count_if(inside).alias("n"), F.sum(F.when(inside, F.col("duration_ms").cast("decimal(28,6)"))).alias("duration"), F.count(F.when(inside, F.col("duration_ms"))).alias("timed"),
    )
    keys = ["user_id", "input_format", "output_format", "success"]
    counted = cells.groupingSets([["user_id"], ["input_format", "output_format"], ["input_format", "output_format", "success"]], *keys).agg(
        F.grouping_id().alias("set"), F.max("week").alias("week"), F.sum("n").alias("n"), F.sum(F.when(F.col("success"), F.col("n"))).alias("good"), F.sum("duration").alias("duration"), F.sum("timed").alias("timed"),
    )
    # Sets by the keys that they leave out: 0111 users, 1001 pairs, 1000 pairs of one outcome.
    of_user, pair, failed = F.col("set") == 0b0111, F.col("set") == 0b1001, (F.col("set") == 0b1000) & ~F.col("success")
    known = of_user & F.col("user_id").isNotNull()
    zero = F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(F.when(of_user, F.col(c))), zero)
    summed = counted.agg(
        F.count_if(known & F.col("week")).alias("active_7d"), F.count_if(known & (F.col("n") > 0)).alias("active_recent"), total("n").alias("attempts"), total("good").alias("successes"), F.sum(F.when(of_user, F.col("duration"))).alias("duration"), total("timed").alias("timed"),
        _largest(F.when(pair, F.col("n")), top_limit, "input_format", "output_format").alias("top_pairs"), _largest(F.when(failed, F.col("n")), top_limit, "input_format", "output_format").alias("failed_pairs"),
    )
    return summed.select(
        "active_7d", "active_recent", "attempts", "successes", (F.col("attempts") - F.col("successes")).alias("failures"), percent(F.col("successes"), F.col("attempts")).alias("success_percent"),
        F.when(F.col("timed") > 0, F.col("duration") / F.when(F.col("timed") > 0, F.col("timed"))).cast("long").alias("avg_duration_ms"), "top_pairs", "failed_pairs",
    )


def counter_summary(analytics: DataFrame, top_limit: int) -> DataFrame:
    """One row with the totals of all counters and the lists of formats; there are as many rows as formats."""
    zero = F.lit(0).cast("long")
    return analytics.agg(
        F.coalesce(F.sum("output_times"), zero).alias("legacy_successes"), F.coalesce(F.sum("input_times"), zero).alias("legacy_input_total"),
        _largest(F.col("input_times"), top_limit, "format").alias("input_formats"), _largest(F.col("output_times"), top_limit, "format").alias("output_formats"),
    )


def snapshot(events: DataFrame, chats: DataFrame, analytics: DataFrame, as_of: datetime.datetime, recent_days: float = 30, top_limit: int = 5) -> DataFrame:
    """All statistics as one row; lists are arrays of structs.  Each table is read once."""
    return chat_counts(chats).crossJoin(counter_summary(analytics, top_limit)).crossJoin(log_summary(events, as_of, recent_days, top_limit))  # one row each


def recorded(events: DataFrame) -> DataFrame:
    """Events as they are appended to the log: long error texts cut, an empty output size unknown."""
    return events.withColumns({"error_message": F.substring("error_message", 1, ERROR_LENGTH), "output_size_bytes": F.nullif("output_size_bytes", F.lit(0).cast("long"))})


def appended(events: DataFrame, path: str) -> None:
    """Appends ``recorded`` events to the log at ``path``, a Parquet table by day, in which a period of days reads its own files only."""
    recorded(events).withColumn("day", F.to_date("created_at")).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def _lines(rows: Column, of) -> Column:
    """Indented lines, or the line for no data."""
    text = F.array_join(F.transform(rows, lambda x: F.concat(F.lit("    __"), of(x), F.lit("__: "), x["count"].cast("string"), F.lit(" times.\n"))), "")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, text).otherwise(F.lit("    No data\n"))


def format_lines(rows: Column) -> Column:
    """A list of formats as shown to an administrator."""
    return _lines(rows, lambda x: x["format"])


def pair_lines(rows: Column) -> Column:
    """A list of pairs as shown to an administrator."""
    return _lines(rows, lambda x: F.concat(x["input_format"], F.lit(" -> "), x["output_format"]))


def duration_text(milliseconds: Column) -> Column:
    """Milliseconds as ``x.ys``."""
    return F.when(milliseconds.isNull(), F.lit("No data")).otherwise(F.format_string("%.1fs", F.bround(milliseconds / 1000.0, 1)))
