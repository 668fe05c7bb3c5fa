"""Choosing recipients of a broadcast and accounting for its delivery."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """What a filter text asks for; ``error`` is set where it can't be read, and nothing else is then."""

    active_after: datetime.datetime | None = None
    username_only: bool = False
    error: str | None = None


def filters_text(message: str | None) -> str:
    """The filter part of a command message."""
    text = (message or "").strip()
    return text.removeprefix("/broadcast").strip()


def parse_filters(text: str | None, as_of: datetime.datetime) -> Filters:
    """One filter a line, ``active_within DAYS`` or ``username_only [yes|no]``; a later line of a kind replaces an earlier one."""
    body = (text or "").strip()
    found = Filters()
    if body.lower() == "done":
        return found
    for line in filter(None, map(str.strip, body.splitlines())):
        word, *rest = line.split()
        if word.lower() == "username_only":
            found = Filters(found.active_after, not rest or rest[0].lower() in ("yes", "true", "1"))
        elif word.lower() == "active_within" and rest:
            try:
                days = int(rest[0])
            except ValueError:
                return Filters(error='Invalid number for "active_within".')
            if days < 0:
                return Filters(error='"active_within" must be positive.')
            found = Filters(as_of - datetime.timedelta(days=days), found.username_only)
        else:
            return Filters(error=f'Unrecognized filter: "{line}".')
    return found


def recipients(chats: DataFrame, events: DataFrame, filters: Filters, ordered: bool = True) -> DataFrame:
    """``chats`` that pass the filters, by user_id; activity is a semi-join with the events since the cutoff.  The order costs a shuffle by ranges, which a caller that needs none can spare."""
    chosen = chats.where(F.col("user_name") != "") if filters.username_only else chats
    if filters.active_after is not None:
        active = events.where(F.col("created_at") >= F.lit(filters.active_after)).select("user_id")
        chosen = chosen.join(active, "user_id", "left_semi")
    return chosen.orderBy("user_id") if ordered else chosen


def delivered(attempts: DataFrame) -> DataFrame:
    """The outcome for each chat of ``attempts`` (chat_id, attempt_no, outcome).

    ``flood`` asks for one retry; ``ok`` delivers, ``blocked`` fails for good
    (delivered false), anything else fails for now (delivered null).
    """
    first = F.max(F.when(F.col("attempt_no") == 1, F.col("outcome")))
    second = F.max(F.when(F.col("attempt_no") == 2, F.col("outcome")))
    last = attempts.groupBy("chat_id").agg(first.alias("first"), second.alias("second"))
    outcome: Column = F.when(F.col("first") == "flood", F.col("second")).otherwise(F.col("first"))
    return last.select("chat_id", F.when(outcome == "ok", True).when(outcome == "blocked", False).alias("delivered"))


def delivery_counts(outcomes: DataFrame) -> DataFrame:
    """One row: chats reached, and chats missed for good or for now."""
    return outcomes.agg(F.count_if("delivered").alias("sent"), F.count_if(~F.coalesce("delivered", F.lit(False))).alias("failed"))


def after_broadcast(chats: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``chats`` without those that can't be reached for good."""
    gone = outcomes.where("delivered = false").select(F.col("chat_id").alias("user_id"))
    return chats.join(gone, "user_id", "left_anti")
