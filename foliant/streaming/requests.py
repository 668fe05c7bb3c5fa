"""Requests that expire: each access refreshes a request, and one left alone for longer than its time to live is gone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds to live and between sweeps.
TIME_TO_LIVE, SWEEP = 1800, 60


def lives(accesses: DataFrame, seconds: int = TIME_TO_LIVE) -> DataFrame:
    """request, started, last and accesses of each life of a request, over a batch of (request, at).

    A life ends with the first gap longer than ``seconds``; a gap of exactly that length doesn't end it.
    """
    order = Window.partitionBy("request").orderBy("at")
    gap = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(order).cast("timestamp"))
    begun = F.coalesce(gap > seconds * 1_000_000, F.lit(True))
    numbered = accesses.withColumn("_life", F.sum(begun.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("request", "_life").agg(F.min("at").alias("started"), F.max("at").alias("last"), F.count("*").alias("accesses")).drop("_life")


def live_sessions(accesses: DataFrame, seconds: int = TIME_TO_LIVE, late: str = "10 minutes") -> DataFrame:
    """The same over a stream, as session windows that close once the watermark has passed them."""
    window = F.session_window("at", f"{seconds} seconds")
    sessions = accesses.withWatermark("at", late).groupBy("request", window).agg(F.count("*").alias("accesses"))
    return sessions.select("request", F.col("session_window.start").alias("started"), (F.col("session_window.end") - F.expr(f"INTERVAL {seconds} SECONDS")).alias("last"), "accesses")


def remaining(queue: DataFrame, now: float, seconds: int = TIME_TO_LIVE) -> DataFrame:
    """Requests (queued_at in seconds) that a sweep at ``now`` keeps."""
    return queue.where(F.lit(now) - F.col("queued_at") <= seconds)


STATE = "last timestamp, input string, accesses long"
EVENTS = "request string, outcome string, input string, accesses long"


def tracked(stream: DataFrame, seconds: int = TIME_TO_LIVE) -> DataFrame:
    """Outcomes of a stream of (request, at, action, input): ``opened``, ``refreshed``, ``taken``, ``rejected``, and ``expired`` once the watermark passes the time to live.

    ``open`` starts a request, ``touch`` refreshes it, ``take`` ends it; the
    last two are rejected where there is none, or none any more.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held = state.getOption
        if state.hasTimedOut:
            out.append((key[0], "expired", held[1], held[2]))
            state.remove()
            yield pd.DataFrame(out, columns=["request", "outcome", "input", "accesses"])
            return
        for row in sorted((r for b in batches for r in b.itertuples()), key=lambda r: r.at):
            if held and (row.at - held[0]).total_seconds() > seconds:
                out.append((key[0], "expired", held[1], held[2]))
                held = None
            if row.action == "open":
                held = (row.at, row.input, 1)
                out.append((key[0], "opened", held[1], 1))
            elif not held:
                out.append((key[0], "rejected", None, 0))
            elif row.action == "take":
                out.append((key[0], "taken", held[1], held[2] + 1))
                held = None
            else:
                held = (row.at, held[1], held[2] + 1)
                out.append((key[0], "refreshed", held[1], held[2]))
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(int(held[0].timestamp() * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["request", "outcome", "input", "accesses"])

    grouped = stream.withWatermark("at", f"{SWEEP} seconds").groupBy("request")
    return grouped.applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
