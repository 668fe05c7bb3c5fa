from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from foliant.operators import recipients, state, usage
from foliant.sources import schemas

NOW = datetime.datetime(2026, 5, 20, 12)


def fixture(spark, empty=False):
    chats = spark.createDataFrame([] if empty else [(1, "one", 0, 2), (2, "two", 0, 0), (3, "three", 0, 10)], schemas.CHATS)
    counters = spark.createDataFrame([] if empty else [("epub", 3, 0), ("pdf", 0, 2), ("kfx", 0, 1)], schemas.ANALYTICS)
    log = [(1, "epub", "pdf", True, None, 1000, 100, 200, "calibre", NOW), (1, "epub", "pdf", False, "boom", 3000, None, None, "calibre", NOW), (3, "epub", "kfx", True, None, 2000, None, None, "calibre", NOW)]
    return spark.createDataFrame([] if empty else log, schemas.CONVERSION_EVENTS), chats, counters


def test_snapshot(spark):
    events, chats, counters = fixture(spark)
    row = usage.snapshot(events, chats, counters, NOW).first()
    assert (row.all_users, row.converted_users, row.inactive_users, row.repeat_users, row.power_users) == (3, 2, 1, 2, 1)
    assert (row.converted_percent, row.repeat_percent, row.success_percent) == (66.7, 100.0, 66.7)
    assert (row.active_7d, row.active_recent, row.legacy_successes, row.legacy_input_total) == (2, 2, 3, 3)
    assert (row.attempts, row.successes, row.failures, row.avg_duration_ms) == (3, 2, 1, 2000)
    assert [tuple(x) for x in row.top_pairs] == [("epub", "pdf", 2), ("epub", "kfx", 1)]
    assert [tuple(x) for x in row.failed_pairs] == [("epub", "pdf", 1)]
    assert [tuple(x) for x in row.input_formats] == [("epub", 3)]
    assert [tuple(x) for x in row.output_formats] == [("pdf", 2), ("kfx", 1)]


def test_snapshot_of_nothing(spark):
    events, chats, counters = fixture(spark, empty=True)
    row = usage.snapshot(events, chats, counters, NOW).first().asDict()
    assert row.pop("avg_duration_ms") is None
    assert all(v in (0, 0.0, []) for v in row.values())


def test_percent_is_half_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (0, 0)], "part LONG, total LONG").select(usage.percent(F.col("part"), F.col("total")).alias("p"))
    assert [r.p for r in df.collect()] == [6.2, 18.8, 0.0]


def test_texts_for_administrators(spark):
    events, chats, counters = fixture(spark)
    shot = usage.snapshot(events, chats, counters, NOW).select(usage.pair_lines(F.col("failed_pairs")).alias("f"), usage.format_lines(F.col("input_formats")).alias("i"), usage.format_lines(F.filter("input_formats", lambda x: x["count"] > 9)).alias("none"), usage.duration_text(F.col("avg_duration_ms")).alias("d"), usage.duration_text(F.lit(None).cast("long")).alias("nd"))
    assert tuple(shot.first()) == ("    __epub -> pdf__: 1 times.\n", "    __epub__: 3 times.\n", "    No data\n", "2.0s", "No data")


def test_recorded_error_is_cut(spark):
    df = spark.createDataFrame([("x" * 2500, 0), (None, 7)], "error_message STRING, output_size_bytes LONG")
    assert [(len(r[0] or ""), r[1]) for r in usage.recorded(df).collect()] == [(2000, None), (0, 7)]


def test_filter_language():
    good = recipients.parse_filters("active_within 3\nusername_only yes", NOW)
    assert good == recipients.Filters(NOW - datetime.timedelta(days=3), True)
    for text in ("", None, "done", " DONE \n"):
        assert recipients.parse_filters(text, NOW) == recipients.Filters()
    errors = [recipients.parse_filters(x, NOW).error for x in ("active_within nope", "active_within -1", "unknown option")]
    assert len(set(errors)) == 3 and all(errors)
    assert recipients.parse_filters("username_only maybe", NOW) == recipients.Filters()
    assert recipients.filters_text("/broadcast active_within 1 ") == "active_within 1"


def test_recipients(spark, rows):
    chats = spark.createDataFrame([(1, ""), (2, "active"), (3, "old")], "user_id LONG, user_name STRING")
    events = spark.createDataFrame([(2, NOW), (3, NOW - datetime.timedelta(days=3))], "user_id LONG, created_at TIMESTAMP_NTZ")
    since = NOW - datetime.timedelta(days=1)
    expected = {(None, False): [1, 2, 3], (None, True): [2, 3], (since, False): [2], (since, True): [2]}
    for (after, named), ids in expected.items():
        got = recipients.recipients(chats, events, recipients.Filters(after, named))
        assert [r[0] for r in rows(got, "user_id")] == ids


def test_delivery(spark, rows):
    tries = [(1, 1, "ok"), (2, 1, "flood"), (2, 2, "ok"), (3, 1, "blocked"), (4, 1, "other"), (5, 1, "flood"), (5, 2, "blocked")]
    done = recipients.delivered(spark.createDataFrame(tries, "chat_id LONG, attempt_no INT, outcome STRING"))
    assert tuple(recipients.delivery_counts(done).first()) == (2, 3)
    left = recipients.after_broadcast(spark.createDataFrame([(i,) for i in range(1, 6)], "user_id LONG"), done)
    assert [r[0] for r in rows(left)] == [1, 2, 4]


def test_state_changes(spark, rows):
    old = spark.createDataFrame([("epub", 0, 0), ("pdf", 0, 0)], schemas.ANALYTICS)
    seeded = state.seed_formats(old, spark.createDataFrame([("epub",), ("kfx",), ("kfx",)], "format STRING"))
    assert rows(seeded) == [("epub", 0, 0), ("kfx", 0, 0), ("pdf", 0, 0)]
    log = spark.createDataFrame([("epub", 1, 0), ("epub", 0, 1), ("missing", 1, 0)], "format STRING, i INT, o INT")
    assert rows(state.add_counts(seeded, log, "format", {"input_times": F.col("i"), "output_times": F.col("o")})) == [("epub", 1, 1), ("kfx", 0, 0), ("pdf", 0, 0)]
    chats = state.insert_chats(spark.createDataFrame([], schemas.CHATS), spark.createDataFrame([(1, "first", 0, 1), (1, "ignored", 1, 2), (2, "second", 1, 3)], "user_id LONG, user_name STRING, type INT, seq INT"))
    used = state.add_counts(chats, spark.createDataFrame([(1,), (404,)], "user_id LONG"), "user_id", {"usage_times": F.lit(1)})
    assert rows(used) == [(1, "first", 0, 1), (2, "second", 1, 0)]
    flags = state.deletion_flags(used, spark.createDataFrame([(2, 1), (2, 2), (9, 3)], "user_id LONG, seq INT"), "user_id")
    assert rows(flags, "user_id", "seq", "found") == [(2, 1, True), (2, 2, False), (9, 3, False)]
    languages = state.upsert_latest(spark.createDataFrame([], schemas.PREFERENCES), spark.createDataFrame([(1, "ar", 1), (1, "en", 2)], "user_id LONG, language STRING, seq INT"), "user_id", ["language"], "seq")
    assert rows(languages) == [(1, "en")]
    assert rows(state.languages(spark.createDataFrame([(1,), (2,)], "user_id LONG"), languages)) == [(1, "en"), (2, "en")]


def test_json_objects(spark):
    texts = [('{"force_rtl":true}',), ('{"force_rtl": true',), ('["force_rtl"]',), ("{}",), (None,)]
    got = spark.createDataFrame(texts, "t STRING").select(state.json_object(F.col("t")).isNotNull().alias("ok"))
    assert [r.ok for r in got.collect()] == [True, False, False, True, False]
