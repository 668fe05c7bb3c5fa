"""All queries of the library over the test tables, each with its SQL.

A query states the proxy for its input (``sources.proxies``) and applies one
operator; SQL is written independently, so agreement means something.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import assembly, footnotes, recipients, render, routing, state, structure, toc, usage
from foliant.plans import domains as D
from foliant.sources import proxies as P
from foliant.streaming import requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Common table expressions of the proxies, for SQL.
EVENTS = """ev AS (SELECT event_id, user_id, event_type AS input_format, 'k' || (json_extract(props, '$.k')::INT // 10) AS output_format,
    event_type <> 'error' AS success, value AS duration_ms, ts AS created_at FROM events),
now_ AS (SELECT max(created_at) AS t FROM ev)"""
CHATS = """used AS (SELECT user_id, count(*)::INT AS n FROM ev WHERE success GROUP BY user_id),
chats AS (SELECT c_custkey AS user_id, c_name AS user_name, c_nationkey % 3 AS type, coalesce(n, 0) AS usage_times FROM customer LEFT JOIN used ON c_custkey = user_id)"""
ANALYTICS = """an AS (SELECT format, sum(i)::INT AS input_times, sum(o)::INT AS output_times FROM
    (SELECT input_format AS format, 1 AS i, 0 AS o FROM ev WHERE success UNION ALL SELECT output_format, 0, 1 FROM ev WHERE success) GROUP BY format)"""
LINES = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::INT AS pos FROM lineitem)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with SQL where there is some."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- usage


@query(f"""WITH {EVENTS}, {CHATS}, {ANALYTICS}, r AS (SELECT ev.* FROM ev, now_ WHERE created_at >= t - INTERVAL 10 DAY),
u AS (SELECT count(*) AS all_users, count(*) FILTER (usage_times > 0) AS converted_users, count(*) FILTER (usage_times >= 2) AS repeat_users, count(*) FILTER (usage_times >= 10) AS power_users FROM chats),
e AS (SELECT count(DISTINCT user_id) AS active_recent, count(*) AS attempts, count(*) FILTER (success) AS successes, trunc(sum(duration_ms::DECIMAL(28,6)) / nullif(count(duration_ms), 0))::BIGINT AS avg_duration_ms FROM r),
w AS (SELECT count(DISTINCT user_id) AS active_7d FROM ev, now_ WHERE created_at >= t - INTERVAL 7 DAY),
pairs AS (SELECT input_format, output_format, count(*) AS n FROM r GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 5),
fails AS (SELECT input_format, output_format, count(*) AS n FROM r WHERE NOT success GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 5)
SELECT all_users, converted_users, repeat_users, power_users, all_users - converted_users AS inactive_users,
  round_even(100.0::DOUBLE * converted_users / all_users, 1) AS converted_percent, round_even(100.0::DOUBLE * repeat_users / converted_users, 1) AS repeat_percent,
  (SELECT sum(output_times)::BIGINT FROM an) AS legacy_successes, (SELECT sum(input_times)::BIGINT FROM an) AS legacy_input_total, active_7d, active_recent, attempts, successes, attempts - successes AS failures,
  round_even(100.0::DOUBLE * successes / attempts, 1) AS success_percent, avg_duration_ms,
  (SELECT string_agg('    __' || input_format || ' -> ' || output_format || '__: ' || n || ' times.' || chr(10), '' ORDER BY n DESC, input_format, output_format) FROM pairs) AS top_pairs,
  (SELECT string_agg('    __' || input_format || ' -> ' || output_format || '__: ' || n || ' times.' || chr(10), '' ORDER BY n DESC, input_format, output_format) FROM fails) AS failed_pairs,
  (SELECT string_agg('    __' || format || '__: ' || n || ' times.' || chr(10), '' ORDER BY n DESC, format) FROM (SELECT format, input_times AS n FROM an WHERE input_times > 0 ORDER BY n DESC, format LIMIT 5)) AS input_formats,
  (SELECT string_agg('    __' || format || '__: ' || n || ' times.' || chr(10), '' ORDER BY n DESC, format) FROM (SELECT format, output_times AS n FROM an WHERE output_times > 0 ORDER BY n DESC, format LIMIT 5)) AS output_formats
FROM u, e, w""")
def stats_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.conversion_events(spark, sf_dir)
    out = usage.snapshot(events, P.chats(spark, sf_dir), P.analytics(spark, sf_dir), P.as_of(events), recent_days=10, top_limit=5)
    return out.withColumns({**{c: usage.pair_lines(F.col(c)) for c in ("top_pairs", "failed_pairs")}, **{c: usage.format_lines(F.col(c)) for c in ("input_formats", "output_formats")}})


@query(f"WITH {EVENTS} SELECT input_format, output_format, count(*) AS count FROM ev, now_ WHERE created_at >= t - INTERVAL 3 DAY GROUP BY ALL ORDER BY count DESC, 1, 2 LIMIT 7")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.conversion_events(spark, sf_dir)
    return usage.top_pairs(usage.recent(events, P.as_of(events), 3), 7)


@query(f"WITH {EVENTS} SELECT input_format, output_format, count(*) AS count FROM ev, now_ WHERE created_at >= t - INTERVAL 3 DAY AND NOT success GROUP BY ALL ORDER BY count DESC, 1, 2 LIMIT 7")
def failed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.conversion_events(spark, sf_dir)
    return usage.top_pairs(usage.recent(events, P.as_of(events), 3), 7, success=False)


@query(f"WITH {EVENTS}, {ANALYTICS} SELECT format, input_times::BIGINT AS count FROM an WHERE input_times > 0 ORDER BY count DESC, format LIMIT 3")
def top_input_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top_formats(P.analytics(spark, sf_dir), "input_times", 3)


@query(f"WITH {EVENTS}, {ANALYTICS} SELECT format, output_times::BIGINT AS count FROM an WHERE output_times > 0 ORDER BY count DESC, format LIMIT 5")
def top_output_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top_formats(P.analytics(spark, sf_dir), "output_times", 5)


@query(f"""WITH {EVENTS}, {CHATS} SELECT count(*) AS all_users, count(*) FILTER (usage_times > 0) AS converted_users, count(*) FILTER (usage_times >= 2) AS repeat_users, count(*) FILTER (usage_times >= 10) AS power_users,
count(*) - count(*) FILTER (usage_times > 0) AS inactive_users, round_even(100.0::DOUBLE * count(*) FILTER (usage_times > 0) / count(*), 1) AS converted_percent,
round_even(100.0::DOUBLE * count(*) FILTER (usage_times >= 2) / count(*) FILTER (usage_times > 0), 1) AS repeat_percent FROM chats""")
def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.chat_counts(P.chats(spark, sf_dir))


@query(f"""WITH {EVENTS}, r AS (SELECT ev.* FROM ev, now_ WHERE created_at >= t - INTERVAL 12 HOUR), w AS (SELECT count(DISTINCT user_id) AS active_7d FROM ev, now_ WHERE created_at >= t - INTERVAL 6 HOUR)
SELECT active_7d, count(DISTINCT user_id) AS active_recent, count(*) AS attempts, count(*) FILTER (success) AS successes, count(*) - count(*) FILTER (success) AS failures,
round_even(100.0::DOUBLE * count(*) FILTER (success) / count(*), 1) AS success_percent, trunc(sum(duration_ms::DECIMAL(28,6)) / nullif(count(duration_ms), 0))::BIGINT AS avg_duration_ms FROM r, w GROUP BY active_7d""")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.conversion_events(spark, sf_dir)
    return usage.event_counts(events, P.as_of(events), recent_days=0.5, week_days=0.25)


@query(f"""WITH {EVENTS} SELECT event_id, substr(error_message, 1, 2000) AS error_message, nullif(output_size_bytes, 0) AS output_size_bytes FROM
(SELECT event_id, repeat(input_format, 450) AS error_message, (event_id % 3)::BIGINT AS output_size_bytes FROM ev)""")
def recorded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.conversion_events(spark, sf_dir).select("event_id", F.repeat("input_format", F.lit(450)).alias("error_message"), (F.col("event_id") % 3).alias("output_size_bytes"))
    return usage.recorded(events)


# ---------------------------------------------------------------- recipients


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats, every fifth without a name."""
    name = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_name"))
    return P.chats(spark, sf_dir).withColumn("user_name", name)


def _broadcast(spark: SparkSession, sf_dir: str, text: str, hours: float | None = None) -> DataFrame:
    events = P.conversion_events(spark, sf_dir)
    now = P.as_of(events)
    filters = recipients.parse_filters(recipients.filters_text(text), now)
    if hours is not None:
        filters = recipients.Filters(now - datetime.timedelta(hours=hours), filters.username_only)
    return recipients.recipients(_people(spark, sf_dir), events, filters).select("user_id", "user_name")


PEOPLE = "people AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS user_name FROM customer)"


@query(f"WITH {PEOPLE} SELECT * FROM people")
def broadcast_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broadcast(spark, sf_dir, "/broadcast done")


@query(f"WITH {PEOPLE} SELECT * FROM people WHERE user_name <> ''")
def broadcast_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broadcast(spark, sf_dir, "/broadcast username_only no\nusername_only yes")


@query(f"WITH {EVENTS}, {PEOPLE} SELECT * FROM people WHERE user_id IN (SELECT user_id FROM ev, now_ WHERE created_at >= t - INTERVAL 0 DAY)")
def broadcast_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broadcast(spark, sf_dir, "/broadcast active_within 0")


@query(f"WITH {EVENTS}, {PEOPLE} SELECT * FROM people WHERE user_name <> '' AND user_id IN (SELECT user_id FROM ev, now_ WHERE created_at >= t - INTERVAL 12 HOUR)")
def broadcast_named_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broadcast(spark, sf_dir, "/broadcast username_only", hours=12)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts for each chat; the kind of outcome follows from the key."""
    kind = F.element_at(F.array(*map(F.lit, ("ok", "flood", "blocked", "other"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    retry = F.element_at(F.array(*map(F.lit, ("ok", "blocked", "flood"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.explode(F.array(F.struct(F.lit(1).alias("attempt_no"), kind.alias("outcome")), F.struct(F.lit(2).alias("attempt_no"), retry.alias("outcome")))).alias("a")).select("chat_id", "a.*")


DELIVERED = """outcomes AS (SELECT c_custkey AS chat_id, CASE WHEN c_custkey % 4 = 1 THEN ['ok', 'blocked', 'flood'][c_custkey % 3 + 1] ELSE ['ok', 'flood', 'blocked', 'other'][c_custkey % 4 + 1] END AS o FROM customer)"""


@query(f"WITH {DELIVERED} SELECT chat_id, CASE o WHEN 'ok' THEN true WHEN 'blocked' THEN false END AS delivered FROM outcomes")
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipients.delivered(_attempts(spark, sf_dir))


@query(f"WITH {DELIVERED} SELECT count(*) FILTER (o = 'ok') AS sent, count(*) FILTER (o <> 'ok') AS failed FROM outcomes")
def delivery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipients.delivery_counts(recipients.delivered(_attempts(spark, sf_dir)))


@query(f"WITH {DELIVERED} SELECT c_custkey AS user_id, c_name AS user_name FROM customer JOIN outcomes ON c_custkey = chat_id WHERE o <> 'blocked'")
def chats_after_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipients.after_broadcast(P.chats(spark, sf_dir).select("user_id", "user_name"), recipients.delivered(_attempts(spark, sf_dir)))


# ---------------------------------------------------------------- state


@query(f"""WITH {EVENTS}, {ANALYTICS}, old AS (SELECT * FROM an WHERE format >= 'k')
SELECT * FROM old UNION ALL SELECT r_name, 0, 0 FROM region UNION ALL SELECT format, 0, 0 FROM an WHERE format < 'k'""")
def seeded_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_formats = P.analytics(spark, sf_dir)
    wanted = all_formats.select("format").unionByName(P.table(spark, sf_dir, "region").select(F.col("r_name").alias("format")))
    return state.seed_formats(all_formats.where("format >= 'k'"), wanted.unionByName(wanted))


@query(f"""WITH {EVENTS}, old AS (SELECT c_custkey AS user_id, c_name AS user_name, c_nationkey % 3 AS type, 0 AS usage_times FROM customer WHERE c_custkey % 2 = 0),
f AS (SELECT user_id, arg_min(input_format, event_id) AS user_name, (arg_min(event_id, event_id) % 3)::INT AS type FROM ev GROUP BY user_id)
SELECT * FROM old UNION ALL SELECT user_id, user_name, type, 0 FROM f WHERE user_id NOT IN (SELECT user_id FROM old)""")
def inserted_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = P.chats(spark, sf_dir).where("user_id % 2 = 0").withColumn("usage_times", F.lit(0))
    arrivals = P.conversion_events(spark, sf_dir).select("user_id", F.col("input_format").alias("user_name"), (F.col("event_id") % 3).cast("int").alias("type"), F.col("event_id").alias("seq"))
    return state.insert_chats(old, arrivals)


@query("SELECT c_custkey AS user_id, c_name AS user_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def deleted_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = P.conversion_events(spark, sf_dir).where("input_format = 'purchase'")
    return state.delete_keys(P.chats(spark, sf_dir).select("user_id", "user_name"), keys, "user_id")


@query("""SELECT e.user_id, e.event_id AS seq, c_custkey IS NOT NULL AND e.event_id = min(e.event_id) OVER (PARTITION BY e.user_id) AS found
FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = e.user_id WHERE event_type = 'signup'""")
def deletion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = P.table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("seq"))
    return state.deletion_flags(P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).where("user_id % 3 > 0"), asked, "user_id")


@query(f"WITH {EVENTS}, {CHATS}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) SELECT chats.user_id, user_name, type, (usage_times + coalesce(n, 0))::INT AS usage_times FROM chats LEFT JOIN n USING (user_id)")
def incremented_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.add_counts(P.chats(spark, sf_dir), P.conversion_events(spark, sf_dir), "user_id", {"usage_times": F.lit(1)})


@query(f"""WITH {EVENTS}, {ANALYTICS}, log AS (SELECT input_format AS format, success::INT AS o, (NOT success)::INT AS i FROM ev UNION ALL SELECT 'missing', 1, 1),
s AS (SELECT format, sum(i) AS i, sum(o) AS o FROM log GROUP BY format) SELECT an.format, (input_times + coalesce(i, 0))::INT AS input_times, (output_times + coalesce(o, 0))::INT AS output_times FROM an LEFT JOIN s USING (format)""")
def format_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = P.conversion_events(spark, sf_dir).select(F.col("input_format").alias("format"), "success")
    return state.add_counts(P.analytics(spark, sf_dir), log, "format", {"input_times": (~F.col("success")).cast("int"), "output_times": F.col("success").cast("int")})


@query("""WITH old AS (SELECT c_custkey AS user_id, c_mktsegment AS language FROM customer WHERE c_custkey % 2 = 1), f AS (SELECT user_id, arg_max(event_type, ts) AS language FROM events GROUP BY user_id)
SELECT coalesce(old.user_id, f.user_id) AS user_id, coalesce(f.language, old.language) AS language FROM old FULL JOIN f ON old.user_id = f.user_id""")
def upserted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("language")).where("user_id % 2 = 1")
    log = P.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("language"), "ts")
    return state.upsert_latest(old, log, "user_id", ["language"], "ts")


@query("SELECT c_custkey AS user_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'en') AS language FROM customer")
def user_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("language"))
    saved = people.where("user_id % 3 < 2").withColumn("language", F.when(F.col("user_id") % 3 == 1, "").otherwise(F.col("language")))
    return state.languages(people.select("user_id"), saved)


@query("""WITH l AS (SELECT user_id, arg_max(props, ts) AS options_json, max(ts) AS updated_at FROM events GROUP BY user_id) SELECT user_id, updated_at, json_extract(options_json, '$.k')::INT AS k FROM l""")
def latest_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = P.table(spark, sf_dir, "events").select("user_id", F.col("props").alias("options_json"), F.col("ts").alias("updated_at"))
    empty = log.limit(0).drop_duplicates(["user_id"])
    latest = state.upsert_latest(empty, log, "user_id", ["options_json", "updated_at"], "updated_at")
    return latest.select("user_id", "updated_at", F.try_variant_get(state.json_object(F.col("options_json")), "$.k", "int").alias("k"))


# ---------------------------------------------------------------- routing


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _values(rows: list[tuple], name: str, columns: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + ")"


_INPUTS = _values([(t, D.READERS.get(t)) for t in D.INPUTS], "i", "input, reader")
_OUTPUTS = _values([(k, t, D.WRITERS.get(t)) for k, t in enumerate(D.CALIBRE_OUTPUTS + D.PANDOC_ONLY_OUTPUTS)], "o", "output_pos, output, writer")
ROUTES = f"""{_INPUTS}, {_OUTPUTS}, r AS (SELECT input, output, output_pos, reader, writer, input = output OR reader IS NOT DISTINCT FROM writer AS same FROM i, o),
routes AS (SELECT * FROM r WHERE CASE WHEN input = 'doc' THEN true WHEN reader IS NULL THEN output IN {_list(D.CALIBRE_OUTPUTS)}
 WHEN input IN {_list(D.PANDOC_ONLY_INPUTS)} THEN writer IS NOT NULL AND NOT same ELSE (input = 'epub' AND output = 'epub') OR NOT same END)"""


def _routes(spark: SparkSession) -> DataFrame:
    return routing.routes(D.input_formats(spark), D.output_formats(spark))


@query(f"WITH {ROUTES} SELECT input, output, output_pos FROM routes")
def route_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark)


@query(f"WITH {_INPUTS}, {_OUTPUTS} SELECT input AS format FROM i UNION SELECT output FROM o ORDER BY 1")
def all_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.input_formats(spark).select(F.col("input").alias("format")).union(D.output_formats(spark).select("output")).distinct().orderBy("format")


@query(f"""WITH f AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Book.' || upper(event_type) WHEN 1 THEN event_type || '.v2.EPUB' WHEN 2 THEN '' ELSE 'pdf' END AS name FROM events)
SELECT event_id, name, name <> '' AND list_last(string_split(lower(name), '.')) IN {_list(D.INPUTS)} AS supported FROM f""")
def supported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    name = F.when(k == 0, F.concat(F.lit("Book."), F.upper("event_type"))).when(k == 1, F.concat("event_type", F.lit(".v2.EPUB"))).when(k == 2, "").otherwise("pdf")
    return P.table(spark, sf_dir, "events").select("event_id", name.alias("name"), routing.is_supported(name).alias("supported"))


def _requests(spark: SparkSession) -> DataFrame:
    """All allowed routes with three sets of options."""
    sets = spark.createDataFrame([(0, None, None, None, None), (1, "pandoc", None, True, None), (2, "pandoc", 150, None, True)], "option_set INT, conversion_backend STRING, line_height INT, force_rtl BOOLEAN, smarten_punctuation BOOLEAN")
    return routing.with_defaults(_routes(spark).crossJoin(F.broadcast(sets)))  # three rows


_SETS = "s(option_set, backend, line_height, rtl, smarten) AS (VALUES (0, 'calibre', NULL, false, false), (1, 'pandoc', NULL, true, false), (2, 'pandoc', 150, false, true))"
_BACKEND = f"""q AS (SELECT *, input NOT IN {_list(D.PANDOC_ONLY_INPUTS)} AND output IN {_list(D.CALIBRE_OUTPUTS)} AS by_calibre,
 reader IS NOT NULL AND writer IS NOT NULL AND NOT same AND NOT (rtl AND output NOT IN {_list(D.RTL_OUTPUTS)}) AND line_height IS NULL AND NOT smarten AND output <> 'pdf' AS by_pandoc FROM routes, s),
b AS (SELECT *, CASE WHEN backend = 'pandoc' AND by_pandoc THEN 'pandoc' WHEN by_calibre THEN 'calibre' WHEN by_pandoc THEN 'pandoc' ELSE 'calibre' END AS chosen FROM q)"""


@query(f"WITH {ROUTES}, {_SETS}, {_BACKEND} SELECT input, output, option_set, chosen AS backend FROM b")
def route_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark).select("input", "output", "option_set", routing.backend().alias("backend"))


@query(f"""WITH {ROUTES}, {_SETS}, {_BACKEND} SELECT input, output, option_set, CASE
 WHEN input = 'bok' THEN CASE output WHEN 'epub' THEN 'assemble' WHEN 'kfx' THEN 'assemble, to kfx' ELSE 'assemble, convert' END
 WHEN input = 'doc' THEN CASE output WHEN 'txt' THEN 'extract text' WHEN 'kfx' THEN 'none' ELSE 'extract text, convert' END
 WHEN input = 'pdf' THEN CASE output WHEN 'pdf' THEN 'none' WHEN 'kfx' THEN 'extract pages, epub, to kfx' ELSE 'extract pages, convert' END
 WHEN output = 'pdf' AND rtl AND input <> 'epub' THEN 'epub, right to left, pdf' WHEN input IN {_list(D.KFX_INPUTS)} THEN 'from kfx'
 WHEN output = 'kfx' THEN CASE WHEN input IN {_list(D.KFX_SOURCES)} THEN 'to kfx' ELSE 'none' END
 WHEN input = output AND NOT (input = 'epub' AND smarten) THEN 'none'
 WHEN NOT CASE chosen WHEN 'pandoc' THEN by_pandoc ELSE by_calibre END THEN 'none' WHEN input = 'epub' AND output = 'epub' THEN 'rebuild epub' ELSE chosen END AS plan FROM b""")
def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark).select("input", "output", "option_set", routing.plan().alias("plan"))


@query(f"""WITH {ROUTES}, {_SETS}, m AS (SELECT *, output IN {_list(D.PANDOC_ONLY_OUTPUTS)} OR input IN {_list(D.PANDOC_ONLY_INPUTS)} OR (backend = 'pandoc' AND input IN {_list(D.MENU_SHARED_INPUTS)} AND output IN {_list(D.MENU_SHARED_OUTPUTS)}) AS p FROM routes, s)
SELECT input, output, option_set, rtl AND CASE WHEN p THEN output IN {_list(D.RTL_OUTPUTS)} ELSE output IN ('epub', 'pdf') END AS force_rtl, CASE WHEN p THEN 'pandoc' ELSE 'calibre' END AS conversion_backend,
 smarten AND NOT p AND output IN {_list(D.COMMON_OUTPUTS)} AS smarten_punctuation, (CASE WHEN NOT p AND output IN {_list(D.COMMON_OUTPUTS)} THEN line_height END)::INT AS line_height, NOT p AND output = 'pdf' AS pdf_no_cover FROM m""")
def route_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = routing.effective_options()
    shown = ("force_rtl", "conversion_backend", "smarten_punctuation", "line_height", "pdf_no_cover")
    return _requests(spark).select("input", "output", "option_set", *[values[n].alias(n) for n in shown])


def _option_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clicks in an option menu."""
    k = F.get_json_object("props", "$.k").cast("int")
    keys, values = ("rtl", "line_height", "flat_toc", "reset", "kfx_pages", "unknown"), ("1", "0", "150", "auto", "250")
    at = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1 if n else F.floor(k / 10) % len(items) + 1).cast("int"))
    return P.table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), F.when(F.col("user_id") % 2 == 0, "epub").otherwise("pdf").alias("input"), at(keys, True).alias("key"), at(values, False).alias("value"))


@query("""WITH p AS (SELECT *, json_extract(props, '$.k')::INT AS k FROM events), l AS (SELECT user_id AS request, event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'epub' ELSE 'pdf' END AS input,
 ['rtl', 'line_height', 'flat_toc', 'reset', 'kfx_pages', 'unknown'][k % 6 + 1] AS key, ['1', '0', '150', 'auto', '250'][(k // 10) % 5 + 1] AS value FROM p),
v AS (SELECT request, seq, CASE key WHEN 'rtl' THEN 'force_rtl' ELSE key END AS option, CASE WHEN key = 'reset' THEN '' WHEN key = 'rtl' OR (key = 'flat_toc' AND input = 'epub') THEN CASE value WHEN '1' THEN 'true' WHEN '0' THEN 'false' END
 WHEN key = 'line_height' AND value = '150' THEN '150' WHEN key = 'kfx_pages' AND value = 'auto' THEN '0' END AS new FROM l),
z AS (SELECT request, max(seq) AS z FROM v WHERE option = 'reset' GROUP BY request)
SELECT v.request, option, arg_max(new, seq) AS value FROM v LEFT JOIN z ON v.request = z.request WHERE new IS NOT NULL AND option <> 'reset' AND (z IS NULL OR seq > z) GROUP BY v.request, option""")
def option_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.options_after(routing.option_events(_option_log(spark, sf_dir)))


def _saved_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts of every kind: good, of wrong types, out of range, malformed, and no object."""
    kinds = ('{"force_rtl":true,"line_height":150,"options_context":"epub","flat_toc":true}', '{"force_rtl":"yes","line_height":250,"pdf_paper_size":"a4","flat_toc":1}', '{"force_rtl": true', '["force_rtl"]', '{"kfx_pages":0,"pandoc_heading_shift":-1,"options_context":"zip"}')
    text = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    return P.table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "epub").otherwise("pdf").alias("input"), text.alias("options_json"))


@query("""SELECT event_id, event_id % 5 = 0 AS force_rtl, CASE WHEN event_id % 5 = 0 THEN 150 END::INT AS line_height, event_id % 5 = 0 AND user_id % 2 = 0 AS flat_toc, CASE WHEN event_id % 5 = 1 THEN 'a4' ELSE 'default' END AS pdf_paper_size,
CASE WHEN event_id % 5 = 0 THEN 'epub' ELSE 'docx' END AS options_context, CASE WHEN event_id % 5 = 4 THEN 0 END::INT AS kfx_pages, CASE WHEN event_id % 5 = 4 THEN -1 ELSE 0 END::INT AS pandoc_heading_shift, true AS pdf_no_cover FROM events""")
def persisted_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = routing.persisted_options(F.col("options_json"), F.col("input"))
    shown = ("force_rtl", "line_height", "flat_toc", "pdf_paper_size", "options_context", "kfx_pages", "pandoc_heading_shift", "pdf_no_cover")
    return _saved_options(spark, sf_dir).select("event_id", *[values[n].alias(n) for n in shown])


# ---------------------------------------------------------------- structure


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), "pos", (F.col("l_partkey") % 3).cast("string").alias("id"), (F.col("l_returnflag") == "N").alias("exists"))


@query(f"""WITH {LINES}, m AS (SELECT l_orderkey AS book, pos, (l_partkey % 3)::VARCHAR AS id, l_returnflag = 'N' AS exists FROM li)
SELECT book, pos, id, exists FROM m QUALIFY row_number() OVER (PARTITION BY book, id ORDER BY exists DESC, pos DESC) = 1""")
def manifest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unique_items(_manifest(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as container entries with clashing names, some in another letter case."""
    k = F.col("l_partkey") % 7
    name = F.when(k == 0, "mimetype").when(F.col("l_returnflag") == "A", F.concat(F.lit("OEBPS/Text/Page_"), k, F.lit(".xhtml"))).otherwise(F.concat(F.lit("OEBPS/Text/page_"), k, F.lit(".xhtml")))
    return P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), "pos", name.alias("name"), F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(8).alias("compress_type"))


ENTRIES = f"""{LINES}, en AS (SELECT l_orderkey AS book, pos, CASE WHEN l_partkey % 7 = 0 THEN 'mimetype' WHEN l_returnflag = 'A' THEN 'OEBPS/Text/Page_' || (l_partkey % 7) || '.xhtml' ELSE 'OEBPS/Text/page_' || (l_partkey % 7) || '.xhtml' END AS name,
 CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 8 END AS compress_type FROM li)"""


@query(f"WITH {ENTRIES} SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY book, name ORDER BY pos DESC) = 1")
def zip_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unique_entries(_entries(spark, sf_dir))


@query(f"""WITH {ENTRIES}, n AS (SELECT book, name, count(*) AS n, arg_max(compress_type, pos) AS how FROM en GROUP BY ALL)
SELECT book, max(n) > 1 OR coalesce(bool_or(name = 'mimetype' AND how <> 0), false) AS dirty FROM n GROUP BY book""")
def containers_to_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.needs_cleanup(_entries(spark, sf_dir))


@query(f"""WITH {ENTRIES}, nm AS (SELECT DISTINCT book, name FROM en), lo AS (SELECT book, lower(name) AS l, count(*) AS n, max(name) AS actual FROM nm GROUP BY ALL),
it AS (SELECT l_orderkey AS book, pos, 'Text/page_' || (l_suppkey % 7) || '.xhtml' || CASE WHEN pos % 2 = 0 THEN '#a' ELSE '' END AS href, 'OEBPS/Text/page_' || (l_suppkey % 7) || '.xhtml' AS path FROM li)
SELECT it.book, it.pos, CASE WHEN nm.name IS NOT NULL OR coalesce(n, 0) <> 1 THEN href ELSE substr(actual, 7) || CASE WHEN pos % 2 = 0 THEN '#a' ELSE '' END END AS href, nm.name IS NOT NULL OR coalesce(n, 0) = 1 AS exists
FROM it LEFT JOIN nm ON nm.book = it.book AND nm.name = path LEFT JOIN lo ON lo.book = it.book AND l = lower(path)""")
def href_case_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.concat(F.lit("Text/./page_"), F.col("l_suppkey") % 7, F.lit(".xhtml"), F.when(F.col("pos") % 2 == 0, "#a").otherwise(""))
    items = P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), "pos", F.lit("OEBPS").alias("directory"), F.replace(href, F.lit("./"), F.lit("")).alias("href"))
    return structure.with_fixed_case(items, _entries(spark, sf_dir)).drop("directory")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    idref = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("x_"), F.col("pos"))).otherwise(F.concat(F.lit("page_"), F.col("l_partkey")))
    return P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), "pos", idref.alias("idref"))


PAGED = f"{LINES}, pg AS (SELECT l_orderkey AS book, pos, CASE WHEN l_returnflag = 'R' THEN 'x_' || pos ELSE 'page_' || l_partkey END AS idref FROM li)"


@query(f"""WITH {PAGED}, p AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos) AS slot, row_number() OVER (PARTITION BY book ORDER BY substr(idref, 6)::BIGINT, pos) AS rank FROM pg WHERE idref LIKE 'page%')
SELECT book, pos, idref FROM pg WHERE idref NOT LIKE 'page%' UNION ALL SELECT a.book, b.pos, a.idref FROM p a JOIN p b ON a.book = b.book AND a.rank = b.slot""")
def slot_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pages_in_order(_paged(spark, sf_dir), "idref")


@query(f"""WITH {LINES}, sp AS (SELECT l_orderkey AS book, pos, (l_partkey % 4)::VARCHAR AS idref FROM li), it AS (SELECT DISTINCT l_orderkey AS book, (l_suppkey % 4)::VARCHAR AS idref FROM li)
SELECT sp.* FROM sp SEMI JOIN it ON sp.book = it.book AND sp.idref = it.idref QUALIFY row_number() OVER (PARTITION BY sp.book, sp.idref ORDER BY pos) = 1""")
def spine_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.numbered_lines(spark, sf_dir)
    spine = lines.select(F.col("l_orderkey").alias("book"), "pos", (F.col("l_partkey") % 4).cast("string").alias("idref"))
    return structure.clean_spine(spine, lines.select(F.col("l_orderkey").alias("book"), (F.col("l_suppkey") % 4).cast("string").alias("id")))


@query(f"""WITH {PAGED}, fr AS (SELECT DISTINCT l_orderkey AS book, ['titlepage', 'intro', 'book_info'][l_suppkey % 3 + 1] AS idref, l_suppkey % 3 AS f FROM li WHERE l_linestatus = 'O'),
st AS (SELECT book, coalesce(min(pos) FILTER (idref LIKE 'page%'), max(pos) + 1) AS spot FROM pg GROUP BY book),
al AS (SELECT book, idref, pos AS spot, 99 AS f FROM pg UNION ALL SELECT fr.book, idref, spot, f FROM fr JOIN st USING (book)) SELECT book, (row_number() OVER (PARTITION BY book ORDER BY spot, f) - 1)::INT AS pos, idref FROM al""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.numbered_lines(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, structure.FRONT)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    items = lines.select(F.col("l_orderkey").alias("book"), name.alias("id"), (F.col("l_linestatus") == "O").alias("exists")).where("exists").distinct()
    return structure.with_front_matter(_paged(spark, sf_dir), items)


@query(f"""WITH {ENTRIES}, ex AS (SELECT DISTINCT l_orderkey AS book, 'oebps/text/page_' || (l_suppkey % 7) || '.xhtml' AS l FROM li) SELECT book, name, pos FROM en WHERE name <> 'mimetype' AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.book = en.book AND l = lower(name))""")
def passthrough_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), F.concat(F.lit("OEBPS/TEXT/page_"), F.col("l_suppkey") % 7, F.lit(".xhtml")).alias("name"))
    return structure.passed_through(_entries(spark, sf_dir), pages).select("book", "name", "pos")


@query(f"""WITH {ENTRIES}, c AS (SELECT l_orderkey AS book, pos AS spot, 'oebps/text/page_' || (l_suppkey % 7) || '.xhtml' AS l, 'OEBPS/Text/page_' || (l_suppkey % 7) || '.xhtml' AS path FROM li),
m AS (SELECT c.book, spot, coalesce(max(name) FILTER (name = path), arg_max(name, pos)) AS entry FROM c JOIN en ON en.book = c.book AND lower(name) = l GROUP BY c.book, spot) SELECT book, 'page' AS what, arg_min(entry, spot) AS entry FROM m GROUP BY book""")
def found_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit(" /OEBPS/Text/page_"), F.col("l_suppkey") % 7, F.lit(".xhtml/ "))
    wanted = P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), F.lit("page").alias("what"), F.col("pos").alias("at"), path.alias("candidate"))
    return structure.find_entry(wanted, _entries(spark, sf_dir))


# ---------------------------------------------------------------- contents


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), "pos", (1 + F.col("l_suppkey") % 5).cast("int").alias("level"))


LEVELED = f"{LINES}, lv AS (SELECT l_orderkey AS book, pos, (1 + l_suppkey % 5)::INT AS level FROM li)"


NESTED = f"WITH {LEVELED} SELECT a.book, a.pos, a.level, max(b.pos) AS parent FROM lv a LEFT JOIN lv b ON a.book = b.book AND b.pos < a.pos AND b.level < a.level GROUP BY a.book, a.pos, a.level"


@query(NESTED)
def toc_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.nested_by_levels(_leveled(spark, sf_dir), 5).drop("path")


@query(NESTED)
def toc_nest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items where levels may be any numbers."""
    return toc.nested(_leveled(spark, sf_dir))


TREE = f"""{LEVELED}, pa AS (SELECT a.book, a.pos, max(b.pos) AS parent FROM lv a LEFT JOIN lv b ON a.book = b.book AND b.pos < a.pos AND b.level < a.level GROUP BY a.book, a.pos),
tree AS (WITH RECURSIVE t AS (SELECT book, pos, parent, [pos] AS path FROM pa WHERE parent IS NULL UNION ALL SELECT pa.book, pa.pos, pa.parent, list_append(t.path, pa.pos) FROM pa JOIN t ON pa.book = t.book AND pa.parent = t.pos) SELECT * FROM t)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.nested_by_levels(_leveled(spark, sf_dir), 5).withColumnRenamed("pos", "node")


@query(f"WITH {TREE} SELECT book, pos AS node, list_transform(path, lambda x: x::VARCHAR)::VARCHAR AS path, (row_number() OVER (PARTITION BY book ORDER BY path))::INT AS play_order FROM tree")
def toc_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = toc.flattened(_tree(spark, sf_dir))
    return flat.select("book", "node", F.concat(F.lit("["), F.array_join(F.transform("path", lambda x: x.cast("string")), ", "), F.lit("]")).alias("path"), "play_order")


def _toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of which some have a page, some a link to one, some neither."""
    key = F.col("book") + F.col("node")
    return _tree(spark, sf_dir).withColumns({"page": F.when(key % 4 == 0, (F.col("book") + F.col("node") * 3) % 50 + 1), "href": F.when(key % 4 == 1, F.concat(F.lit("Text/P"), F.col("node") % 3, F.lit(".xhtml")))})


RESOLVED = f"""{TREE}, al AS (SELECT o_orderkey AS book, 'text/p' || n || '.xhtml' AS href, o_orderkey % 10 + n + 1 AS page FROM orders, (VALUES (0), (1)) v(n)),
nd AS (SELECT t.book, pos AS node, parent, path, coalesce(CASE WHEN (t.book + pos) % 4 = 0 THEN (t.book + pos * 3) % 50 + 1 END, al.page) AS page FROM tree t LEFT JOIN al ON al.book = t.book AND (t.book + pos) % 4 = 1 AND al.href = 'text/p' || (pos % 3) || '.xhtml'),
best AS (SELECT book, u.n AS node, arg_min(page, node) AS page FROM nd, LATERAL (SELECT unnest(path) AS n) u WHERE page IS NOT NULL GROUP BY book, u.n),
rs AS (SELECT nd.book, nd.node, nd.parent, nd.path, coalesce(nd.page, best.page) AS page FROM nd JOIN best ON nd.book = best.book AND nd.node = best.node)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda n: F.struct(F.lit(f"/OEBPS/Text/p{n}.xhtml").alias("name"), (F.col("o_orderkey") % 10 + n + 1).alias("page_number"))
    pages = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), F.explode(F.array(name(0), name(1))).alias("p")).select("book", "p.*")
    return toc.resolved(_toc_pages(spark, sf_dir), toc.page_aliases(pages))


@query(f"WITH {RESOLVED} SELECT book, node, parent, page FROM rs")
def toc_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("book", "node", "parent", "page")


@query(f"""WITH {RESOLVED}, k AS (SELECT * FROM rs WHERE page BETWEEN 10 AND 30), up AS (SELECT k.book, k.node, u.n FROM k, LATERAL (SELECT unnest(path) AS n) u WHERE u.n <> k.node)
SELECT k.book, k.node, any_value(k.page) AS page, max(a.node) AS parent FROM k LEFT JOIN up ON up.book = k.book AND up.node = k.node LEFT JOIN k a ON a.book = up.book AND a.node = up.n GROUP BY k.book, k.node""")
def toc_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _resolved(spark, sf_dir)
    ranges = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), F.lit(1).alias("part"), F.lit(10).alias("first"), F.lit(30).alias("last"))
    return toc.cut(nodes, ranges).select("book", "node", "page", "parent")


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as pages; some as starts, beyond both ends too."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), "o_orderkey", (F.row_number().over(order) + 2).alias("page_number"))
    starts = rows.where("o_orderkey % 3 = 0").select("book", (F.col("page_number") + F.col("o_orderkey") % 5 - 1).cast("int").alias("page"))
    return toc.volumes(rows.select("book", "page_number"), starts)


@query("""WITH p AS (SELECT o_custkey AS book, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 2)::INT AS n FROM orders), b AS (SELECT book, min(n) AS lo, max(n) AS hi FROM p GROUP BY book),
s AS (SELECT p.book, n + o_orderkey % 5 - 1 AS page, lo, hi FROM p JOIN b USING (book) WHERE o_orderkey % 3 = 0), c AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) AS k FROM s WHERE page > 0 AND page <= hi),
d AS (SELECT book, k, CASE WHEN k = 1 THEN least(page, lo) ELSE page END AS page, hi FROM c), r AS (SELECT book, k, page, coalesce(lead(page) OVER (PARTITION BY book ORDER BY k), hi + 1) AS upto FROM d),
g AS (SELECT p.book, p.n AS page_number, r.k AS volume FROM p JOIN r ON p.book = r.book AND p.n >= r.page AND p.n < r.upto) SELECT * FROM g WHERE book IN (SELECT book FROM g GROUP BY book HAVING count(DISTINCT volume) > 1)""")
def volume_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volumes(spark, sf_dir)


@query(ORACLE_SQL["volume_groups"].replace("SELECT * FROM g WHERE", "SELECT book, volume, min(page_number) AS first, max(page_number) AS last, count(*) AS pages FROM g WHERE") + " AND book NOT IN (SELECT book FROM g GROUP BY book HAVING count(DISTINCT volume) > 4) GROUP BY book, volume")
def volume_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.within_cap(toc.volume_bounds(_volumes(spark, sf_dir)), cap=4)


@query(f"""WITH {LINES}, b AS (SELECT l_orderkey AS book, pos AS node, CASE WHEN l_partkey % 3 = 0 THEN pos END AS parent, l_suppkey % 20 - 2 AS page, l_returnflag = 'N' AS nav FROM li), l AS (SELECT book, 15 AS last FROM (SELECT DISTINCT book FROM b)),
u AS (SELECT book, count(*) FILTER (nav) AS v_all, count(*) FILTER (NOT nav) AS x_all, count(*) FILTER (nav AND parent IS NULL AND page > 0 AND page <= 15) AS v, count(*) FILTER (NOT nav AND parent IS NULL AND page > 0 AND page <= 15) AS x FROM b GROUP BY book)
SELECT b.book, node, page FROM b JOIN u USING (book) WHERE nav <> (v_all = 0 OR (x_all > 0 AND x > v))""")
def toc_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), F.col("pos").alias("node"), F.when(F.col("l_partkey") % 3 == 0, F.col("pos")).alias("parent"), (F.col("l_suppkey") % 20 - 2).alias("page"), (F.col("l_returnflag") == "N").alias("_nav"))
    last = rows.select("book").distinct().withColumn("last", F.lit(15))
    return toc.better_toc(rows.where("_nav").drop("_nav"), rows.where("NOT _nav").drop("_nav"), last).select("book", "node", "page")


# ---------------------------------------------------------------- text


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", "text")


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM documents")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(T.escape_xml(F.col("text")), 256).alias("escaped"))


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS plain FROM pages")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("plain"))


@query(f"SELECT page_id, sha256(regexp_replace(html, '<({T.VOID_TAGS})(\\s[^>]*)?/?>', '<\\1\\2 />', 'gi')) AS xhtml FROM pages")
def closed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "pages").select("page_id", F.sha2(T.close_void_tags(F.col("html")), 256).alias("xhtml"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(url || ' : ?  x ', '[/:*?\"<>|]+', '_', 'g'), '\\s+', ' ', 'g')) AS file_name FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "pages").select("page_id", T.file_name(F.concat("url", F.lit(" : ?  x "))).alias("file_name"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN NULL WHEN 2 THEN event_id % 10 ELSE NULL END::BIGINT AS number, CASE WHEN event_id % 4 = 0 THEN event_id ELSE -1 END::BIGINT AS or_else FROM events""")
def parsed_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    arabic = F.translate((F.col("event_id") % 10).cast("string"), T.ASCII_DIGITS, T.ARABIC_DIGITS)
    text = F.when(kind == 0, F.concat(F.lit(" "), F.col("event_id"), F.lit(" "))).when(kind == 1, F.concat(F.lit("x"), F.col("event_id"))).when(kind == 2, arabic)
    return P.table(spark, sf_dir, "events").select("event_id", T.to_integer(text).alias("number"), T.integer_or(text, -1).alias("or_else"))


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || upper(lang) || '_EG ' WHEN 1 THEN 'ar-EG' WHEN 2 THEN 'He' ELSE NULL END AS tag, CASE doc_id % 3 WHEN 0 THEN ' RTL ' WHEN 1 THEN 'none' ELSE '' END AS dir FROM documents),
n AS (SELECT doc_id, replace(lower(trim(coalesce(tag, ''))), '_', '-') AS tag, CASE WHEN lower(trim(dir)) IN ('rtl', 'ltr') THEN lower(trim(dir)) ELSE '' END AS dir FROM l)
SELECT doc_id, tag AS language, CASE WHEN string_split(tag, '-')[1] IN ('ar', 'en') THEN string_split(tag, '-')[1] ELSE 'en' END AS volume_language,
CASE WHEN dir <> '' THEN dir WHEN string_split(tag, '-')[1] IN ('ar', 'dv', 'fa', 'he', 'ku', 'ps', 'sd', 'ug', 'ur', 'yi') THEN 'rtl' ELSE 'ltr' END AS direction FROM n""")
def languages_and_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, j = F.col("doc_id") % 4, F.col("doc_id") % 3
    tag = F.when(k == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit("_EG "))).when(k == 1, "ar-EG").when(k == 2, "He")
    direction = T.page_direction(F.when(j == 0, " RTL ").when(j == 1, "none").otherwise(""))
    return P.table(spark, sf_dir, "documents").select("doc_id", T.normal_language(tag).alias("language"), T.volume_language(tag).alias("volume_language"), T.text_direction(tag, direction).alias("direction"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END::BIGINT AS page FROM events""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_id") % 3 == 0, F.format_string("OEBPS/Text/page_1_%05d.XHTML", "event_id")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Text/chapter"), F.col("event_id"), F.lit(".xhtml"))).otherwise("page_1_.xhtml")
    return P.table(spark, sf_dir, "events").select("event_id", T.page_of_file(name, F.lit(-1).cast("bigint")).alias("page"))


# Lines of a text in SQL: a long line is cut before white space and a numbered item, where that gives two parts or more.
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_lines(x: str) -> str:
    cut = f"list_filter(list_transform(string_split(regexp_replace(y, '(^|\\s)(([0-9]{{1,4}}|[٠-٩]{{1,4}}|[۰-۹]{{1,4}})\\s*[-–—]\\s+)', chr(1) || '\\1\\2', 'g'), chr(1)), lambda z: {_strip('z')}), lambda z: z <> '')"
    lines = f"list_filter(list_transform(string_split_regex(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n+'), lambda w: {_strip('w')}), lambda w: w <> '')"
    return f"flatten(list_transform({lines}, lambda y: CASE WHEN length(y) >= 220 AND len({cut}) >= 2 THEN {cut} ELSE [y] END))"


def sql_escaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"""WITH l AS (SELECT doc_id, text, {sql_lines('text')} AS x FROM documents)
SELECT doc_id, len(x)::INT AS n_lines, length(regexp_replace(text, '\\s', '', 'g'))::INT AS visible, sha256(array_to_string(x, chr(10))) AS lines FROM l""")
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.plain_lines(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(lines).alias("n_lines"), T.visible_length(F.col("text")).alias("visible"), F.sha2(F.array_join(lines, "\n"), 256).alias("lines"))


@query(f"""WITH l AS (SELECT doc_id, {sql_lines('text')} AS x FROM documents), e AS (SELECT doc_id, unnest(range(len(x)))::INT AS pos, x FROM l)
SELECT doc_id, pos, '<p>' || {sql_escaped('x[pos + 1]')} || '</p>' AS paragraph FROM e""")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS x FROM documents) SELECT doc_id, len(b)::INT AS n_blocks, sha256(array_to_string(b, chr(10))) AS blocks FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(array_to_string(list_transform(x, lambda y: CASE WHEN y = '' THEN chr(30) ELSE y END), ' '), '( ?' || chr(30) || ')+ ?'), lambda y: trim(y)), lambda y: y <> '') AS b FROM l)""")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = T.blocks(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(blocks).alias("n_blocks"), F.sha2(F.array_join(blocks, "\n"), 256).alias("blocks"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS speakers FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NULL OR before <> role GROUP BY conv_id""")
def headings_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = P.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return turns.select("conv_id", F.array_join(T.headings_once(F.col("roles")), ",").alias("speakers"))


# ---------------------------------------------------------------- footnotes


_MARK = "'\\(\\^?[0-9]+\\)|\\[\\^?[0-9]+\\]'"


@query(f"""WITH d AS (SELECT doc_id, text || ' ﴿a (' || doc_id || ')﴾ b [^' || doc_id % 7 || '] ﴾ c (3)' AS t FROM documents), m AS (SELECT doc_id, t, regexp_extract_all(t, {_MARK}) AS hits, string_split_regex(t, {_MARK}) AS gaps FROM d),
x AS (SELECT doc_id, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m), s AS (SELECT doc_id, t, hits[i] AS hit, i, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::BIGINT AS start FROM x)
SELECT doc_id, i::INT AS n, start::INT AS start, (start + length(hit))::INT AS stop, regexp_extract(hit, '[0-9]+') AS number, hit LIKE '%^%' AS caret, CASE WHEN hit LIKE '[%' THEN 'square' ELSE 'paren' END AS bracket,
 len(string_split(substr(t, 1, start), '﴿')) > len(string_split(substr(t, 1, start), '﴾')) OR right(rtrim(substr(t, 1, start), ' ' || chr(10)), 1) = '﴿' OR left(ltrim(substr(t, start + length(hit) + 1), ' ' || chr(10)), 1) = '﴾' AS verse FROM s""")
def reference_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All markers of all texts, each text with three more at its end."""
    text = F.concat("text", F.lit(" ﴿a ("), "doc_id", F.lit(")﴾ b [^"), F.col("doc_id") % 7, F.lit("] ﴾ c (3)"))
    found = _documents(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", F.posexplode(footnotes.markers(F.col("t"))).alias("k", "m"))
    return found.select("doc_id", (F.col("k") + 1).alias("n"), "m.start", F.col("m.end").alias("stop"), "m.number", "m.caret", "m.bracket", "m.verse")


_NOTE = "{{'number': ({0} % 4)::VARCHAR, 'caret': {1} % 2 = 0, 'bracket': CASE WHEN l_returnflag = 'A' THEN 'square' ELSE 'paren' END, 'verse': l_linestatus = 'O'}}"


@query(f"""WITH RECURSIVE {LINES}, p AS (SELECT l_orderkey AS page, list({_NOTE.format('l_suppkey', 'l_partkey')} ORDER BY pos) AS n, list({_NOTE.format('l_partkey', 'l_suppkey')} ORDER BY pos) AS c FROM li GROUP BY l_orderkey),
st AS (SELECT page, n, c, 0 AS k, 0 AS cursor, []::INT[] AS picks FROM p UNION ALL
 SELECT page, n, c, k + 1, coalesce(pick + 1, cursor)::INT, list_append(picks, pick::INT) FROM (SELECT *, list_sort(list_transform(list_filter(range(cursor, len(c)), lambda i: c[i + 1].number = n[k + 1].number),
  lambda i: {{'a': c[i + 1].caret <> n[k + 1].caret, 'b': c[i + 1].bracket <> n[k + 1].bracket, 'v': c[i + 1].verse AND NOT c[i + 1].caret, 'k': i}}))[1].k AS pick FROM st WHERE k < len(n)))
SELECT page, array_to_string(list_transform(picks, lambda x: coalesce(x::VARCHAR, '-')), ',') AS picked FROM st WHERE k = len(n)""")
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy linking of notes to markers."""
    parts = lambda key, k: F.struct((F.col(key) % 4).cast("string").alias("number"), (F.col(k) % 2 == 0).alias("caret"), F.when(F.col("l_returnflag") == "A", "square").otherwise("paren").alias("bracket"), (F.col("l_linestatus") == "O").alias("verse"))
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("x")))), lambda y: y["x"])
    pages = P.numbered_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("page")).agg(ordered(parts("l_suppkey", "l_partkey")).alias("notes"), ordered(parts("l_partkey", "l_suppkey")).alias("candidates"))
    return pages.select("page", F.array_join(footnotes.links(F.col("notes"), F.col("candidates")), ",", "-").alias("picked"))


NOTE_PAGES = "pg AS (SELECT conv_id AS book, turn AS page_no, CASE WHEN (conv_id + turn) % 3 = 0 THEN text END AS last_note, CASE WHEN (conv_id * 7 + turn) % 2 = 0 THEN text END AS continuation FROM conversations)"


@query(f"""WITH {NOTE_PAGES}, f AS (SELECT *, coalesce(bool_or(last_note IS NOT NULL OR continuation IS NOT NULL) OVER w, false) AS before_ FROM pg WINDOW w AS (PARTITION BY book ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN last_note IS NOT NULL OR (continuation IS NOT NULL AND NOT before_) THEN page_no END AS anchor FROM f),
t AS (SELECT *, CASE WHEN continuation IS NOT NULL THEN max(anchor) OVER (PARTITION BY book ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target FROM a),
m AS (SELECT book, target AS page_no, string_agg(continuation, '<br />' ORDER BY t.page_no) AS more FROM t WHERE target IS NOT NULL GROUP BY book, target)
SELECT t.book, t.page_no, CASE WHEN more IS NULL THEN own ELSE concat_ws('<br />', nullif(own, ''), more) END AS last_note, CASE WHEN target IS NULL THEN continuation END AS continuation, target IS NOT NULL AS moved
FROM (SELECT *, coalesce(last_note, CASE WHEN target IS NULL THEN '=' || continuation END) AS own FROM t) t LEFT JOIN m ON t.book = m.book AND t.page_no = m.page_no""")
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("book"), F.col("turn").alias("page_no"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.col("text")).alias("last_note"), F.when((F.col("conv_id") * 7 + F.col("turn")) % 2 == 0, F.col("text")).alias("continuation"),
    )
    return footnotes.carried_back(pages)


@query("SELECT conv_id AS book, turn AS page_no, (length(text) % 5)::INT AS n_notes, (coalesce(sum(length(text) % 5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_note FROM conversations")
def renumbered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footnotes.renumbered(P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page_no"), (F.length("text") % 5).alias("n_notes")))


@query(f"""WITH {LINES}, b AS (SELECT l_orderkey AS page, pos, l_partkey % 3 AS k FROM li), g AS (SELECT page, pos, sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos) AS id, k FROM b),
first_ AS (SELECT page, min(pos) AS p FROM b GROUP BY page), c AS (SELECT g.*, CASE WHEN k = 0 AND pos = p THEN true ELSE false END AS lead_ FROM g JOIN first_ USING (page)) SELECT page, id::BIGINT AS note_id, '(' || min(pos) FILTER (k > 0) || ')' AS number, string_agg('text ' || pos, '<br />' ORDER BY pos) AS content FROM c WHERE id > 0 GROUP BY page, id""")
def note_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each order: lines with a number begin a note, others belong to the note before."""
    line = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("text "), F.col("pos"))).otherwise(F.concat(F.lit("("), F.col("pos"), F.lit(") text "), F.col("pos")))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))), lambda y: y["x"]), "<br/>")
    blocks = P.numbered_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("page")).agg(F.concat(F.lit('<p class="hamesh">'), html, F.lit("</p>")).alias("html")).withColumn("block", F.lit(0))
    return footnotes.notes(blocks).select("page", "note_id", "number", "content")


# ---------------------------------------------------------------- assembly


@query("SELECT book, arg_min(tbl, (-n, tbl)) AS \"table\" FROM (SELECT o_custkey AS book, CASE WHEN o_orderstatus = 'F' THEN 'B' ELSE 'b' END || (o_orderkey % 9) AS tbl, o_orderkey % 4 AS n FROM orders WHERE o_orderstatus <> 'P') GROUP BY book")
def content_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "P", "Main").when(F.col("o_orderstatus") == "F", F.concat(F.lit("B"), F.col("o_orderkey") % 9)).otherwise(F.concat(F.lit("b"), F.col("o_orderkey") % 9))
    return assembly.content_table(P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), name.alias("table"), (F.col("o_orderkey") % 4).alias("rows")), "b")


@query("""WITH r AS (SELECT o_custkey AS book, o_orderkey % 300 AS hno, o_orderkey % 90 AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), m AS (SELECT book, max(hno) AS h, max(page) AS p FROM r WHERE r <= 80 GROUP BY book)
SELECT book, CASE WHEN h > greatest(50, p + 50) THEN 'hno' ELSE 'page' END AS page_column FROM m""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.page_column(P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 300).alias("hno"), (F.col("o_orderkey") % 90).alias("page")))


def _toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("l_partkey") % 11 == 0, "الجزء الأول").when(F.col("l_partkey") % 13 == 0, "  ").otherwise(F.concat(F.lit(" part "), F.col("l_partkey") % 4, F.lit(" ")))
    level = F.when(F.col("l_suppkey") % 4 < 3, (F.col("l_suppkey") % 4 - 1).cast("bigint"))
    return P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("book"), "pos", F.when(F.col("l_suppkey") % 7 > 0, F.col("l_suppkey") % 3).alias("start"), text.alias("text"), level.alias("level"))


RAW_TOC = f"""{LINES}, e AS (SELECT l_orderkey AS book, pos, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 3 END AS start, CASE WHEN l_partkey % 11 = 0 THEN 'الجزء الأول' WHEN l_partkey % 13 = 0 THEN '' ELSE 'part ' || (l_partkey % 4) END AS text,
 CASE WHEN l_suppkey % 4 < 3 THEN l_suppkey % 4 - 1 END AS level FROM li), d AS (SELECT * FROM e WHERE text <> '' AND text NOT LIKE 'الجزء %' AND start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book, start, text, nullif(level, 0) ORDER BY pos) = 1),
raw AS (SELECT book, pos, start, text, CASE WHEN min(level) OVER (PARTITION BY book) <> 1 THEN level - min(level) OVER (PARTITION BY book) + 1 ELSE level END AS level FROM d)"""


@query(f"WITH {RAW_TOC} SELECT * FROM raw")
def raw_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.raw_toc(_toc_entries(spark, sf_dir))


@query(f"""WITH {RAW_TOC}, j AS (SELECT book, pos, coalesce(CASE WHEN start = 2 THEN book % 5 + 1 END, CASE WHEN start = 0 THEN 1 END) AS page, text, CASE WHEN start = 0 THEN '' ELSE 'toc_' || start END AS anchor, level FROM raw)
SELECT * FROM j WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book, page, text, nullif(level, 0) ORDER BY pos) = 1""")
def mapped_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"), F.lit(2).cast("bigint").alias("id"), (F.col("o_orderkey") % 5 + 1).alias("page_number"), F.lit("").alias("snippet"))
    return assembly.mapped_toc(assembly.raw_toc(_toc_entries(spark, sf_dir)), ids)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows of a book's content table."""
    return P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), "text", F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("id"), (F.col("turn") + 1).alias("page"), F.lit("٢").alias("part"))


_PARAS = f"list_transform({sql_lines('text')}, lambda q: '<p>' || {sql_escaped('q')} || '</p>')"
BUILT = f"""r AS (SELECT conv_id AS book, turn AS pos, turn % 3 > 0 AS has_id, {_strip('text')} AS text FROM conversations), pg AS (SELECT book, pos, (row_number() OVER (PARTITION BY book ORDER BY pos))::INT AS page_number, has_id, {_PARAS} AS paras FROM r WHERE text <> '')"""


@query(f"""WITH {BUILT} SELECT book, pos, page_number, pos + 1 AS page, 2::BIGINT AS part, CASE WHEN has_id THEN pos END AS id, has_id AS anchored,
 '<div>' || CASE WHEN has_id AND pos % 2 = 1 THEN '<a id="toc_' || pos || '"></a>' ELSE '' END || array_to_string(paras, '') || '</div><div class="text-center">الجزء: 2 - الصفحة: ' || (pos + 1) || '</div>' AS text_html FROM pg""")
def built_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return assembly.pages(rows, rows.where("id % 2 = 1").select("book", "id"), split_numbered=False).select("book", "pos", "page_number", "page", "part", "id", "anchored", "text_html")


@query(f"""WITH {BUILT} SELECT book, pos AS id, page_number, trim(array_to_string(list_transform(paras[1:2], lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), chr(10))) AS snippet FROM pg WHERE has_id""")
def pages_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    paged = assembly.pages(rows, rows.where("id % 2 = 1").select("book", "id"), split_numbered=False)
    return assembly.page_of_ids(paged).select("book", "id", "page_number", "snippet")


@query("""WITH r AS (SELECT conv_id AS book, turn AS n, CASE WHEN turn % 2 = 0 THEN 'سورة ' || (turn % 3) ELSE 'other' END AS text FROM conversations) SELECT book, min(n)::INT AS page_number, text FROM r WHERE text LIKE 'سورة %' GROUP BY book, text""")
def auto_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<div><P class='x'>سورة  <b>"), F.col("turn") % 3, F.lit("</b></p><p>x</p></div>"))).otherwise("<p>other</p>")
    return assembly.automatic_toc(P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("page_number"), title.alias("text_html")))


# ---------------------------------------------------------------- requests


@query("""WITH g AS (SELECT user_id AS request, ts AS t, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS b FROM events), n AS (SELECT *, sum(b) OVER (PARTITION BY request ORDER BY t) AS life FROM g)
SELECT request, min(t) AS started, max(t) AS last, count(*) AS accesses FROM n GROUP BY request, life""")
def request_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.lives(P.table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("ts").alias("at")))


@query("SELECT event_id, epoch(ts)::DOUBLE AS queued_at FROM events WHERE epoch((SELECT max(ts) FROM events)) - epoch(ts) <= 86400")
def remaining_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = P.table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("queued_at"))
    now = queue.agg(F.max("queued_at")).first()[0]
    return requests.remaining(queue, now, 86400)


# ---------------------------------------------------------------- rendering


@query(f"""WITH {ROUTES}, {_SETS}, {_BACKEND} SELECT input, output, option_set, CASE WHEN chosen = 'pandoc' THEN '' ELSE array_to_string(list_filter([CASE WHEN smarten THEN '--smarten-punctuation' END, CASE WHEN line_height IS NOT NULL THEN '--minimum-line-height ' || line_height END,
 CASE WHEN output = 'docx' THEN '--filter-css float' END, CASE WHEN output = 'pdf' THEN '--pdf-no-cover' END], lambda x: x IS NOT NULL), ' ') END AS arguments,
 array_to_string(list_filter([CASE WHEN input = 'docx' THEN 'docx-cleanup' END, 'empty-blocks', 'arabic-punctuation', CASE WHEN output = 'md' THEN 'bidi-cleanup' END, CASE WHEN rtl AND output IN {_list(D.RTL_OUTPUTS)} THEN 'rtl-wrap' END], lambda x: x IS NOT NULL), ' ') AS filters,
 CASE WHEN input = 'epub' AND chosen = 'calibre' AND rtl THEN 'right to left' ELSE '' END AS preparation FROM b""")
def route_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = routing.backend()
    arguments = F.when(chosen == "pandoc", render.pandoc_arguments()).otherwise(render.calibre_arguments())
    return _requests(spark).select("input", "output", "option_set", F.array_join(arguments, " ").alias("arguments"), F.array_join(render.pandoc_filters(), " ").alias("filters"), F.array_join(render.preparation(chosen), " ").alias("preparation"))


@query(f"""WITH {TREE}, n AS (SELECT book, path, pos, len(path) AS d, (row_number() OVER w - 1) AS i, lag(len(path), 1, 0) OVER w AS b, lead(len(path), 1, 0) OVER w AS a FROM tree WINDOW w AS (PARTITION BY book ORDER BY path))
SELECT book, sha256(string_agg(CASE WHEN d > b THEN '<ol>' ELSE '' END || '<li><a href="text/page_' || pos || '.xhtml">n' || pos || '</a>' || CASE WHEN a > d THEN '' WHEN a = 0 THEN repeat('</li></ol>', d) ELSE repeat('</li></ol>', d - a) || '</li>' END, '' ORDER BY path)) AS nav,
 sha256(string_agg('<navPoint id="nav_' || i || '"><navLabel><text>n' || pos || '</text></navLabel><content src="text/page_' || pos || '.xhtml"/>' || CASE WHEN a > d THEN '' WHEN a = 0 THEN repeat('</navPoint>', d) ELSE repeat('</navPoint>', d - a + 1) END, '' ORDER BY path)) AS ncx FROM n GROUP BY book""")
def toc_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _tree(spark, sf_dir).select("book", "path", F.concat(F.lit("n"), F.col("node")).alias("text"), F.col("node").alias("page"), F.lit(None).cast("string").alias("href"), F.lit("").alias("anchor"))
    none = nodes.select("book", "page", F.col("text").alias("file")).where("false")
    out = render.rendered_toc(nodes, none)
    return out.select("book", F.sha2("nav", 256).alias("nav"), F.sha2("ncx", 256).alias("ncx"))


@query("SELECT conv_id AS book, turn AS pos, CASE WHEN turn % 2 = 0 THEN (turn % 4 + 1)::INT END AS level, turn % 2 = 0 AND turn % 4 < 2 AND coalesce(sum((turn % 2 = 0 AND turn % 4 < 2)::INT) OVER (PARTITION BY conv_id ORDER BY turn), 0) > 1 AS breaks FROM conversations")
def heading_page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("turn") % 2 == 0, (F.col("turn") % 4 + 1).cast("int"))
    return render.page_breaks(P.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), level.alias("level")))


@query("SELECT event_id, 'b' || (event_id % 3) AS message, CASE user_id % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'en' ELSE 'en' END AS language, CASE WHEN user_id % 3 = 0 AND event_id % 3 < 2 THEN 'ar b' || (event_id % 3) ELSE 'b' || (event_id % 3) END AS shown FROM events")
def translated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 3
    asked = P.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("b"), F.col("event_id") % 3).alias("message"), F.when(k == 0, "ar").when(k == 1, "en").otherwise("").alias("language"))
    dictionary = spark.createDataFrame([("ar", "b0", "ar   b0"), ("ar", "b1", "ar  b1")], "language STRING, message STRING, text STRING")
    return render.translated(asked, dictionary)


@query(f"""WITH {LINES}, en AS (SELECT l_orderkey AS book, CASE WHEN l_partkey % 5 = 0 THEN 'content.opf' WHEN l_partkey % 5 = 1 THEN 'x/' || (l_partkey % 9) || '.OPF' ELSE 'a' || pos END AS name, pos FROM li),
r AS (SELECT DISTINCT l_orderkey AS book, 'x/' || (l_suppkey % 9) || '.opf' AS path, pos AS k FROM li), f AS (SELECT en.book, arg_min(en.name, (r.k, -en.pos)) AS entry FROM r JOIN en ON en.book = r.book AND lower(en.name) = r.path GROUP BY en.book),
d AS (SELECT DISTINCT book, name AS entry FROM en WHERE name = 'content.opf'), a AS (SELECT book, min(name) AS entry FROM en WHERE lower(name) LIKE '%.opf' GROUP BY book)
SELECT a.book, coalesce(f.entry, d.entry, a.entry) AS entry FROM a LEFT JOIN f ON a.book = f.book LEFT JOIN d ON a.book = d.book""")
def package_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.numbered_lines(spark, sf_dir)
    k = F.col("l_partkey") % 5
    name = F.when(k == 0, "content.opf").when(k == 1, F.concat(F.lit("x/"), F.col("l_partkey") % 9, F.lit(".OPF"))).otherwise(F.concat(F.lit("a"), F.col("pos")))
    roots = lines.select(F.col("l_orderkey").alias("book"), F.col("pos").alias("at"), F.concat(F.lit("x/"), F.col("l_suppkey") % 9, F.lit(".opf")).alias("path"))
    return structure.package_entry(roots, lines.select(F.col("l_orderkey").alias("book"), "pos", name.alias("name")))


@query(f"""WITH {LINES}, n AS (SELECT l_orderkey AS page, pos, CASE l_partkey % 6 WHEN 0 THEN 'hr' WHEN 1 THEN 'aside' ELSE 'p' END AS kind, CASE l_partkey % 6 WHEN 1 THEN 'open =' WHEN 2 THEN '= goes on' WHEN 5 THEN 'text' ELSE '(' || pos || ') note' END AS text FROM li),
a AS (SELECT *, kind = 'p' AND text LIKE '(%' AS marked, (SELECT count(*) FROM n r WHERE r.page = n.page AND r.pos <= n.pos AND r.kind = 'hr') AS rules FROM n),
g AS (SELECT *, pos - min(pos) OVER (PARTITION BY page, rules) AS k, min(pos) OVER (PARTITION BY page, rules) AS begins FROM a),
c AS (SELECT *, rules > 0 AND k = 1 AND kind = 'p' AND text LIKE '=%' AS goes_on FROM g),
s AS (SELECT *, (SELECT min(x.pos) FROM c x WHERE x.page = c.page AND x.rules = c.rules AND x.k > 0 AND NOT x.marked AND NOT x.goes_on) AS stop_, (SELECT max(x.pos) FROM c x WHERE x.page = c.page AND x.pos <= c.begins AND x.marked) AS last_mark, (SELECT max(x.pos) FROM c x WHERE x.page = c.page AND x.pos <= c.begins AND x.kind = 'aside') AS last_open FROM c),
w AS (SELECT *, CASE WHEN kind = 'hr' THEN 'rule' WHEN goes_on THEN 'continuation' WHEN marked AND rules > 0 AND pos < coalesce(stop_, 1000000) THEN 'note' ELSE 'body' END AS role FROM s)
SELECT page, pos, role, (rules + (role = 'body')::INT)::INT AS section, CASE WHEN role = 'note' THEN count(*) FILTER (role = 'note') OVER (PARTITION BY page ORDER BY pos) END::INT AS note_id, CASE WHEN goes_on AND last_open > coalesce(last_mark, -1) THEN last_open END AS target FROM w""")
def ruled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the nodes of a page."""
    k = F.col("l_partkey") % 6
    kind = F.when(k == 0, "hr").when(k == 1, "aside").otherwise("p")
    text = F.when(k == 1, "open =").when(k == 2, "= goes on").when(k < 5, F.concat(F.lit("("), F.col("pos"), F.lit(") note"))).otherwise("text")
    return footnotes.ruled_sections(P.numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), "pos", kind.alias("kind"), text.alias("text")))


from foliant.plans import books  # noqa: E402, F401  its queries are registered here
