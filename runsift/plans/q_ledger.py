"""Queries over token estimates and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.functions.tokens import estimate_tokens, savings_pct
from runsift.operators import ledger as L
from runsift.operators import reduce as R
from runsift.plans import frames, sql
from runsift.plans.q_reduce import _head_tail_sql
from runsift.plans.registry import query
from runsift.sources.pricing import DEFAULT_MODEL, models_frame

AS_OF = frames.AS_OF
LED = f"WITH {sql.LEDGER}"
PCT = sql.pct("sum(raw_tokens)", "sum(out_tokens)")
SUMS = "count(*) AS commands, CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS \"out\""
SAVED = "CAST(sum(raw_tokens) - sum(out_tokens) AS BIGINT) AS saved"


@query("flagship_savings_by_source", f"""WITH {sql.DOCS}, r AS (SELECT command, text AS t, {_head_tail_sql(4, 6)} AS o FROM docs),
  k AS (SELECT command, {sql.tokens('t')} AS raw_tokens, {sql.tokens('o')} AS out_tokens FROM r)
  SELECT command, count(*) AS uses, CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS "out",
    {SAVED}, {PCT} AS pct FROM k GROUP BY command ORDER BY saved DESC, command LIMIT 10""")
def flagship(spark, sf):
    runs = frames.docs(spark, sf).select("command", "text", R.head_tail(F.col("text"), 4, 6).alias("reduced"))
    led = runs.select("command", estimate_tokens(F.col("text")).alias("raw_tokens"),
                      estimate_tokens(F.col("reduced")).alias("out_tokens"))
    return L.top_commands(led, 10)


@query("f1_estimate_tokens", f"SELECT doc_id AS run_id, {sql.tokens('text')} AS tokens FROM documents")
def f1(spark, sf):
    return frames.docs(spark, sf).select("run_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("f2_savings_pct", f"{LED} SELECT id, {sql.pct('raw_tokens', 'out_tokens')} AS pct, {sql.pct('out_tokens', 'raw_tokens')} AS loss FROM ledger")
def f2(spark, sf):
    return frames.ledger(spark, sf).select("id", savings_pct(F.col("raw_tokens"), F.col("out_tokens")).alias("pct"),
                                           savings_pct(F.col("out_tokens"), F.col("raw_tokens")).alias("loss"))


def _summary_sql(where: str = "") -> str:
    return (f"{LED} SELECT count(*) AS commands, CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS \"out\", {SAVED}, {PCT} AS pct, "
            f"CAST(sum(exec_ms) AS BIGINT) AS exec_ms, CAST(sum(exec_ms) // count(*) AS BIGINT) AS avg_ms FROM ledger {where}")


@query("f3_savings_summary", _summary_sql())
def f3(spark, sf):
    return L.savings_summary(frames.ledger(spark, sf))


@query("f3_savings_summary_project", _summary_sql("WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND project = '3'"))
def f3p(spark, sf):
    return L.savings_summary(frames.ledger(spark, sf), "2024-01-10 00:00:00", "3")


@query("f4_savings_daily", f"""{LED} SELECT strftime(ts, '%Y-%m-%d') AS bucket, {SUMS}, {SAVED} FROM ledger
  WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1""")
def f4(spark, sf):
    return L.savings_daily(frames.ledger(spark, sf), AS_OF, 14)


@query("f5_savings_weekly", f"""{LED} SELECT strftime(ts, '%Y-W%W') AS bucket, {SUMS}, {SAVED} FROM ledger
  WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 28 DAY AND project = '4' GROUP BY 1""")
def f5(spark, sf):
    return L.savings_weekly(frames.ledger(spark, sf), AS_OF, 4, "4")


TREND = f"""{LED}, w AS (SELECT strftime(ts, '%Y-W%W') AS bucket, count(*) AS commands, CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS o
  FROM ledger WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 56 DAY GROUP BY 1),
  spine AS (SELECT strftime(TIMESTAMP '{AS_OF}' - to_days(CAST(i * 7 AS INTEGER)), '%Y-W%W') AS bucket FROM range(8) r(i)),
  f AS (SELECT spine.bucket, coalesce(commands, 0) AS commands, coalesce(raw, 0) AS raw, coalesce(o, 0) AS o FROM spine LEFT JOIN w ON w.bucket = spine.bucket)"""


def _ratio(raw: str, out: str) -> str:
    return f"round(CASE WHEN {out} > 0 THEN CAST({raw} AS DOUBLE) / {out} WHEN {raw} > 0 THEN CAST({raw} AS DOUBLE) ELSE 1.0 END, 1)"


@query("f6_savings_trend", f"""{TREND} SELECT bucket, commands, raw, o AS "out", greatest(0, raw - o) AS saved,
  CASE WHEN raw > 0 THEN round(100.0 * CAST(greatest(0, raw - o) AS DOUBLE) / raw, 1) ELSE 0.0 END AS pct, {_ratio('raw', 'o')} AS ratio FROM f""")
def f6(spark, sf):
    return L.savings_trend(frames.ledger(spark, sf), AS_OF, 8)


@query("f6_trend_totals", f"""{TREND}, t AS (SELECT CAST(sum(commands) AS BIGINT) AS commands, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(o) AS BIGINT) AS o,
    CAST(sum(greatest(0, raw - o)) AS BIGINT) AS saved FROM f)
  SELECT commands, raw, o AS "out", saved, round(100.0 * CAST(saved AS DOUBLE) / raw, 1) AS pct, {_ratio('raw', 'o')} AS ratio FROM t""")
def f6t(spark, sf):
    return L.trend_totals(frames.ledger(spark, sf), AS_OF, 8)


@query("f7_top_commands", f"""{LED} SELECT command, count(*) AS uses, CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS "out", {SAVED}, {PCT} AS pct
  FROM ledger GROUP BY command ORDER BY saved DESC, command LIMIT 5""")
def f7(spark, sf):
    return L.top_commands(frames.ledger(spark, sf), 5)


@query("f8_recent_commands", f"""{LED} SELECT id, ts, command, raw_tokens, out_tokens, {sql.pct('raw_tokens', 'out_tokens')} AS pct, exec_ms
  FROM ledger ORDER BY ts DESC, id DESC LIMIT 20""")
def f8(spark, sf):
    return L.recent_commands(frames.ledger(spark, sf), 20)


@query("f9_savings_gaps", f"""{LED}, g AS (SELECT string_split(command, ' ')[1] || ' ' || string_split(command, ' ')[2] AS prefix, count(*) AS runs,
    CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS o FROM ledger WHERE raw_tokens > 100 AND (raw_tokens - out_tokens) * 10 < raw_tokens GROUP BY 1)
  SELECT prefix, runs, raw, o AS "out", o AS wasted, floor((raw - o) * CAST(1000 AS DOUBLE) / raw + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS pct FROM g
  ORDER BY wasted DESC, runs DESC, prefix LIMIT 10""")
def f9(spark, sf):
    return L.savings_gaps(frames.ledger(spark, sf), 10)


@query("f10_mixed_estimators", f"{LED} SELECT count(DISTINCT estimator) AS estimators, count(DISTINCT estimator) > 1 AS mixed FROM ledger")
def f10(spark, sf):
    return L.mixed_estimators(frames.ledger(spark, sf))


@query("f11_outcome_counts", f"{LED}, {sql.OUTCOMES} SELECT kind, count(*) AS cnt FROM outcomes GROUP BY kind")
def f11(spark, sf):
    return L.outcome_counts(frames.outcomes(spark, sf))


@query("f12_ledger_health", f"""{LED}, {sql.OUTCOMES} SELECT count(*) AS ledger_rows, min(ts) AS oldest, max(ts) AS newest,
  (SELECT count(*) FROM outcomes) AS outcome_rows, max(ts) > TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 1 DAY AS future FROM ledger""")
def f12(spark, sf):
    return L.ledger_health(frames.ledger(spark, sf), frames.outcomes(spark, sf), "2024-01-20 00:00:00")


def _usd(x: str, rate: float) -> str:
    return (f"floor(greatest(0, {x}) * (CAST({rate} AS DOUBLE) / CAST(1000000 AS DOUBLE)) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) "
            f"/ CAST(1000000 AS DOUBLE)")


MODEL, RATE = "gpt-4o-2024-11-20", 2.5
COST = f"'{MODEL}' AS model, {_usd('raw', RATE)} AS usd_raw, {_usd('o', RATE)} AS usd_filtered, {_usd('raw - o', RATE)} AS usd_saved"
AGG = "CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS o"


@query("f13_cost_estimate", f"{LED}, s AS (SELECT {AGG} FROM ledger) SELECT {COST} FROM s")
def f13(spark, sf):
    return L.cost_estimate(frames.ledger(spark, sf), models_frame(spark), MODEL)


ASKED = ["Sonnet", " 4O ", "o1-mini", "unknown", "GEMINI-PRO", "GPT-4o mini"]
FOUND = ["claude-3-5-sonnet-20241022", "gpt-4o-2024-11-20", "o1-mini-2024-09-12", DEFAULT_MODEL, "gemini-1.5-pro-002", "gpt-4o-mini-2024-07-18"]


@query("f14_find_model", f"""SELECT event_id AS id, {[*ASKED]}[event_id % 6 + 1] AS query, {[*FOUND]}[event_id % 6 + 1] AS model FROM events""")
def f14(spark, sf):
    asked = F.get(F.array(*map(F.lit, ASKED)), (F.col("event_id") % 6).cast("int"))
    events = frames.table(spark, sf, "events").select(F.col("event_id").alias("id"), asked.alias("query"))
    return L.find_model(events, models_frame(spark), DEFAULT_MODEL)


def _cost_by_sql(label: str) -> str:
    return (f"{LED}, s AS (SELECT {label} AS bucket, count(*) AS commands, {AGG} FROM ledger GROUP BY 1) "
            f"SELECT bucket, commands, raw, o AS \"out\", raw - o AS saved, {COST} FROM s")


@query("f15_cost_by_day", _cost_by_sql("strftime(ts, '%Y-%m-%d')"))
def f15d(spark, sf):
    return L.cost_by(frames.ledger(spark, sf), models_frame(spark), MODEL, "day")


@query("f15_cost_by_week", _cost_by_sql("strftime(ts, '%Y-W%W')"))
def f15w(spark, sf):
    return L.cost_by(frames.ledger(spark, sf), models_frame(spark), MODEL, "week")


@query("f15_cost_by_command", _cost_by_sql("command"))
def f15c(spark, sf):
    return L.cost_by(frames.ledger(spark, sf), models_frame(spark), MODEL, "command")


@query("f16_cube_savings", LED + "".join(
    f"{' UNION ALL' if i else ''} SELECT '{scope}' AS scope, {value} AS value, {SUMS}, {SAVED} FROM ledger {group}"
    for i, (scope, value, group) in enumerate([
        ("global", "'all'", ""), ("project", "project", "GROUP BY project"), ("day", "strftime(ts, '%Y-%m-%d')", "GROUP BY 2"),
        ("week", "strftime(ts, '%Y-W%W')", "GROUP BY 2"), ("command", "command", "GROUP BY command")])))
def f16(spark, sf):
    return L.cube_savings(frames.ledger(spark, sf))
