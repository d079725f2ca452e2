"""Streaming queries, drained over the given tables as file streams.

The output tables go to the shared folder named by spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.operators import reduce as R
from runsift.plans import frames, sql
from runsift.plans.q_reduce import MACHINE
from runsift.plans.q_sessions import PAIRS, WIDE
from runsift.plans.registry import query
from runsift.session import checkpoint_dir
from runsift.streaming import jobs


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    static = frames.table(spark, sf, name)
    # a pattern, since a table may be a file or a folder of files and a stream's plain path must be a folder
    return spark.readStream.schema(static.schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines as a line stream; the last row of a run is its end marker."""
    d = table_stream(spark, sf, "documents")
    lines = F.concat(F.split("text", "\n"), F.array(F.lit("")))
    rows = d.select(F.col("doc_id").alias("run_id"), F.size(lines).alias("n"), F.posexplode(lines).alias("line_no", "line"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("run_id") * 60 + F.col("line_no"))
    return rows.select("run_id", F.col("line_no").cast("bigint").alias("line_no"), at.alias("ts"), "line",
                       (F.col("line_no") == F.col("n") - 1).alias("is_end"), (F.col("run_id") % 2).cast("int").alias("exit_code"))


_RAW = "x AS (SELECT doc_id AS run_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)"


@query("j1_stream_ansi_strip", f"WITH {_RAW} SELECT run_id, no - 1 AS line_no, line FROM x")
def j1(spark, sf):
    noisy = doc_lines(spark, sf).where("NOT is_end").withColumn("line", F.concat(F.lit("\x1b[31m"), "line", F.lit("\x1b[0m")))
    return jobs.drain(jobs.stream_lines(noisy, R.ansi_strip).select("run_id", "line_no", "line"), folder(spark, "j1"))


@query("j1_stream_state_machine", f"""WITH {_RAW}, e AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-F]') THEN 'SKIP' WHEN regexp_matches(line, '^[N-Z]') THEN 'KEEP' END AS mark FROM x),
  s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no), 'KEEP') AS st FROM e) SELECT run_id, no - 1 AS line_no, line FROM s WHERE st = 'KEEP'""")
def j1s(spark, sf):
    return jobs.run_state_machine(doc_lines(spark, sf), folder(spark, "j1s"), **MACHINE)


@query("j1_stream_image_lines", f"""WITH {_RAW}, m AS (SELECT run_id, no, CASE WHEN no % 2 = 0 THEN '#1 DONE ' || line ELSE line END AS line FROM x),
  r AS (SELECT *, count(*) FILTER (regexp_matches(line, '^#\\d+ DONE\\b')) OVER (PARTITION BY run_id ORDER BY no) AS k FROM m)
  SELECT run_id, no - 1 AS line_no, line FROM r WHERE (regexp_matches(line, '^#\\d+ DONE\\b') AND k <= 30) OR regexp_matches(line, '(?i)\\bERROR\\b|failed to')""")
def j1i(spark, sf):
    lines = doc_lines(spark, sf).where("NOT is_end").withColumn("line", F.when(F.col("line_no") % 2 == 1, F.concat(F.lit("#1 DONE "), "line")).otherwise(F.col("line")))
    return jobs.drain(jobs.stream_capped_lines(lines, "image"), folder(spark, "j1i"))


@query("j2_stream_head_tail", f"""WITH {_RAW}, c AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM x)
  SELECT run_id, no AS out_no, line FROM c WHERE no <= 4 OR no > n - 6
  UNION ALL SELECT DISTINCT run_id, 5, '... (' || (n - 10) || ' lines omitted: lines 5..' || (n - 6) || ' of ' || n || ') ...' FROM c WHERE n > 10""")
def j2(spark, sf):
    return jobs.drain(jobs.stream_head_tail(doc_lines(spark, sf), 4, 6), folder(spark, "j2"))


@query("j3_end_of_run_flush", f"""WITH {_RAW}, m AS (SELECT run_id, no, 'added ' || no || ' packages' AS line FROM x WHERE no % 3 = 1), g AS (SELECT run_id, max(no) AS n FROM m GROUP BY 1)
  SELECT run_id, '✓ npm install: ' || n || ' packages' AS line FROM g WHERE run_id % 2 = 0""")
def j3(spark, sf):
    lines = doc_lines(spark, sf).withColumn("line", F.when(~F.col("is_end") & (F.col("line_no") % 3 == 0), F.format_string("added %d packages", F.col("line_no") + 1)).otherwise(""))
    return jobs.drain(jobs.stream_install_summary(lines), folder(spark, "j3"))


# A run's text is complete when the watermark has passed its silence.
@query("j4_stream_documents", f"""WITH {_RAW}, e AS (SELECT run_id, max(make_timestamp((1704067200 + run_id * 60 + no - 1) * 1000000)) AS last_ts FROM x GROUP BY 1), m AS (SELECT max(last_ts) AS top FROM e)
  SELECT d.doc_id AS run_id, {sql.nlines('d.text')} AS n FROM documents d JOIN e ON e.run_id = d.doc_id, m WHERE last_ts + INTERVAL 30 MINUTE <= top - INTERVAL 10 MINUTE""")
def j4(spark, sf):
    out = jobs.drain(jobs.stream_documents(doc_lines(spark, sf), lambda t: t), folder(spark, "j4"))
    from runsift.functions.text import lines_of
    return out.select("run_id", F.size(lines_of(F.col("text"))).alias("n"))


def ledger_stream(spark, sf):
    e = table_stream(spark, sf, "events")
    raw = F.floor(F.col("value") * 10).cast("bigint")
    out = F.when(F.col("user_id") % 5 == 0, F.floor(raw * 0.95)).otherwise(F.floor(raw * (F.col("user_id") % 12) / 12.0)).cast("bigint")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).cast("string").alias("project"), raw.alias("raw_tokens"), out.alias("out_tokens"))


def _closed(window: str, label: str) -> str:
    return f"""WITH {sql.LEDGER}, w AS (SELECT {label} AS s, count(*) AS commands, CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS o FROM ledger GROUP BY 1)
  SELECT strftime(s, '%Y-%m-%d') AS start_day, commands, raw, o AS "out", raw - o AS saved FROM w WHERE s + INTERVAL {window} <= (SELECT max(ts) FROM ledger) - INTERVAL 1 HOUR"""


def _labelled(df):
    return df.select(F.date_format("start_ts", "yyyy-MM-dd").alias("start_day"), "commands", "raw", "out", "saved")


@query("j5_stream_savings", _closed("1 DAY", "date_trunc('day', ts)"))
def j5(spark, sf):
    return _labelled(jobs.drain(jobs.stream_savings(ledger_stream(spark, sf)), folder(spark, "j5")))


@query("j5_stream_savings_weekly", _closed("7 DAY", "date_trunc('week', ts)"))
def j5w(spark, sf):
    return _labelled(jobs.drain(jobs.stream_weekly_savings(ledger_stream(spark, sf)), folder(spark, "j5w")))


@query("j6_stream_correction_pairs", f"WITH {WIDE}, {PAIRS} SELECT session_id, failed_command, failed_exit, corrected_command, delta_ms FROM pairs")
def j6(spark, sf):
    events = frames.session_events_of(table_stream(spark, sf, "events")).withColumn("session_id", (F.col("seq") % 3).cast("string"))
    return jobs.drain(jobs.stream_correction_pairs(events), folder(spark, "j6"))
