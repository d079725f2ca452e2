"""Queries over the whole pipeline: rule lookup to checked text, and its explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.plans import frames, pipeline, sql
from runsift.plans.q_reduce import _head_tail_sql
from runsift.plans.registry import query
from runsift.plans.stages import build_rule, rule_tests as stage_tests
from runsift.sources.ledger_store import outcome_rows

COMMANDS = ["psql -c q", "mypy src", "ps aux", "frobnicate x", "sops f", "gcc a.c"]


def runs(spark, sf):
    d = frames.table(spark, sf, "documents")
    cmd = F.get(F.array(*map(F.lit, COMMANDS)), (F.col("doc_id") % len(COMMANDS)).cast("int"))
    return d.select(F.col("doc_id").alias("run_id"), cmd.alias("command"), (F.col("doc_id") % 5 == 0).cast("int").alias("exit_code"),
                    F.col("text").alias("stdout"), F.lit("").alias("stderr"))


_MYPY = f"""CASE WHEN len(nb) = 0 THEN '0 issue(s) in 0 file(s)' ELSE len(nb) || ' issue(s) in ' || nk || ' file(s)' || chr(10) || mb.body END"""
PIPE = f"""WITH r AS (SELECT doc_id AS run_id, [{', '.join(sql.q(c) for c in COMMANDS)}][doc_id % {len(COMMANDS)} + 1] AS command, CAST(doc_id % 5 = 0 AS INTEGER) AS exit_code, text FROM documents),
  l AS (SELECT *, {sql.lines('text')} AS ls, {sql.nonblank(sql.lines('text'))} AS nb FROM r),
  mk AS (SELECT run_id, key, count(*) AS c, min(no) AS f FROM (SELECT run_id, no, CASE WHEN instr(line, ':') > 1 THEN split_part(line, ':', 1) ELSE '(stdin)' END AS key
    FROM (SELECT run_id, unnest(nb) AS line, generate_subscripts(nb, 1) AS no FROM l WHERE command = 'mypy src')) GROUP BY 1, 2),
  mr AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY c DESC, f) AS rk FROM mk),
  mb AS (SELECT run_id, count(*) AS nk, array_to_string(list('  ' || key || ': ' || c ORDER BY rk) FILTER (rk <= 20), chr(10)) AS body FROM mr GROUP BY 1),
  gk AS (SELECT run_id, key, count(*) AS c FROM (SELECT run_id, {sql.trim('line')} AS key FROM (SELECT run_id, command, unnest(ls) AS line FROM l WHERE command IN ('gcc a.c', 'sops f'))
    WHERE (command = 'gcc a.c' AND contains(line, 'error:')) OR (command = 'sops f' AND regexp_matches(line, 'error|Error|ERROR|encrypted|MAC'))) GROUP BY 1, 2),
  gw AS (SELECT *, max(length(key)) OVER (PARTITION BY run_id) AS kw, length(CAST(max(c) OVER (PARTITION BY run_id) AS VARCHAR)) AS cw FROM gk),
  gb AS (SELECT run_id, {sql.rstrip("array_to_string(list('  ' || rpad(key, CAST(kw AS INTEGER), ' ') || ' : ' || lpad(CAST(c AS VARCHAR), CAST(cw AS INTEGER), ' ') ORDER BY c DESC, key), chr(10))")} AS body FROM gw GROUP BY 1),
  o AS (SELECT l.run_id, l.command, exit_code, text, CASE command WHEN 'psql -c q' THEN {_head_tail_sql(4, 6)} WHEN 'ps aux' THEN {_head_tail_sql(8, 8)}
      WHEN 'mypy src' THEN {_MYPY} WHEN 'frobnicate x' THEN text ELSE coalesce(gb.body, '') END AS a FROM l LEFT JOIN mb ON mb.run_id = l.run_id LEFT JOIN gb ON gb.run_id = l.run_id),
  k AS (SELECT *, {sql.tokens('text')} AS rt, {sql.tokens('a')} AS otk, command = 'frobnicate x' OR (command = 'sops f' AND exit_code <> 0) AS raw,
      NOT {sql.blank('text')} AND {sql.blank('a')} AS lost FROM o),
  w AS (SELECT *, NOT raw AND NOT lost AND exit_code = 0 AND length(a) > length(text) AND otk > rt AS inflated FROM k)"""


@query("c21_run_pipeline", f"""{PIPE} SELECT run_id, CASE command WHEN 'psql -c q' THEN 'psql' WHEN 'mypy src' THEN 'mypy' WHEN 'ps aux' THEN 'ps' WHEN 'sops f' THEN 'sops' WHEN 'gcc a.c' THEN 'gcc' END AS rule,
  CASE WHEN raw OR lost OR inflated THEN text ELSE a END AS text_out, NOT (raw OR lost OR inflated) AS was_filtered,
  CASE WHEN lost AND NOT raw THEN 'apply_fallback' END AS incident, rt AS raw_tokens, CASE WHEN raw OR lost OR inflated THEN rt ELSE otk END AS out_tokens FROM w""")
def c21(spark, sf):
    return pipeline.run_pipeline(runs(spark, sf)).select("run_id", "rule", "text_out", "was_filtered", "incident", "raw_tokens", "out_tokens")


@query("a2_ledger_rows", f"""{PIPE} SELECT command, count(*) AS runs, CAST(sum(rt) AS BIGINT) AS raw_tokens, CAST(sum(CASE WHEN raw OR lost OR inflated THEN rt ELSE otk END) AS BIGINT) AS out_tokens, 'utf8_weighted_v1' AS estimator FROM w GROUP BY command""")
def a2(spark, sf):
    r = runs(spark, sf).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("project", F.lit("p")).withColumn("cwd", F.lit("/w")).withColumn("exec_ms", F.lit(1))
    rows = pipeline.ledger_rows(pipeline.run_pipeline(r))
    return rows.groupBy("command").agg(F.count("*").alias("runs"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("out_tokens").alias("out_tokens"), F.max("estimator").alias("estimator"))


@query("a3_outcome_rows", f"{PIPE} SELECT command, 'apply_fallback' AS kind, count(*) AS cnt, 'fidelity_guard_failures filtered output is empty' AS detail FROM w WHERE lost AND NOT raw GROUP BY command")
def a3(spark, sf):
    r = runs(spark, sf).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("project", F.lit("p"))
    return outcome_rows(pipeline.run_pipeline(r)).groupBy("command", "kind").agg(F.count("*").alias("cnt"), F.max("detail").alias("detail"))


@query("l_rule_tests", f"""WITH {sql.DOCS}, c AS (SELECT run_id, text, {_head_tail_sql(4, 6)} AS a FROM docs) SELECT run_id AS id, CASE WHEN run_id % 2 = 0 THEN text ELSE a END = a AS passed, a AS actual FROM c""")
def rule_tests(spark, sf):
    from runsift.operators.reduce import head_tail
    # a test of each text: every second one expects no change, the others the reduced text
    d = frames.docs(spark, sf)
    tests = d.select(F.col("run_id").alias("id"), F.col("text").alias("input"), F.when(F.col("run_id") % 2 == 0, F.col("text")).otherwise(head_tail(F.col("text"), 4, 6)).alias("expected"))
    rule = build_rule({"name": "ends", "commands": ["psql"], "stages": [{"strategy": "head_tail", "head": 4, "tail": 6}]})
    return stage_tests(tests, rule["stages"])


STAGES = [{"strategy": "deduplication"}, {"strategy": "head_tail", "head": 2, "tail": 2}]


@query("d6_explain")
def d6(spark, sf):
    out = pipeline.explain(frames.docs(spark, sf), STAGES)
    return out.withColumn("dropped_sample", F.array_join("dropped_sample", "\n")).withColumn("added_sample", F.array_join("added_sample", "\n"))


def _side(a: str, b: str) -> str:
    return rf"regexp_split_to_array({a}, '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]')"


_HT = _head_tail_sql(2, 2)


@query("d6_explain_head_tail", f"""WITH {sql.DOCS}, c AS (SELECT run_id, text AS b, {_HT} AS a FROM docs), s AS (SELECT run_id, b, a, {_side('b', '')} AS bl, {_side('a', '')} AS al FROM c),
  x AS (SELECT run_id, unnest(bl) AS line, 1 AS s FROM s UNION ALL SELECT run_id, unnest(al), -1 FROM s),
  n AS (SELECT run_id, line, count(*) FILTER (s = 1) AS nb, count(*) FILTER (s = -1) AS na FROM x GROUP BY 1, 2),
  g AS (SELECT run_id, CAST(sum(least(nb, na)) AS BIGINT) AS kept, CAST(sum(greatest(nb - na, 0)) AS BIGINT) AS dropped, CAST(sum(greatest(na - nb, 0)) AS BIGINT) AS added FROM n GROUP BY 1)
  SELECT s.run_id, 0 AS stage_no, 'head_tail' AS stage, 'ran' AS status, 'windowed' AS streamability, CAST(len(bl) AS INTEGER) AS input_lines, CAST(len(al) AS INTEGER) AS output_lines,
    {sql.tokens('b')} AS input_tokens, {sql.tokens('a')} AS output_tokens, dropped AS dropped_lines, added AS added_lines, kept AS kept_lines, dropped > 32 AS dropped_truncated FROM s JOIN g ON g.run_id = s.run_id""")
def d6h(spark, sf):
    out = pipeline.explain(frames.docs(spark, sf), STAGES[1:])
    return out.select("run_id", "stage_no", "stage", "status", "streamability", "input_lines", "output_lines", "input_tokens", "output_tokens",
                      "dropped_lines", "added_lines", "kept_lines", "dropped_truncated")
