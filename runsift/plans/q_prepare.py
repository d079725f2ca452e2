"""Queries over run preparation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.functions.redact import redact
from runsift.operators import prepare as P
from runsift.plans import frames, sql
from runsift.plans.registry import query
from runsift.sources import rules

STREAMS = f"""{sql.DOC_RUNS}, runs AS (SELECT run_id, command, project, exit_code,
  CASE WHEN run_id % 5 = 0 THEN ' ' ELSE stdout END AS stdout,
  CASE run_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'warn: ' || project WHEN 2 THEN '  ' ELSE 'err' END AS stderr FROM doc_runs)"""


def streams(spark, sf):
    """Document runs with a second stream that is empty, blank or filled."""
    k = F.col("run_id") % 4
    err = F.when(k == 0, "").when(k == 1, F.concat(F.lit("warn: "), "project")).when(k == 2, "  ").otherwise("err")
    return frames.doc_runs(spark, sf).withColumn("stderr", err).withColumn(
        "stdout", F.when(F.col("run_id") % 5 == 0, " ").otherwise(F.col("stdout")))


_NO, _NE = sql.blank("stdout"), sql.blank("stderr")
_DEFAULT = (f"CASE WHEN exit_code <> 0 AND NOT {_NE} AND NOT {_NO} THEN stdout || chr(10) || stderr "
            f"WHEN {_NO} THEN stderr ELSE stdout END")


@query("b1_select_input", f"""WITH {STREAMS} SELECT run_id, {_DEFAULT} AS default_text,
  CASE WHEN {_NO} THEN stderr WHEN {_NE} THEN stdout ELSE stdout || chr(10) || stderr END AS out_err,
  CASE WHEN {_NE} THEN stdout WHEN {_NO} THEN stderr ELSE stderr || chr(10) || stdout END AS err_out,
  CASE run_id % 3 WHEN 0 THEN stdout WHEN 1 THEN stderr ELSE {_DEFAULT} END AS by_mode FROM runs""")
def b1(spark, sf):
    o, e, x = F.col("stdout"), F.col("stderr"), F.col("exit_code")
    mode = F.when(F.col("run_id") % 3 == 0, "stdout").when(F.col("run_id") % 3 == 1, "stderr").otherwise("stdout_or_stderr")
    return streams(spark, sf).select(
        "run_id", P.select_input(o, e, x).alias("default_text"), P.select_input(o, e, x, "stdout_then_stderr").alias("out_err"),
        P.select_input(o, e, x, "stderr_then_stdout").alias("err_out"), P.select_input(o, e, x, mode).alias("by_mode"))


@query("b2_combined_text", f"""WITH {STREAMS} SELECT run_id, CASE WHEN stderr = '' THEN stdout WHEN stdout = '' THEN stderr
  ELSE stdout || chr(10) || stderr END AS text FROM runs""")
def b2(spark, sf):
    return streams(spark, sf).select("run_id", P.combined_text(F.col("stdout"), F.col("stderr")).alias("text"))


@query("b4_match_rule", f"""WITH {sql.LEDGER}, {sql.rule_values()}, c AS (SELECT id, {sql.normalized('command')} AS cmd FROM ledger)
  SELECT c.id, max_by(rule, length(prefix)) AS rule FROM c LEFT JOIN rules ON cmd = prefix OR starts_with(cmd, prefix || ' ') GROUP BY c.id""")
def b4(spark, sf):
    return P.match_rule(frames.ledger(spark, sf), rules.rules_frame(spark)).select("id", "rule")


PY = ("CASE event_id % 5 WHEN 0 THEN 'python -m pytest -q' WHEN 1 THEN 'Python3  -c \"print(1)\"' WHEN 2 THEN 'python -m mypy src' "
      "WHEN 3 THEN 'python3 -c \"import pytest\"' ELSE 'pytest tests' END")


@query("b5_route_interpreter", f"""WITH {sql.rule_values()}, c AS (SELECT event_id AS id, {PY} AS command FROM events),
  n AS (SELECT id, command, {sql.normalized('command')} AS cmd FROM c),
  m AS (SELECT id, any_value(command) AS command, any_value(cmd) AS cmd, max_by(rule, length(prefix)) AS rule FROM n
    LEFT JOIN rules ON cmd = prefix OR starts_with(cmd, prefix || ' ') GROUP BY id)
  SELECT id, CASE WHEN regexp_matches(cmd, '^python3? (-m pytest|-c)( |$)') AND contains(command, 'pytest') THEN 'pytest'
    WHEN regexp_matches(cmd, '^python3? -c( |$)') THEN NULL ELSE rule END AS rule FROM m""")
def b5(spark, sf):
    e = F.col("event_id") % 5
    cmd = F.when(e == 0, "python -m pytest -q").when(e == 1, 'Python3  -c "print(1)"').when(e == 2, "python -m mypy src").when(
        e == 3, 'python3 -c "import pytest"').otherwise("pytest tests")
    runs = frames.table(spark, sf, "events").select(F.col("event_id").alias("id"), cmd.alias("command"))
    out = P.match_rule(runs, rules.rules_frame(spark))
    return out.select("id", P.route_interpreter(F.col("rule"), F.col("command")).alias("rule"))


PROJECT_RULES = [("1", "npm", 1, "p1-npm"), ("1", "npm build", 2, "p1-build"), ("2", "mvn build", 1, "p2-mvn"),
                 ("3", "ls", 5, "p3-late"), ("3", "ls status", 9, "p3-exact")]
GLOBAL_RULES = [("cargo test", 1, "g-test"), ("cargo", 2, "g-cargo"), ("ls", 3, "g-ls")]


@query("b6_resolve_tier", f"""WITH {sql.LEDGER}, {sql.rule_values()},
  pr AS (SELECT * FROM (VALUES {', '.join(str(r) for r in PROJECT_RULES)}) v(project, key, file_order, rule)),
  gr AS (SELECT * FROM (VALUES {', '.join(str(r) for r in GLOBAL_RULES)}) v(key, file_order, rule)),
  c AS (SELECT id, project, lower(command) AS cmd FROM ledger),
  p AS (SELECT id, arg_min(pr.rule, (CASE WHEN cmd = key THEN 0 ELSE 1 END) * 1000 + file_order) AS rule FROM c JOIN pr
    ON pr.project = c.project AND (cmd = key OR starts_with(cmd, key || ' ')) GROUP BY id),
  g AS (SELECT id, arg_min(gr.rule, (CASE WHEN cmd = key THEN 0 ELSE 1 END) * 1000 + file_order) AS rule FROM c JOIN gr
    ON (cmd = key OR starts_with(cmd, key || ' ')) GROUP BY id),
  b AS (SELECT id, max_by(rule, length(prefix)) AS rule FROM c JOIN rules ON cmd = prefix OR starts_with(cmd, prefix || ' ') GROUP BY id)
  SELECT c.id, coalesce(p.rule, g.rule, b.rule) AS rule, CASE WHEN p.rule IS NOT NULL THEN 'project' WHEN g.rule IS NOT NULL THEN 'global'
    ELSE 'builtin' END AS tier, CASE WHEN p.rule IS NOT NULL THEN '' WHEN g.rule IS NOT NULL THEN 'project:no match'
    ELSE 'project:no match,global:no match' END AS skipped
  FROM c LEFT JOIN p ON p.id = c.id LEFT JOIN g ON g.id = c.id LEFT JOIN b ON b.id = c.id""")
def b6(spark, sf):
    pr = spark.createDataFrame(PROJECT_RULES, "project string, key string, file_order int, rule string")
    gr = spark.createDataFrame(GLOBAL_RULES, "key string, file_order int, rule string")
    out = P.resolve_tier(frames.ledger(spark, sf), pr, gr, rules.rules_frame(spark))
    return out.select("id", "rule", "tier", F.array_join("skipped", ",").alias("skipped"))


@query("b7_gate_runs", f"""WITH {STREAMS}, g AS (SELECT run_id, ['grep', 'find', 'ls', 'curl', 'jq'][run_id % 5 + 1] AS rule,
    CASE WHEN run_id % 5 = 3 THEN true ELSE false END AS fail_raw, CASE WHEN run_id % 7 = 0 THEN 5 END AS max_lines,
    CASE WHEN run_id % 11 = 0 THEN 2 ELSE 0 END AS vb, exit_code, stdout,
    len({sql.nonblank(sql.lines('stdout'))}) AS n FROM runs)
  SELECT run_id, CASE WHEN rule = 'grep' AND exit_code = 1 THEN '(no matches)' WHEN rule IN ('grep', 'find', 'ls') AND exit_code <> 0 THEN 'passthrough'
    WHEN rule = 'grep' AND n = 0 THEN '(no matches)' WHEN rule = 'find' AND n = 0 THEN '(no results)' WHEN rule = 'ls' AND n = 0 THEN '(empty directory)'
    WHEN rule IN ('grep', 'find') AND (n <= 40 OR vb >= 2) THEN 'passthrough' WHEN rule = 'ls' AND (n <= 10 OR vb >= 2) THEN 'passthrough'
    WHEN fail_raw AND exit_code <> 0 THEN 'passthrough' WHEN max_lines IS NOT NULL AND n <= max_lines THEN 'passthrough' END AS gate FROM g""")
def b7(spark, sf):
    k = F.col("run_id")
    rule = F.element_at(F.array(*map(F.lit, ["grep", "find", "ls", "curl", "jq"])), (k % 5 + 1).cast("int"))
    return streams(spark, sf).select("run_id", P.gate_text(
        rule, F.col("stdout"), F.col("stdout"), F.col("exit_code"), F.when(k % 11 == 0, 2).otherwise(0), k % 5 == 3,
        F.lit(None).cast("int"), F.when(k % 7 == 0, 5)).alias("gate"))


@query("b8_project_fingerprint", """SELECT page_id AS run_id, CASE WHEN page_id % 9 = 0 THEN '000000000000' ELSE sha256(url)[1:12] END AS project FROM pages""")
def b8(spark, sf):
    url = F.when(F.col("page_id") % 9 == 0, "  ").otherwise(F.col("url"))
    return frames.table(spark, sf, "pages").select(F.col("page_id").alias("run_id"), P.project_fingerprint(url).alias("project"))


# Command pieces with quoting, wrappers, assignments and the ambiguous forms.
PIECES = ["sudo -u bob mvn test", "FOO=1 npm run x", "/usr/bin/Git.exe status", 'echo "a;b" \'c|d\'', "eval $x", "cat <<EOF",
          "echo 'open", "ls $(pwd)", "time nohup make -j4", "> out.txt env A=b -i gcc a.c", 'say "x'  + chr(92) + '"y" && z', "tail \\"]
SEPARATORS = [" && ", " ; ", " | ", "\n"]


def compound(spark, sf):
    e = F.col("event_id").cast("int")
    pieces = F.array(*map(F.lit, PIECES))
    sep = F.array(*map(F.lit, SEPARATORS))
    cmd = F.concat(F.get(pieces, e % 12), F.get(sep, e % 4), F.get(pieces, (F.floor(e / 12) % 12).cast("int")))
    return frames.table(spark, sf, "events").select(F.col("event_id").alias("run_id"), cmd.alias("command"))


_P = "[" + ", ".join(sql.q(p) for p in PIECES) + "]"
_S = "[' && ', ' ; ', ' | ', chr(10)]"
_HEAD = (r"regexp_replace(regexp_replace(raw, '^>\s*\S+\s+', ''), "
         r"'^(?:(?:[A-Za-z_]\w*=\S*|(?:sudo|env|nohup|time|command|builtin)(?:\s+(?:-[uCg]\s+\S+|-\S+|[A-Za-z_]\w*=\S*))*)\s+)*', '')")


@query("b9_split_compound", f"""WITH c AS (SELECT event_id AS run_id, {_P}[event_id % 12 + 1] || {_S}[event_id % 4 + 1] || {_P}[(event_id // 12) % 12 + 1] AS cmd FROM events),
  e AS (SELECT run_id, cmd, {sql.split_error('cmd')} AS err FROM c),
  s AS (SELECT run_id, err, CASE WHEN err IS NULL THEN {sql.segments('cmd')} ELSE [cmd] END AS segs FROM e),
  x AS (SELECT run_id, err, unnest(segs) AS raw, generate_subscripts(segs, 1) - 1 AS seg_no FROM s),
  h AS (SELECT *, contains(raw, '$(') AS sub, regexp_extract({_HEAD}, '^\\S+') AS word FROM x),
  w AS (SELECT *, regexp_replace(lower(string_split(word, '/')[-1]), '\\.(exe|cmd|bat)$', '') AS exe FROM h)
  SELECT run_id, CAST(seg_no AS INTEGER) AS seg_no, raw, CASE WHEN err IS NULL AND NOT sub THEN exe END AS executable,
    err IS NOT NULL OR sub OR exe = 'eval' AS ambiguous,
    coalesce(err, CASE WHEN sub THEN 'command substitution' WHEN exe = 'eval' THEN 'dynamic execution' END) AS reason FROM w""")
def b9(spark, sf):
    return P.split_compound(compound(spark, sf))


@query("b10_redact", f"SELECT doc_id AS run_id, {sql.redacted('text')} AS text FROM documents")
def b10(spark, sf):
    return frames.docs(spark, sf).select("run_id", redact(F.col("text")).alias("text"))
