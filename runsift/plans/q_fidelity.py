"""Queries over the fidelity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.functions.tokens import estimate_tokens
from runsift.operators import fidelity as D
from runsift.operators import reduce as R
from runsift.plans import frames, sql
from runsift.plans.q_reduce import _head_tail_sql
from runsift.plans.registry import query

_MARKS = "[" + ", ".join(sql.q(m) for m in frames.SIGNAL_LINES) + "]"
_N = len(frames.SIGNAL_LINES)
SIG = f"""s0 AS (SELECT doc_id AS run_id, ['git diff HEAD', 'git diff --stat', 'ls -la', 'mvn test', 'psql'][doc_id % 5 + 1] AS command,
  CAST(doc_id % 3 AS INTEGER) AS exit_code, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k:
    CASE WHEN (k - 1) % (doc_id % 9 + 2) = 1 THEN {_MARKS}[((k - 1) // (doc_id % 9 + 2) + doc_id) % {_N} + 1] || x[1:9] ELSE x END), chr(10)) AS before FROM documents),
  sig AS (SELECT *, {_head_tail_sql(2, 3, 'before')} AS after FROM s0)"""
CUT = f"cut AS (SELECT run_id, command, text AS before, {_head_tail_sql(4, 6)} AS after FROM docs)"


def cut(spark, sf):
    return frames.docs(spark, sf).select("run_id", "command", F.col("text").alias("before"), R.head_tail(F.col("text"), 4, 6).alias("after"))


def _raw_lines(x: str) -> str:
    return rf"regexp_split_to_array({x}, '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]')"


_DIFF = f"""WITH {sql.DOCS}, {CUT}, b AS (SELECT run_id, unnest({_raw_lines('before')}) AS line, generate_subscripts({_raw_lines('before')}, 1) - 1 AS line_no FROM cut),
  a AS (SELECT run_id, unnest({_raw_lines('after')}) AS line, generate_subscripts({_raw_lines('after')}, 1) - 1 AS line_no FROM cut),
  bn AS (SELECT *, row_number() OVER (PARTITION BY run_id, line ORDER BY line_no) AS n FROM b),
  an AS (SELECT *, row_number() OVER (PARTITION BY run_id, line ORDER BY line_no) AS n FROM a),
  d AS (SELECT coalesce(bn.run_id, an.run_id) AS run_id, coalesce(bn.line, an.line) AS line, CASE WHEN an.n IS NULL THEN 'dropped'
    WHEN bn.n IS NULL THEN 'added' ELSE 'kept' END AS side, CAST(coalesce(bn.line_no, an.line_no) AS INTEGER) AS line_no
    FROM bn FULL OUTER JOIN an ON an.run_id = bn.run_id AND an.line = bn.line AND an.n = bn.n)"""


@query("d1_line_diff", f"{_DIFF} SELECT run_id, line, side, line_no FROM d")
def d1(spark, sf):
    return D.line_diff(cut(spark, sf))


@query("d1_line_diff_counts", f"""{_DIFF} SELECT run_id, count(*) FILTER (side = 'kept') AS kept, count(*) FILTER (side = 'dropped') AS dropped,
  count(*) FILTER (side = 'added') AS added FROM d GROUP BY run_id""")
def d1c(spark, sf):
    return D.line_diff_counts(cut(spark, sf))


@query("d1_line_diff_in_row", f"""{_DIFF} SELECT run_id, count(*) FILTER (side = 'kept') AS kept, count(*) FILTER (side = 'dropped') AS dropped,
  count(*) FILTER (side = 'added') AS added, coalesce(array_to_string(list(line ORDER BY line_no) FILTER (side = 'dropped')[1:32], chr(10)), '') AS dropped_sample FROM d GROUP BY run_id""")
def d1r(spark, sf):
    out = cut(spark, sf).select("run_id", D.diff_in_row(F.col("before"), F.col("after")).alias("d")).select("run_id", "d.*")
    return out.withColumn("dropped_sample", F.array_join("dropped_sample", "\n")).drop("added_sample")


_EXC = D.EXCEPTION_MARKERS
_TST = D.TEST_MARKERS
_SQLMSG = rf"list_transform(list_filter({{x}}, lambda q: regexp_matches(q, '{D.SQL_ERROR}')), lambda q: trim(regexp_extract(q, '{D.SQL_ERROR}', 1)))"
_CHANGE = "(starts_with(line, '+') AND NOT starts_with(line, '+++')) OR (starts_with(line, '-') AND NOT starts_with(line, '---'))"


@query("d2_critical_signals", f"""WITH {SIG}, l AS (SELECT *, {sql.lines('before')} AS ls FROM sig),
  x AS (SELECT run_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM l WHERE command = 'git diff HEAD'),
  dl AS (SELECT *, regexp_matches(line, '{D.DIFF_HEADER}') AS hdr FROM x WHERE regexp_matches(line, '{D.DIFF_HEADER}') OR {_CHANGE}),
  parts AS (
    SELECT run_id, CASE WHEN hdr THEN 'diff_file' WHEN starts_with(line, '+') THEN 'diff_added' ELSE 'diff_removed' END AS kind,
      CASE WHEN hdr THEN regexp_extract(line, '{D.DIFF_HEADER}', 2) ELSE line[2:] END AS value FROM dl
    UNION ALL SELECT run_id, 'sql', unnest({_SQLMSG.replace('{x}', 'ls')}) FROM l
    UNION ALL SELECT run_id, 'terraform', 'replace' FROM l WHERE regexp_matches(before, '{D.PLAN_REPLACE}')
    UNION ALL SELECT run_id, 'terraform', 'destroy' FROM l WHERE regexp_matches(before, '{D.PLAN_DESTROY}')
    UNION ALL SELECT run_id, 'cve', unnest(regexp_extract_all(before, '{D.CVE}')) FROM l
    UNION ALL SELECT run_id, 'exception', m FROM l JOIN (SELECT unnest([{', '.join(sql.q(m) for m in _EXC)}]) AS m) ON contains(before, m)
    UNION ALL SELECT run_id, 'test_failure', m FROM l JOIN (SELECT unnest([{', '.join(sql.q(m) for m in _TST)}]) AS m) ON contains(before, m)
    UNION ALL SELECT run_id, 'test_tally', '' FROM l WHERE regexp_matches(before, '{D.TEST_TALLY}')
    UNION ALL SELECT run_id, 'pointer', unnest(regexp_extract_all(before, '{D.POINTER}')) FROM l)
  SELECT run_id, kind, value FROM parts""")
def d2(spark, sf):
    return D.critical_signals(frames.signal_runs(spark, sf))


def _any(ls: str, cond: str) -> str:
    return f"len(list_filter({ls}, lambda q: {cond})) > 0"


def _starts(ls: str, p: str) -> str:
    return _any(ls, f"starts_with(q, {sql.q(p)})")


_CHG = "(starts_with(q, '+') AND NOT starts_with(q, '+++')) OR (starts_with(q, '-') AND NOT starts_with(q, '---'))"
_HAS_TEST = "regexp_matches({}, 'FAILED|FAIL:|--- FAIL|AssertionError|✗|✕') OR " + _any("{}l", f"regexp_matches({sql.strip('q')}, '{D.TEST_TALLY}')")


def _test(t: str) -> str:
    return "(" + _HAS_TEST.replace("{}l", t + "l").replace("{}", t) + ")"


def _one(cond: str, msg: str) -> str:
    return f"CASE WHEN {cond} THEN [{sql.q(msg)}] ELSE CAST([] AS VARCHAR[]) END"


def _lost(values: str, msg: str) -> str:
    return f"list_transform(list_filter({values}, lambda v: NOT contains(a, v)), lambda v: {sql.q(msg)} || v)"


def _concat(parts: list[str]) -> str:
    return "flatten([" + ", ".join(parts) + "])"


_NONE = "CAST([] AS VARCHAR[])"
_NO_EXC = " AND ".join(f"NOT contains(a, {sql.q(m)})" for m in _EXC)
FAILS = f"""WITH {SIG}, l AS (SELECT run_id, command, exit_code, before AS b, after AS a, {sql.lines('before')} AS bl, {sql.lines('after')} AS al FROM sig),
  f AS (SELECT run_id, b, a, CASE WHEN NOT {sql.blank('b')} AND {sql.blank('a')} THEN ['filtered output is empty'] WHEN a = b THEN {_NONE} ELSE {_concat([
    f"CASE WHEN command <> 'git diff --stat' AND {_starts('bl', 'diff --git ')} THEN " + _concat([
        _one(f"NOT {_starts('al', 'diff --git ')}", 'unified diff file header dropped'),
        _one(f"{_starts('bl', '--- ')} AND NOT {_starts('al', '--- ')}", 'unified diff --- header dropped'),
        _one(f"{_starts('bl', '+++ ')} AND NOT {_starts('al', '+++ ')}", 'unified diff +++ header dropped'),
        _one(f"{_starts('bl', '@@')} AND NOT {_starts('al', '@@')}", 'unified diff hunk header dropped'),
        _one(f"{_any('bl', _CHG)} AND NOT ({_any('al', _CHG)})", 'unified diff change lines dropped')]) + f" ELSE {_NONE} END",
    _lost(_SQLMSG.replace('{x}', 'bl'), 'sql error message dropped '),
    _one(f"regexp_matches(b, '{D.PLAN_REPLACE}') AND NOT regexp_matches(a, '{D.PLAN_REPLACE}')", 'terraform replacement signal dropped'),
    _one(f"regexp_matches(b, '{D.PLAN_DESTROY}') AND NOT regexp_matches(a, '{D.PLAN_DESTROY}')", 'terraform destructive plan summary dropped'),
    _lost(f"regexp_extract_all(b, '{D.CVE}')", 'security advisory dropped '),
    f"CASE WHEN (exit_code <> 0 OR regexp_matches(b, '{D.STRONG_FAILURE}')) AND command NOT IN ('ls -la', 'git diff --stat') THEN " + _concat(
        [_one(f"contains(b, {sql.q(m)}) AND NOT contains(a, {sql.q(m)})", f'exception marker dropped {m}') for m in _EXC] + [
            _one(f"{_any('bl', f'''regexp_matches(q, '{D.STACK_FRAME}')''')} AND NOT ({_any('al', f'''regexp_matches(q, '{D.STACK_FRAME}')''')}) AND {_NO_EXC}", 'stack frames dropped'),
            _lost(f"list_transform(list_filter(bl, lambda q: regexp_matches(q, '{D.COMPILER_ERROR}') AND regexp_matches(regexp_extract(q, '{D.COMPILER_ERROR}', 1), '{D.COMPILED_SOURCE}')), "
                  f"lambda q: regexp_extract(q, '{D.COMPILER_ERROR}', 1) || ':' || regexp_extract(q, '{D.COMPILER_ERROR}', 2))", 'compiler diagnostic dropped '),
            _one(f"{_test('b')} AND NOT {_test('a')} AND NOT regexp_matches(lower(a), 'failed|failure|error')", 'test failure markers dropped')]) + f" ELSE {_NONE} END",
    _one(f"exit_code <> 0 AND regexp_matches({sql.strip('a')}, '{D.MISLEADING}')", 'misleading clean summary on non-zero exit')])} END AS failures FROM l)"""


@query("d3_fidelity_check", f"{FAILS} SELECT run_id, len(failures) = 0 AS passed, array_to_string(failures, '; ') AS failures FROM f")
def d3(spark, sf):
    return D.fidelity_check(frames.signal_runs(spark, sf)).withColumn("failures", F.array_join("failures", "; "))


@query("d5_fallback_to_raw", f"""{FAILS} SELECT run_id, CASE WHEN len(failures) > 0 THEN b ELSE a END AS text, len(failures) = 0 AS was_filtered,
  CASE WHEN len(failures) > 0 THEN 'apply_fallback' END AS incident,
  CASE WHEN len(failures) > 0 THEN 'fidelity_guard_failures ' || array_to_string(failures[1:5], '; ') END AS detail FROM f""")
def d5(spark, sf):
    return D.fallback_to_raw(frames.signal_runs(spark, sf))


def _ids(b: str, a: str) -> str:
    noise = ", ".join(sql.q(p) for p in D.NOISE_PREFIXES)
    masked = f"regexp_replace({b}, '{D.UUID}', '-', 'g')"
    allids = (f"flatten([regexp_extract_all({b}, '{D.UUID}'), regexp_extract_all({b}, '{D.CVE}'), "
              f"list_filter(regexp_extract_all({b}, '{D.TICKET}'), lambda t: split_part(t, '-', 1) NOT IN ({noise})), "
              f"list_filter(regexp_extract_all({masked}, '{D.HEX_ID}'), lambda h: length(regexp_replace(h, '[^0-9]', '', 'g')) >= 2 "
              f"AND length(regexp_replace(h, '[^a-f]', '', 'g')) >= 2)])")
    return sql.distinct_in_order(f"list_filter({allids}, lambda z: NOT contains({a}, z))")


@query("d4_dropped_identifiers", f"WITH {SIG} SELECT run_id, array_to_string({_ids('before', 'after')}, ',') AS ids FROM sig")
def d4(spark, sf):
    return D.dropped_identifiers(frames.signal_runs(spark, sf)).withColumn("ids", F.array_join("ids", ","))


_SHEETS = "list_filter(list_transform(range(1, len(ids) + 1), lambda k: '[preserved ids: ' || array_to_string(ids[1:k], ', ') || ']'), lambda s: length(s) <= 240)"


@query("c23_append_identifier_factsheet", f"""WITH {SIG}, big AS (SELECT run_id, repeat(before || chr(10), 4) AS b, after AS a FROM sig),
  i AS (SELECT *, ({_ids('b', 'a')})[1:12] AS ids FROM big)
  SELECT run_id, CASE WHEN length(b) >= 16384 AND length(a) * 100 <= length(b) * 15 AND len(ids) > 0 THEN a || chr(10) || ({_SHEETS})[-1] ELSE a END AS text FROM i""")
def c23(spark, sf):
    b = F.repeat(F.concat("before", F.lit("\n")), 4)
    return frames.signal_runs(spark, sf).select("run_id", D.append_factsheet(b, F.col("after")).alias("text"))


_LONG = "CASE run_id % 4 WHEN 0 THEN before || ' and more words here' WHEN 1 THEN before || chr(10) || 'x' ELSE after END"
_CMD4 = "CASE run_id % 7 WHEN 0 THEN 'npm  install' WHEN 1 THEN 'kubectl get pods -A' ELSE command END"


@query("c22_net_win_gate", f"""WITH {SIG}, n AS (SELECT run_id, exit_code, {_CMD4} AS command, before AS b, {_LONG} AS a FROM sig),
  g AS (SELECT *, exit_code = 0 AND b <> '' AND length(a) > length(b) AND {sql.tokens('a')} > {sql.tokens('b')}
    AND NOT (command = 'npm  install' OR (command = 'kubectl get pods -A' AND len(list_filter({sql.lines('b')}, lambda q: NOT {sql.blank('q')} AND NOT contains(a, q))) = 0)) AS loss FROM n)
  SELECT run_id, loss, CASE WHEN loss THEN b ELSE a END AS text FROM g""")
def c22(spark, sf):
    k4, k7 = F.col("run_id") % 4, F.col("run_id") % 7
    after = F.when(k4 == 0, F.concat("before", F.lit(" and more words here"))).when(k4 == 1, F.concat("before", F.lit("\nx"))).otherwise(F.col("after"))
    cmd = F.when(k7 == 0, "npm  install").when(k7 == 1, "kubectl get pods -A").otherwise(F.col("command"))
    runs = frames.signal_runs(spark, sf).select("run_id", cmd.alias("command"), "exit_code", "before", after.alias("after"))
    b, a = F.col("before"), F.col("after")
    kept = D.net_win_gate(F.col("command"), F.col("exit_code"), b, a, estimate_tokens(b), estimate_tokens(a))
    return runs.select("run_id", (kept != a).alias("loss"), kept.alias("text"))


@query("d7_signal_retention_report", f"""WITH {SIG}, l AS (SELECT *, {sql.lines('before')} AS ls, {sql.tokens('before')} AS rt, {sql.tokens('after')} AS ot FROM sig),
  x AS (SELECT run_id, command, after, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM l WHERE command = 'git diff HEAD'),
  dl AS (SELECT *, regexp_matches(line, '{D.DIFF_HEADER}') AS hdr FROM x WHERE regexp_matches(line, '{D.DIFF_HEADER}') OR {_CHANGE}),
  parts AS (
    SELECT run_id, after, CASE WHEN hdr THEN regexp_extract(line, '{D.DIFF_HEADER}', 2) ELSE line[2:] END AS value FROM dl
    UNION ALL SELECT run_id, after, unnest({_SQLMSG.replace('{x}', 'ls')}) FROM l
    UNION ALL SELECT run_id, after, unnest(regexp_extract_all(before, '{D.CVE}')) FROM l
    UNION ALL SELECT run_id, after, m FROM l JOIN (SELECT unnest([{', '.join(sql.q(m) for m in _EXC + _TST)}]) AS m) ON contains(before, m)
    UNION ALL SELECT run_id, after, unnest(regexp_extract_all(before, '{D.POINTER}')) FROM l),
  lost AS (SELECT DISTINCT run_id FROM parts WHERE NOT contains(after, value)),
  p AS (SELECT l.command, lost.run_id IS NULL AS kept, {sql.pct('rt', 'ot')} AS pct FROM l LEFT JOIN lost ON lost.run_id = l.run_id)
  SELECT command, count(*) AS runs, count(*) FILTER (kept) AS kept_runs, min(pct) AS min_pct, CAST(sum(pct) AS BIGINT) AS sum_pct,
    count(*) FILTER (pct >= 60) AS at_floor FROM p GROUP BY command""")
def d7(spark, sf):
    runs = frames.signal_runs(spark, sf)
    runs = runs.withColumn("raw_tokens", estimate_tokens(F.col("before"))).withColumn("out_tokens", estimate_tokens(F.col("after")))
    return D.signal_retention_report(runs)
