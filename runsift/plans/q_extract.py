"""Queries over structured extraction. Tool-like texts are documents whose lines
are rewritten in place, so their number and length follow the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.functions.text import lines_of
from runsift.operators import diffs, extract as E, gotest, sections
from runsift.operators.plan_shape import settled
from runsift.plans import frames, sql
from runsift.plans.registry import query


def _lines(body: str) -> str:
    return f"WITH {sql.rewritten(body)}, {sql.line_rows()}"


def _all(select: str) -> str:
    """Every document, also those without a matching line."""
    return f"SELECT d.run_id, {select} FROM docs d LEFT JOIN g ON g.run_id = d.run_id"


def _int(pattern: str, col: str = "line") -> str:
    return f"TRY_CAST(regexp_extract({col}, '{pattern}', 1) AS INTEGER)"


# --- E1 ---------------------------------------------------------------------------
PYTEST = ("CASE WHEN {i} = 1 OR {i} % 23 = 22 THEN '=== short test summary info ===' WHEN {i} % 7 = 6 THEN "
          "'== ' || ({i} % 5) || ' failed, 3 passed, 1 error in 0.1s ==' WHEN {i} % 7 = 5 THEN '=====' WHEN {i} % 3 = 0 THEN "
          "'FAILED t/f.py::c' || {i} || ' - x' WHEN {i} % 3 = 1 THEN 'ERROR t/e' || {i} ELSE x END")
_PY = f"""{_lines(PYTEST)}, h AS (SELECT *, regexp_matches(line, 'short test summary') AS sh, regexp_matches(line, '^=+.*=+$') AS su FROM x),
  p AS (SELECT *, last_value(CASE WHEN sh OR su THEN sh END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM h),
  o AS (SELECT run_id, no, {sql.trim('line')} AS line FROM p WHERE NOT sh AND ((coalesce(inside, false) AND (su OR regexp_matches(line, '^(FAILED|ERROR)\\s+')))
    OR (NOT coalesce(inside, false) AND su AND regexp_matches(line, 'passed|failed|error'))))"""


@query("e1_pytest_cases", f"""{_PY} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY no) - 1 AS INTEGER) AS seq, '' AS suite,
  regexp_extract(line, '^(FAILED|ERROR)\\s+(\\S+)', 2) AS name, CASE WHEN starts_with(line, 'FAILED') THEN 'failed' ELSE 'error' END AS status, line AS detail
  FROM o WHERE regexp_matches(line, '^(FAILED|ERROR)\\s+(\\S+)')""")
def e1(spark, sf):
    return E.test_cases(frames.rewrite(spark, sf, PYTEST), "pytest")


@query("e1_pytest_summary", f"""{_PY}, g AS (SELECT run_id, arg_max({_int('(\\d+)\\s+passed')}, no) FILTER (regexp_matches(line, '(\\d+)\\s+passed')) AS passed,
    arg_max({_int('(\\d+)\\s+failed')}, no) FILTER (regexp_matches(line, '(\\d+)\\s+failed')) AS failed,
    arg_max({_int('(\\d+)\\s+error')}, no) FILTER (regexp_matches(line, '(\\d+)\\s+error')) AS errors FROM o GROUP BY run_id)
  {_all('coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(errors, 0) AS errors, 0 AS skipped, 0 AS total')}""")
def e1s(spark, sf):
    return E.test_summary(frames.rewrite(spark, sf, PYTEST), "pytest")


# --- E2 ---------------------------------------------------------------------------
CARGO = ("CASE {i} % 5 WHEN 0 THEN 'test a::b' || {i} || ' ... FAILED' WHEN 1 THEN 'test result: FAILED. ' || {i} || ' passed; 1 failed; 2 ignored; finished in 0s' "
         "WHEN 2 THEN '   Compiling x v1' WHEN 3 THEN 'error[E1]: ' || substr(x, 1, 5) ELSE x END")
_CG = f"""{_lines(CARGO)}, f AS (SELECT *, starts_with(line, 'test ') AND contains(line, '...') AND suffix(line, 'FAILED') AS bad FROM x)"""


@query("e2_cargo_cases", f"""{_CG} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY no) - 1 AS INTEGER) AS seq, '' AS suite,
  split_part(line[6:], ' ...', 1) AS name, 'FAILED' AS status, 'FAILED: ' || split_part(line[6:], ' ...', 1) AS detail FROM f WHERE bad""")
def e2(spark, sf):
    return E.test_cases(frames.rewrite(spark, sf, CARGO), "cargo")


@query("e2_cargo_summary", f"""{_CG}, g AS (SELECT run_id, count(*) FILTER (bad) AS n, arg_max(line, no) FILTER (NOT bad AND starts_with(line, 'test result: ')) AS r FROM f GROUP BY run_id),
  v AS (SELECT run_id, coalesce({_int('(\\d+)\\s+passed', 'r')}, 0) AS p, CAST(greatest(n, coalesce({_int('(\\d+)\\s+failed', 'r')}, 0)) AS INTEGER) AS b, coalesce({_int('(\\d+)\\s+ignored', 'r')}, 0) AS s FROM g)
  SELECT d.run_id, coalesce(p, 0) AS passed, coalesce(b, 0) AS failed, 0 AS errors, coalesce(s, 0) AS skipped, coalesce(p + b + s, 0) AS total FROM docs d LEFT JOIN v ON v.run_id = d.run_id""")
def e2s(spark, sf):
    return E.test_summary(frames.rewrite(spark, sf, CARGO), "cargo")


# --- E3 ---------------------------------------------------------------------------
def go_lines(spark, sf):
    e = frames.table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    action = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").when(
        F.col("event_type") == "purchase", "output").when(F.col("event_type") == "click", "output").otherwise("pass")
    test = F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("T"), (i % 2).cast("string")))
    out = F.when(i % 9 == 0, F.lit("=== RUN T\n--- FAIL: T")).when(i % 9 == 1, "panic: boom").when(i % 9 == 2, "[build failed]").otherwise(
        F.concat(F.lit("line "), i.cast("string"), F.lit("\n  more\n")))
    line = F.to_json(F.struct(action.alias("Action"), F.concat(F.lit("p"), (i % 2).cast("string")).alias("Package"), test.alias("Test"), out.alias("Output")))
    return e.select(u.alias("run_id"), i.alias("line_no"), line.alias("line"))


_GO = r"""WITH ev AS (SELECT user_id AS run_id, event_id AS line_no, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' WHEN 'purchase' THEN 'output' WHEN 'click' THEN 'output' ELSE 'pass' END AS action,
    'p' || (event_id % 2) AS package, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'T' || (event_id % 2) END AS test,
    CASE event_id % 9 WHEN 0 THEN '=== RUN T' || chr(10) || '--- FAIL: T' WHEN 1 THEN 'panic: boom' WHEN 2 THEN '[build failed]' ELSE 'line ' || event_id || chr(10) || '  more' || chr(10) END AS output FROM events)"""
_GO_OUT = "regexp_split_to_array(regexp_replace(output, '\\n$', ''), '\\n')"


@query("e3_go_test_counts", f"""{_GO}, t AS (SELECT run_id, package, test, count(*) FILTER (action = 'pass') AS p, count(*) FILTER (action = 'skip') AS s,
    max(CASE WHEN action = 'fail' THEN 1 ELSE 0 END) AS f FROM ev WHERE test <> '' AND action IN ('pass', 'skip', 'fail') GROUP BY 1, 2, 3)
  SELECT run_id, CAST(sum(p) AS BIGINT) AS passed, CAST(sum(s) AS BIGINT) AS skipped, CAST(sum(f) AS BIGINT) AS failed FROM t GROUP BY run_id""")
def e3(spark, sf):
    return E.go_test_counts(go_lines(spark, sf))


@query("e3_go_failed_tests", f"""{_GO}, st AS (SELECT run_id, package, test, max(line_no) FILTER (action IN ('pass', 'skip')) AS reset FROM ev WHERE test <> ''
    GROUP BY 1, 2, 3 HAVING count(*) FILTER (action = 'fail') > 0),
  o AS (SELECT st.run_id, st.package, st.test, line_no, unnest({_GO_OUT}) AS d, generate_subscripts({_GO_OUT}, 1) AS sub FROM ev JOIN st
    ON st.run_id = ev.run_id AND st.package = ev.package AND st.test = ev.test WHERE action = 'output' AND (reset IS NULL OR line_no > reset)),
  c AS (SELECT *, {sql.trim('d')} AS diag FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY run_id, package, test ORDER BY line_no, sub) AS rk
    FROM c WHERE diag <> '' AND NOT regexp_matches(diag, '^=== (RUN|PAUSE|CONT)\\s+.*$') AND NOT regexp_matches(diag, '^--- (PASS|FAIL|SKIP):\\s+.*$')),
  g AS (SELECT run_id, package, test, count(*) AS n, array_to_string(list(diag ORDER BY rk), chr(10)) AS diagnostics FROM k GROUP BY 1, 2, 3)
  SELECT st.run_id, st.package, st.test, coalesce(diagnostics, '') AS diagnostics, 0 AS omitted FROM st
    LEFT JOIN g ON g.run_id = st.run_id AND g.package = st.package AND g.test = st.test""")
def e3f(spark, sf):
    return E.go_failed_tests(go_lines(spark, sf))


@query("e3_go_failed_packages", f"""{_GO}, own AS (SELECT * FROM ev WHERE test = ''), st AS (SELECT run_id, package,
    bool_or(action = 'output' AND contains(output, 'build failed')) AS b, bool_or(action = 'output' AND contains(output, 'panic:')) AS p FROM own GROUP BY 1, 2
    HAVING count(*) FILTER (action = 'fail') > 0),
  o AS (SELECT own.run_id, own.package, line_no, unnest({_GO_OUT}) AS d, generate_subscripts({_GO_OUT}, 1) AS sub FROM own WHERE action = 'output'),
  k AS (SELECT *, {sql.trim('d')} AS diag, row_number() OVER (PARTITION BY run_id, package ORDER BY line_no, sub) AS rk FROM o WHERE {sql.trim('d')} <> ''),
  g AS (SELECT run_id, package, array_to_string(list(diag ORDER BY rk), chr(10)) AS diagnostics FROM k GROUP BY 1, 2),
  t AS (SELECT DISTINCT run_id, package FROM ev WHERE test <> '' AND action = 'fail')
  SELECT st.run_id, st.package, CASE WHEN b THEN 'build failed' WHEN p THEN 'panic' ELSE 'package failed' END AS failure_type, coalesce(diagnostics, '') AS diagnostics
  FROM st LEFT JOIN g ON g.run_id = st.run_id AND g.package = st.package LEFT JOIN t ON t.run_id = st.run_id AND t.package = st.package
  WHERE g.run_id IS NOT NULL OR t.run_id IS NULL""")
def e3p(spark, sf):
    return E.go_failed_packages(go_lines(spark, sf))


# --- go test runs captured as text ---
def go_texts(spark, sf):
    """One captured run of every 40 events, in order; a run's text is bounded by the 40 lines it is made of."""
    ev = go_lines(spark, sf).select(F.floor(F.col("line_no") / 40).alias("run_id"), "line_no", "line")
    return ev.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


#: Failed tests and packages of each run, whole, by their first failure.
_GO_RUNS = _GO.replace("user_id AS run_id", "event_id // 40 AS run_id") + f""", st AS (SELECT run_id, package, test, max(line_no) FILTER (action IN ('pass', 'skip')) AS reset, min(line_no) FILTER (action = 'fail') AS no
    FROM ev WHERE test <> '' GROUP BY 1, 2, 3 HAVING no IS NOT NULL),
  td AS (SELECT run_id, package, test, {sql.trim('d')} AS d, line_no, sub FROM (SELECT st.run_id, st.package, st.test, line_no, unnest({_GO_OUT}) AS d, generate_subscripts({_GO_OUT}, 1) AS sub FROM ev JOIN st
    ON st.run_id = ev.run_id AND st.package = ev.package AND st.test = ev.test WHERE action = 'output' AND (reset IS NULL OR line_no > reset))),
  tg AS (SELECT run_id, package, test, list(d ORDER BY line_no, sub) AS ds FROM td WHERE d <> '' AND NOT regexp_matches(d, '^=== (RUN|PAUSE|CONT)\\s+.*$') AND NOT regexp_matches(d, '^--- (PASS|FAIL|SKIP):\\s+.*$') GROUP BY 1, 2, 3),
  ft AS (SELECT st.run_id, st.package, st.test AS name, 'test' AS kind, no, coalesce(ds, []) AS ds FROM st LEFT JOIN tg ON tg.run_id = st.run_id AND tg.package = st.package AND tg.test = st.test),
  sp AS (SELECT run_id, package, min(line_no) FILTER (action = 'fail') AS no, coalesce(string_agg(output, ' ' ORDER BY line_no) FILTER (action = 'output'), '') AS said FROM ev WHERE test = '' GROUP BY 1, 2 HAVING no IS NOT NULL),
  pd AS (SELECT run_id, package, {sql.trim('d')} AS d, line_no, sub FROM (SELECT run_id, package, line_no, unnest({_GO_OUT}) AS d, generate_subscripts({_GO_OUT}, 1) AS sub FROM ev WHERE test = '' AND action = 'output')),
  pg AS (SELECT run_id, package, list(d ORDER BY line_no, sub) AS ds FROM pd WHERE d <> '' GROUP BY 1, 2),
  fp AS (SELECT sp.run_id, sp.package, CAST(NULL AS VARCHAR) AS name, CASE WHEN contains(said, 'build failed') THEN 'build failed' WHEN contains(said, 'panic:') THEN 'panic' ELSE 'package failed' END AS kind, no, coalesce(ds, []) AS ds
    FROM sp LEFT JOIN pg ON pg.run_id = sp.run_id AND pg.package = sp.package WHERE ds IS NOT NULL OR NOT EXISTS (SELECT 1 FROM st WHERE st.run_id = sp.run_id AND st.package = sp.package)),
  ff AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kind <> 'test', no) AS k FROM (FROM ft UNION ALL FROM fp))"""


@query("e3_go_text_failures", f"{_GO_RUNS} SELECT run_id, CAST(k - 1 AS INTEGER) AS seq, package, name, kind, array_to_string(ds, chr(10)) AS diagnostics FROM ff")
def e3x(spark, sf):
    return gotest.go_text_failures(go_texts(spark, sf))


#: The summary of a run: the first 15 diagnostics of each failure.
GO_SUMMARY = f"""{_GO_RUNS}, c AS (SELECT run_id, count(*) FILTER (action = 'pass' AND test <> '') AS p, count(*) FILTER (action = 'skip' AND test <> '') AS s FROM ev GROUP BY 1),
  b AS (SELECT run_id, count(*) AS n, string_agg('  FAIL: ' || CASE kind WHEN 'test' THEN name ELSE '[' || kind || '] ' || package END || chr(10) || array_to_string(list_transform(ds[1:15], lambda x: '    ' || x || chr(10)), '')
      || CASE WHEN kind = 'test' AND len(ds) > 15 THEN '    ... (' || (len(ds) - 15) || ' lines omitted) ...' || chr(10) ELSE '' END, '' ORDER BY k) AS body FROM ff GROUP BY 1),
  r AS (SELECT c.run_id, CASE WHEN n IS NULL THEN '' ELSE 'go test: ' || n || ' failure(s)' || chr(10) || body END || 'passed: ' || p || CASE WHEN s > 0 THEN ' | skipped: ' || s ELSE '' END || CASE WHEN n > 0 THEN ' | failed: ' || n ELSE '' END AS text
    FROM c LEFT JOIN b ON b.run_id = c.run_id WHERE p + s > 0 OR c.run_id IN (SELECT run_id FROM ft))"""


@query("c21_go_test_text", f"{GO_SUMMARY} SELECT run_id, text FROM r")
def c21g(spark, sf):
    return go_texts(spark, sf).select("run_id", gotest.go_test_text(F.col("text")).alias("text"))


# --- E4 ---------------------------------------------------------------------------
GO_PLAIN = ("CASE WHEN {i} % 11 = 0 THEN '=== RUN   T' || ({i} % 3) WHEN {i} % 11 = 4 THEN '=== PAUSE T' || ({i} % 3) WHEN {i} % 11 = 6 THEN '--- FAIL: T' || ({i} % 3) || ' (0.0s)' "
            "WHEN {i} % 11 = 8 THEN '=== CONT  T' || ({i} % 2) WHEN {i} % 11 = 10 THEN '--- PASS: T' || ({i} % 3) || ' (0.0s)' ELSE '    ' || x END")


@query("e4_go_plain_failures", f"""{_lines(GO_PLAIN)}, t AS (SELECT run_id, no, line, {sql.trim('line')} AS t FROM x WHERE {sql.trim('line')} <> ''),
  m AS (SELECT *, CASE WHEN regexp_matches(t, '^===\\s+(RUN|CONT)\\s') THEN 'run' WHEN regexp_matches(t, '^===\\s+PAUSE\\s') THEN 'pause' WHEN regexp_matches(t, '^(--- FAIL|FAIL):\\s') THEN 'fail'
      WHEN regexp_matches(t, '^--- (PASS|SKIP):\\s') THEN 'pass' WHEN regexp_matches(line, '^[ \\t]') THEN 'diag' END AS kind,
    coalesce(nullif(regexp_extract(t, '^===\\s+(RUN|CONT|PAUSE)\\s+([^\\s]+)', 2), ''), nullif(regexp_extract(t, '^(--- FAIL|FAIL|--- PASS|--- SKIP):\\s+([^\\s(]+)', 2), '')) AS name FROM t),
  b AS (SELECT *, sum(CASE WHEN kind = 'run' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY no) AS blk FROM m WHERE kind IS NOT NULL),
  n AS (SELECT *, max(CASE WHEN kind = 'run' THEN name END) OVER (PARTITION BY run_id, blk) AS cur FROM b),
  w AS (SELECT *, min(CASE WHEN kind IN ('pause', 'fail', 'pass') AND name = cur THEN no END) OVER (PARTITION BY run_id, blk) AS done FROM n),
  o AS (SELECT *, CASE WHEN kind = 'diag' AND cur IS NOT NULL AND (done IS NULL OR no < done) THEN cur END AS owner FROM w),
  e AS (SELECT *, coalesce(CASE WHEN kind IN ('fail', 'pass') THEN name END, owner) AS k FROM o),
  ep AS (SELECT *, count(*) FILTER (kind IN ('fail', 'pass')) OVER (PARTITION BY run_id, k ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS epoch FROM e),
  own AS (SELECT run_id, k, epoch, count(*) AS n, array_to_string(list(t ORDER BY no), chr(10)) AS d
    FROM ep WHERE owner IS NOT NULL GROUP BY 1, 2, 3),
  f AS (SELECT ep.run_id, ep.no, ep.name, own.n, own.d FROM ep LEFT JOIN own ON own.run_id = ep.run_id AND own.k = ep.k AND own.epoch = ep.epoch WHERE kind = 'fail'),
  u AS (SELECT o.run_id, o.no, o.t, o.kind, o.owner, (kind IN ('run', 'pass') OR (kind = 'fail' AND f.n IS NULL)) AS clears FROM o LEFT JOIN f ON f.run_id = o.run_id AND f.no = o.no),
  ue AS (SELECT *, coalesce(sum(CASE WHEN clears THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM u),
  un AS (SELECT run_id, epoch, array_to_string(list(t ORDER BY no), chr(10)) AS d FROM ue WHERE kind = 'diag' AND owner IS NULL GROUP BY 1, 2)
  SELECT f.run_id, CAST(row_number() OVER (PARTITION BY f.run_id ORDER BY f.no) AS INTEGER) AS seq, f.name, coalesce(f.d, un.d, '') AS diagnostics
  FROM f JOIN ue ON ue.run_id = f.run_id AND ue.no = f.no LEFT JOIN un ON f.n IS NULL AND un.run_id = ue.run_id AND un.epoch = ue.epoch""")
def e4(spark, sf):
    return gotest.go_plain_failures(frames.rewrite(spark, sf, GO_PLAIN))


# --- E5, E6, E7 ---------------------------------------------------------------------
JEST = ("CASE WHEN {i} % 50 = 0 THEN 'FAIL src/a' || {i} || '.test.js' WHEN {i} % 50 = 47 THEN 'PASS src/b.test.js' WHEN {i} % 50 = 48 THEN "
        "'Tests:       1 failed, ' || {i} || ' passed, 9 total' WHEN {i} % 50 IN (1, 25) THEN '  ● case ' || {i} WHEN {i} % 3 = 0 THEN '      at f (a.js:' || {i} || ')' ELSE '    d' || x END")
_CAP = """c AS (SELECT *, count(*) FILTER (st) OVER w AS sr, count(*) FILTER (NOT st) OVER w AS orank FROM b WINDOW w AS (PARTITION BY run_id, blk, fail ORDER BY no)),
  k AS (SELECT run_id, blk, fail, no, CASE WHEN st AND sr <= 5 THEN '    ' || t WHEN st AND sr = 6 THEN '    ... (stack trace omitted) ...' WHEN NOT st AND ({other}) THEN '    ' || t
    WHEN NOT st AND {cap} AND orank = 16 THEN '    ... (detail lines omitted) ...' END AS shown FROM c)"""


@query("e5_jest_cases", f"""{_lines(JEST)}, h AS (SELECT *, {sql.trim('line')} AS t, regexp_matches(line, '^(FAIL|PASS)\\s+.+$') OR regexp_matches({sql.trim('line')}, '^(Test Suites:|Tests:|Snapshots:|Time:|Ran all test suites).*$') AS hd FROM x),
  s AS (SELECT *, sum(CASE WHEN hd THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY no) AS blk FROM h),
  sb AS (SELECT *, max(CASE WHEN hd AND regexp_matches(line, '^FAIL\\s') THEN {sql.trim("regexp_extract(line, '^FAIL\\s+(.+)$', 1)")} END) OVER (PARTITION BY run_id, blk) AS suite,
    sum(CASE WHEN NOT hd AND starts_with(t, '●') THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, blk ORDER BY no) AS fail FROM s),
  ti AS (SELECT run_id, blk, suite, fail, no, regexp_replace(t, '^●\\s*', '') AS title FROM sb WHERE suite IS NOT NULL AND NOT hd AND starts_with(t, '●')),
  em AS (SELECT run_id, blk, suite, 0 AS fail, max(no) FILTER (hd) AS no, '(suite error)' AS title FROM sb WHERE suite IS NOT NULL GROUP BY 1, 2, 3 HAVING max(fail) = 0),
  b AS (SELECT *, starts_with(t, 'at ') OR regexp_matches(line, '^\\s+at\\s+.*$') AS st FROM sb WHERE suite IS NOT NULL AND fail > 0 AND NOT hd AND NOT starts_with(t, '●') AND t <> ''),
  {_CAP.format(other='orank <= 15', cap='true')}, g AS (SELECT run_id, blk, fail, array_to_string(list(shown ORDER BY no) FILTER (shown IS NOT NULL), chr(10)) AS detail FROM k GROUP BY 1, 2, 3),
  u AS (SELECT * FROM ti UNION ALL SELECT * FROM em)
  SELECT u.run_id, CAST(row_number() OVER (PARTITION BY u.run_id ORDER BY u.no) - 1 AS INTEGER) AS seq, suite, title AS name, 'FAILED' AS status, coalesce(detail, '') AS detail
  FROM u LEFT JOIN g ON g.run_id = u.run_id AND g.blk = u.blk AND g.fail = u.fail""")
def e5(spark, sf):
    return E.test_cases(frames.rewrite(spark, sf, JEST), "jest")


@query("e5_jest_summary")
def e5s(spark, sf):
    return E.test_summary(frames.rewrite(spark, sf, JEST), "jest")


VITEST = ("CASE WHEN {i} % 40 = 0 THEN ' FAIL  src/a' || {i} || ' > case' WHEN {i} % 40 = 37 THEN ' ✓ fine' WHEN {i} % 40 = 38 THEN "
          "'Tests  2 failed | ' || {i} || ' passed | 1 skipped (9)' WHEN {i} % 3 = 0 THEN '      at f (a.js:' || {i} || ')' ELSE '  d' || x END")
_VI = f"""{_lines(VITEST)}, h AS (SELECT *, {sql.trim('line')} AS t, regexp_matches(line, '(^|\\s)(×|✗|FAIL)(\\s|$)') AND NOT contains(line, 'passed') AND {sql.trim('line')} <> '' AS fl FROM x),
  s AS (SELECT *, sum(CASE WHEN fl OR starts_with(t, '✓') OR starts_with(t, '❯') OR regexp_matches(t, '^Tests\\s+\\d+.*$') THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY no) AS blk FROM h),
  sb AS (SELECT *, max(CASE WHEN fl THEN t END) OVER (PARTITION BY run_id, blk) AS title, min(no) OVER (PARTITION BY run_id, blk) AS first_no FROM s)"""


@query("e6_vitest_cases", f"""{_VI}, b AS (SELECT *, 1 AS fail, starts_with(t, 'at ') OR regexp_matches(line, '^\\s+at\\s+.*$') AS st FROM sb WHERE title IS NOT NULL AND NOT fl AND t <> '' AND NOT starts_with(t, 'RUN ')),
  {_CAP.format(other='true', cap='false')}, l AS (SELECT run_id, blk, list(shown ORDER BY no) FILTER (shown IS NOT NULL) AS ls FROM k GROUP BY 1, 2),
  g AS (SELECT run_id, blk, array_to_string(ls[1:20], chr(10)) || CASE WHEN len(ls) > 20 THEN chr(10) || '    ... (' || (len(ls) - 20) || ' lines omitted) ...' ELSE '' END AS detail FROM l)
  SELECT sb.run_id, CAST(row_number() OVER (PARTITION BY sb.run_id ORDER BY sb.no) - 1 AS INTEGER) AS seq, '' AS suite, sb.t AS name, 'FAILED' AS status, coalesce(detail, '') AS detail
  FROM sb LEFT JOIN g ON g.run_id = sb.run_id AND g.blk = sb.blk WHERE fl""")
def e6(spark, sf):
    return E.test_cases(frames.rewrite(spark, sf, VITEST), "vitest")


@query("e6_vitest_summary", f"""{_VI}, g AS (SELECT run_id, CAST(count(*) FILTER (fl) AS INTEGER) AS n, max({_int('(\\d+)\\s+failed', 't')}) FILTER (NOT fl AND starts_with(t, 'Tests')) AS f,
    arg_max({_int('(\\d+)\\s+passed', 't')}, no) FILTER (starts_with(t, 'Tests')) AS p, arg_max({_int('(\\d+)\\s+skipped', 't')}, no) FILTER (starts_with(t, 'Tests')) AS s,
    arg_max({_int('\\((\\d+)\\)', 't')}, no) FILTER (starts_with(t, 'Tests')) AS tot FROM sb GROUP BY run_id),
  v AS (SELECT run_id, coalesce(p, 0) AS p, greatest(n, coalesce(f, 0)) AS f, coalesce(s, 0) AS s, coalesce(tot, n) AS tot FROM g)
  SELECT d.run_id, coalesce(p, 0) AS passed, coalesce(f, 0) AS failed, 0 AS errors, coalesce(s, 0) AS skipped, coalesce(greatest(tot, f + p + s), 0) AS total FROM docs d LEFT JOIN v ON v.run_id = d.run_id""")
def e6s(spark, sf):
    return E.test_summary(frames.rewrite(spark, sf, VITEST), "vitest")


BROWSER = ("CASE WHEN {i} % 40 = 0 THEN '  ' || {i} || ') [chromium] case' || {i} || ' ────' WHEN {i} % 40 = 38 THEN '  ' || {i} || ' failed' WHEN {i} % 40 = 39 THEN '  3 flaky' "
           "WHEN {i} % 9 = 2 THEN 'Call log:' WHEN {i} % 9 = 3 THEN '  - waiting for x' WHEN {i} % 9 = 4 THEN '    deep' WHEN {i} % 9 = 5 THEN 'attachment #1: shot' "
           "WHEN {i} % 9 = 6 THEN 'test-results/a.png' WHEN {i} % 4 = 0 THEN '      at f (a.js:' || {i} || ')' ELSE 'd' || x END")
_BR = f"""{_lines(BROWSER)}, h AS (SELECT *, {sql.trim('line')} AS t, regexp_matches(line, '^\\s*\\d+\\)\\s+(.+)$') AS fl, regexp_matches(line, '^\\s*\\d+\\s+(failed|passed|flaky|skipped).*$') AS sm FROM x),
  sb AS (SELECT *, sum(CASE WHEN fl OR sm THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY no) AS blk FROM h)"""


@query("e7_browser_cases", f"""WITH RECURSIVE {_BR[5:]}, hb AS (SELECT *, max(CASE WHEN fl THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, blk) AS own FROM sb),
  q AS (SELECT *, row_number() OVER (PARTITION BY run_id, blk ORDER BY no) AS r FROM hb WHERE own = 1 AND NOT fl),
  m AS (SELECT run_id, blk, CAST(0 AS BIGINT) AS r, '' AS mode, true AS dropped FROM hb WHERE fl UNION ALL
    SELECT q.run_id, q.blk, q.r, CASE WHEN t = '' OR regexp_matches(t, '^[─═-]{{3,}}$') THEN '' WHEN regexp_matches(t, '^(call|Call)\\s+log:.*$') THEN 'call'
      WHEN mode = 'call' AND (starts_with(t, '- ') OR starts_with(t, 'waiting for') OR starts_with(line, '    ')) THEN 'call' WHEN regexp_matches(t, '^attachment\\s+#\\d+:.*$') THEN 'file'
      WHEN mode = 'file' AND (suffix(t, '.png') OR suffix(t, '.zip') OR starts_with(t, 'test-results/')) THEN 'file' ELSE '' END,
      t = '' OR regexp_matches(t, '^[─═-]{{3,}}$') OR regexp_matches(t, '^(call|Call)\\s+log:.*$') OR (mode = 'call' AND (starts_with(t, '- ') OR starts_with(t, 'waiting for') OR starts_with(line, '    ')))
      OR regexp_matches(t, '^attachment\\s+#\\d+:.*$') OR (mode = 'file' AND (suffix(t, '.png') OR suffix(t, '.zip') OR starts_with(t, 'test-results/'))) OR starts_with(t, '✓')
    FROM m JOIN q ON q.run_id = m.run_id AND q.blk = m.blk AND q.r = m.r + 1),
  b AS (SELECT q.run_id, q.blk, q.no, q.t, 1 AS fail, starts_with(t, 'at ') OR regexp_matches(line, '^\\s+at\\s+.*$') AS st FROM q JOIN m ON m.run_id = q.run_id AND m.blk = q.blk AND m.r = q.r WHERE NOT m.dropped),
  {_CAP.format(other='true', cap='false')}, l AS (SELECT run_id, blk, list(shown ORDER BY no) FILTER (shown IS NOT NULL) AS ls FROM k GROUP BY 1, 2),
  g AS (SELECT run_id, blk, array_to_string(ls[1:20], chr(10)) || CASE WHEN len(ls) > 20 THEN chr(10) || '    ... (' || (len(ls) - 20) || ' lines omitted) ...' ELSE '' END AS detail FROM l)
  SELECT hb.run_id, CAST(row_number() OVER (PARTITION BY hb.run_id ORDER BY hb.no) - 1 AS INTEGER) AS seq, '' AS suite, {sql.rstrip("regexp_replace(hb.line, '[─═-]+$', '')")} AS name,
    'FAILED' AS status, coalesce(detail, '') AS detail FROM hb LEFT JOIN g ON g.run_id = hb.run_id AND g.blk = hb.blk WHERE fl""")
def e7(spark, sf):
    return E.test_cases(frames.rewrite(spark, sf, BROWSER), "playwright")


@query("e7_browser_summary", f"""{_BR}, g AS (SELECT run_id, CAST(count(*) FILTER (fl) AS INTEGER) AS n, max({_int('(\\d+)\\s+failed')}) FILTER (sm) AS f,
    CAST(coalesce(sum({_int('(\\d+)\\s+(?:skipped|flaky)')}) FILTER (sm), 0) AS INTEGER) AS s FROM sb GROUP BY run_id),
  v AS (SELECT run_id, greatest(n, coalesce(f, 0)) AS f, s FROM g)
  SELECT d.run_id, 0 AS passed, coalesce(f, 0) AS failed, 0 AS errors, coalesce(s, 0) AS skipped, coalesce(f + s, 0) AS total FROM docs d LEFT JOIN v ON v.run_id = d.run_id""")
def e7s(spark, sf):
    return E.test_summary(frames.rewrite(spark, sf, BROWSER), "playwright")


# --- E8, E9, E10, E11 -----------------------------------------------------------------
def lint_reports(spark, sf):
    """One JSON report per order line: two files with a varying number of messages."""
    k, s = F.col("l_linenumber"), F.col("l_suppkey")
    msg = lambda n: F.struct(F.when(s % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("R"), (s % 7 + n).cast("string"))).alias("ruleId"),
                             (s % 2 + 1).cast("int").alias("severity"), F.concat(F.lit("m"), s.cast("string")).alias("message"), (k + n).alias("line"))
    one = F.struct(F.concat(F.lit("/a"), k.cast("string"), F.lit(".js")).alias("filePath"), (s % 3).alias("errorCount"), (s % 4).alias("warningCount"), F.array(msg(0), msg(1)).alias("messages"))
    two = F.struct(F.lit("/b.js").alias("filePath"), F.lit(0).cast("bigint").alias("errorCount"), F.lit(1).cast("bigint").alias("warningCount"), F.array(msg(2)).alias("messages"))
    return frames.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"), F.to_json(F.array(one, two), {"ignoreNullFields": "true"}).alias("text"))


_LID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS run_id"


@query("e8_lint_json_findings", f"""SELECT {_LID}, n AS seq, CASE WHEN n < 2 THEN '/a' || l_linenumber || '.js' ELSE '/b.js' END AS file, l_linenumber + n AS line,
  CASE WHEN l_suppkey % 5 = 0 THEN 'unknown' ELSE 'R' || (l_suppkey % 7 + n) END AS code, 'm' || l_suppkey AS message,
  CASE WHEN l_suppkey % 2 + 1 >= 2 THEN 'error' ELSE 'warning' END AS severity FROM lineitem, (SELECT CAST(unnest(range(3)) AS INTEGER) AS n)""")
def e8(spark, sf):
    return E.findings(lint_reports(spark, sf), "json")


@query("e8_lint_json_totals", f"SELECT {_LID}, l_suppkey % 3 AS errors, l_suppkey % 4 + 1 AS warnings FROM lineitem")
def e8t(spark, sf):
    return settled(lint_reports(spark, sf).select("run_id", E.lint_json_totals(F.col("text")).alias("t")), "t").select("run_id", "t.*")


LINT_TEXT = ("CASE WHEN {i} % 6 = 0 THEN '/src/' || {i} || '.js' WHEN {i} % 6 = 1 THEN '  ' || {i} || ':3  error  bad ' || substr(x, 1, 6) || '  no-' || ({i} % 4) "
             "WHEN {i} % 6 = 2 THEN '  ' || {i} || ':9  warning  hm  prefer-x' WHEN {i} % 6 = 3 THEN '✖ 2 problems' WHEN {i} % 6 = 4 THEN '' ELSE '  7:1  error  ' || x || '  r1' END")
_ISSUE = E.LINT_ISSUE


@query("e9_lint_text_findings", f"""{_lines(LINT_TEXT)}, m AS (SELECT *, regexp_matches(line, '{_ISSUE}') AS iss FROM x),
  h AS (SELECT *, CASE WHEN NOT {sql.blank('line')} AND NOT iss AND NOT contains(line, '  error  ') AND NOT contains(line, '  warning  ') AND NOT regexp_matches(line, '^[✖✓]') THEN {sql.strip('line')} END AS hd FROM m),
  c AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no) AS file FROM h)
  SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY no) - 1 AS INTEGER) AS seq, coalesce(file, '') AS file, {_int(_ISSUE)} AS line, regexp_extract(line, '{_ISSUE}', 4) AS code,
    {sql.strip(f"regexp_extract(line, '{_ISSUE}', 3)")} AS message, regexp_extract(line, '{_ISSUE}', 2) AS severity FROM c WHERE iss""")
def e9(spark, sf):
    return E.findings(frames.rewrite(spark, sf, LINT_TEXT), "text")


def _rules_sql(body: str, patterns: str) -> str:
    return (f"{_lines(body)}, p AS (SELECT *, {patterns} AS key FROM x), k AS (SELECT run_id, key, count(*) AS cnt FROM p WHERE key IS NOT NULL GROUP BY 1, 2) "
            "SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, key) AS INTEGER) AS rank FROM k")


CLIPPY = "CASE WHEN run_id % 2 = 0 AND {i} % 3 = 0 THEN '  = note: `#[warn(clippy::r' || ({i} % 4) || ')]` on' WHEN {i} % 3 = 1 THEN 'warning: unused ' || ({i} % 5) ELSE x END"


@query("e10_clippy_rules", _rules_sql(CLIPPY, "CASE WHEN bool_or(regexp_matches(line, '#\\[warn\\((.+?)\\)\\]')) OVER (PARTITION BY run_id) THEN nullif(regexp_extract(line, '#\\[warn\\((.+?)\\)\\]', 1), '') "
                                     "ELSE nullif(regexp_extract(line, '^warning: (.+)$', 1), '') END"))
def e10(spark, sf):
    return E.count_lint_rules(frames.rewrite(spark, sf, CLIPPY), "clippy")


RUFF = "CASE WHEN {i} % 2 = 0 THEN 'a.py:' || {i} || ':1: E' || (500 + {i} % 6) || ' ' || x ELSE x END"


@query("e10_ruff_rules", _rules_sql(RUFF, "nullif(regexp_extract(line, ':\\s+([A-Z]\\d+)\\s', 1), '')"))
def e10r(spark, sf):
    return E.count_lint_rules(frames.rewrite(spark, sf, RUFF), "ruff")


GOLANGCI = "CASE WHEN {i} % 2 = 0 THEN 'a.go:1: ' || x || ' (lint-' || chr(CAST(97 + {i} % 4 AS INT)) || ')' ELSE x END"


@query("e10_golangci_rules", _rules_sql(GOLANGCI, "nullif(regexp_extract(line, '\\(([a-z][a-z0-9-]+)\\)\\s*$', 1), '')"))
def e10g(spark, sf):
    return E.count_lint_rules(frames.rewrite(spark, sf, GOLANGCI), "golangci")


TSC = "CASE WHEN {i} % 2 = 0 THEN 'src/f' || ((97 - {i}) % 5 + 5) || '.ts(' || {i} || ',1): error TS1: ' || x ELSE x END"


@query("e11_type_errors", f"""{_lines(TSC)}, k AS (SELECT run_id, regexp_extract(line, '^(\\S+\\.ts)\\(', 1) AS file, count(*) AS cnt, min(no) AS fst FROM x
  WHERE regexp_matches(line, '^(\\S+\\.ts)\\(') GROUP BY 1, 2) SELECT run_id, file, cnt, CAST(row_number() OVER (PARTITION BY run_id ORDER BY fst) AS INTEGER) AS rank FROM k""")
def e11(spark, sf):
    return E.count_type_errors(frames.rewrite(spark, sf, TSC))


# --- E12, E13, E14 -------------------------------------------------------------------
BUILD = ("CASE WHEN {i} % 5 = 0 THEN '> Task ' || {i} WHEN {i} % 5 = 1 THEN '[ERROR] bad ' || x WHEN {i} % 5 = 2 THEN 'make: Error ' || {i} WHEN {i} % 5 = 3 THEN 'Tests run: 3, Failures: ' || ({i} % 2) "
         "WHEN {i} = 4 THEN (CASE run_id % 4 WHEN 0 THEN 'BUILD SUCCESSFUL in 1s' WHEN 1 THEN 'BUILD FAILED' WHEN 2 THEN 'BUILD FAILURE' ELSE 'error[E1]: x' END) ELSE 'Finished dev in ' || {i} END")
_X = "CAST(run_id % 3 AS INTEGER)"
_B = f"""WITH {sql.rewritten(BUILD)}, l AS (SELECT run_id, text AS t, {sql.lines('text')} AS ls, {_X} AS x FROM docs)"""


def build_runs(spark, sf):
    return frames.rewrite(spark, sf, BUILD).withColumn("exit_code", (F.col("run_id") % 3).cast("int"))


def _status(tool):
    def run(spark, sf):
        b = build_runs(spark, sf)
        return b.select("run_id", E.build_status(tool, F.col("text"), F.col("exit_code"), F.lit("cargo install x")).alias("s")).select("run_id", "s.*")
    return run


query("e12_gradle_status", f"""{_B}, d AS (SELECT *, contains(t, 'BUILD SUCCESSFUL') AS ok, contains(t, 'BUILD FAILED') AS bad,
    list_filter(ls, lambda q: starts_with(q, '> ') OR starts_with(q, 'FAILURE:')) AS de FROM l)
  SELECT run_id, CASE WHEN ok THEN 'SUCCESS' WHEN bad THEN 'FAILED' ELSE 'UNKNOWN' END AS status, CAST(CASE WHEN bad THEN greatest(1, CASE WHEN ok THEN 0 ELSE len(de) END) ELSE 0 END AS INTEGER) AS errors,
    CASE WHEN ok THEN '✓ ' || {sql.trim("list_filter(ls, lambda q: contains(q, 'BUILD SUCCESSFUL'))[1]")} WHEN bad THEN '✗ BUILD FAILED' || chr(10) || {sql.join('de[1:15]')} ELSE t END AS text FROM d""")(_status("gradle"))
query("e12_mvn_status", f"""{_B}, d AS (SELECT *, contains(t, 'BUILD SUCCESS') AS ok, contains(t, 'BUILD FAILURE') AS bad,
    list_transform(list_filter(ls, lambda q: starts_with(q, '[ERROR]') OR regexp_matches(q, 'Tests run:.+Failures: [1-9]')), lambda q: {sql.trim('q')}) AS er,
    coalesce({sql.trim("list_filter(ls, lambda q: contains(q, 'Tests run:'))[-1]")}, '') AS tl FROM l)
  SELECT run_id, CASE WHEN ok THEN 'SUCCESS' WHEN bad THEN 'FAILURE' ELSE 'UNKNOWN' END AS status, CAST(len(er) AS INTEGER) AS errors,
    CASE WHEN ok THEN '✓ BUILD SUCCESS' || CASE WHEN tl = '' THEN '' ELSE ' — ' || tl END WHEN bad THEN '✗ BUILD FAILURE' || chr(10) || {sql.join('er[1:20]')} ELSE t END AS text FROM d""")(_status("mvn"))
query("e12_make_status", f"""{_B}, d AS (SELECT *, list_filter(ls, lambda q: starts_with(q, 'make') OR contains(q, 'Error') OR contains(q, 'error:')) AS er,
    {sql.nonblank('ls')} AS nb FROM l)
  SELECT run_id, CASE WHEN x <> 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CAST(CASE WHEN x <> 0 THEN greatest(1, len(er)) ELSE 0 END AS INTEGER) AS errors,
    CASE WHEN x <> 0 AND len(er) = 0 THEN t WHEN x <> 0 THEN {sql.join('er[1:15]')} ELSE '✓ make: ' || {sql.trim("coalesce(nb[-1], 'done')")} END AS text FROM d""")(_status("make"))
query("e12_cargo_install_status", f"""{_B}, d AS (SELECT *, list_filter(ls, lambda q: regexp_matches(q, '^error(\\[.+?\\])?:')) AS er, regexp_extract(t, 'Finished .+ in (.+)', 0) AS fin FROM l)
  SELECT run_id, CASE WHEN x <> 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CAST(CASE WHEN x <> 0 THEN len(er) ELSE 0 END AS INTEGER) AS errors,
    CASE WHEN x <> 0 AND len(er) = 0 THEN t WHEN x <> 0 THEN {sql.join('er[1:15]')} WHEN fin <> '' THEN '✓ ' || {sql.trim('fin')} ELSE '✓ install complete' END AS text FROM d""")(_status("cargo-install"))

IMAGE = ("CASE WHEN {i} % 4 = 0 THEN '#' || {i} || ' DONE 0.1s' WHEN {i} % 4 = 1 THEN 'ERROR: ' || x WHEN {i} = 6 THEN 'Successfully built 0123456789ab' WHEN {i} = 7 THEN 'Successfully tagged a:b ' ELSE x END")


@query("e13_image_build", f"""WITH {sql.rewritten(IMAGE)}, {sql.line_rows()}, m AS (SELECT *, regexp_matches(line, '^#\\d+ DONE\\b') AS dn, regexp_matches(line, '(?i)\\bERROR\\b|failed to') AS er FROM x),
  r AS (SELECT *, count(*) FILTER (dn) OVER (PARTITION BY run_id ORDER BY no) AS dr FROM m),
  g AS (SELECT run_id, array_to_string(list(line ORDER BY no) FILTER ((dn AND dr <= 30) OR er), chr(10)) AS kept, arg_max(nullif(regexp_extract(line, '(?:Successfully built|writing image sha256:)\\s*([0-9a-f]{{8,12}})', 1), ''), no)
      FILTER (regexp_matches(line, '(?:Successfully built|writing image sha256:)\\s*([0-9a-f]{{8,12}})')) AS image_id,
    arg_max({sql.trim("regexp_extract(line, 'Successfully tagged (.+)', 1)")}, no) FILTER (regexp_matches(line, 'Successfully tagged (.+)')) AS tag FROM r GROUP BY run_id),
  a AS (SELECT d.run_id, {_X.replace('run_id', 'd.run_id')} AS x, coalesce(kept, '') AS kept, image_id, tag FROM docs d LEFT JOIN g ON g.run_id = d.run_id)
  SELECT run_id, CASE WHEN x <> 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, image_id, tag, CASE WHEN x <> 0 AND kept = '' THEN '' WHEN x <> 0 THEN kept || chr(10) || 'docker build failed'
    ELSE CASE WHEN kept = '' THEN '' ELSE kept || chr(10) END || '✓ docker build' || coalesce(': ' || image_id, '') || coalesce(' → ' || tag, '') END AS text FROM a""")
def e13(spark, sf):
    d = frames.rewrite(spark, sf, IMAGE)
    return d.select("run_id", E.image_build(F.col("text"), (F.col("run_id") % 3).cast("int")).alias("s")).select("run_id", "s.*")


NPM = ("CASE WHEN {i} % 3 = 0 THEN 'npm WARN deprecated ' || x WHEN {i} % 7 = 1 THEN 'added ' || {i} || ' packages in 1s' WHEN {i} % 7 = 2 THEN 'found ' || {i} || ' vulnerabilities' ELSE x END")


@query("e14_npm_status", f"""WITH {sql.rewritten(NPM)}, l AS (SELECT run_id, {_X} AS x, {sql.lines('text')} AS ls FROM docs),
  v AS (SELECT run_id, x, list_filter(ls, lambda q: regexp_matches(q, '(?i)^npm (warn\\b|err!)'))[1:20] AS kp, list_filter(ls, lambda q: regexp_matches(q, 'added (\\d+) packages?'))[-1] AS ad,
    list_filter(ls, lambda q: regexp_matches(q, 'found (\\d+) vulnerabilit'))[-1] AS au FROM l)
  SELECT run_id, {_int('added (\\d+) packages?', 'ad')} AS added, {_int('found (\\d+) vulnerabilit', 'au')} AS vulnerabilities, coalesce(regexp_extract(au, 'found (\\d+) vulnerabilit', 0), '') AS vulnerability_text,
    {sql.join('kp')} AS irrevocable, x <> 0 AS failed, {sql.join("CASE WHEN x <> 0 AND len(kp) > 0 THEN list_append(kp, 'npm install failed') WHEN x <> 0 THEN kp ELSE list_append(kp, '✓ npm install' || "
      "coalesce(': ' || regexp_extract(ad, 'added (\\d+) packages?', 1) || ' packages', '') || coalesce(' | ' || regexp_extract(au, 'found (\\d+) vulnerabilit', 0), '')) END")} AS text FROM v""")
def e14(spark, sf):
    d = frames.rewrite(spark, sf, NPM)
    return d.select("run_id", E.npm_status(F.col("text"), (F.col("run_id") % 3).cast("int")).alias("s")).select("run_id", "s.*")


PIP = "CASE WHEN {i} % 5 = 3 THEN 'Successfully installed a-' || {i} || ' ' ELSE x END"


@query("e14_pip_status", f"""WITH {sql.rewritten(PIP)}, l AS (SELECT run_id, {sql.lines('text')} AS ls FROM docs)
  SELECT run_id, coalesce({sql.trim("list_filter(ls, lambda q: starts_with(q, 'Successfully installed'))[-1]")}, ({sql.nonblank('ls')})[-1], '✓ pip install') AS text FROM l""")
def e14p(spark, sf):
    return frames.rewrite(spark, sf, PIP).select("run_id", E.pip_text(F.col("text")).alias("text"))


# --- E15, E16, E17 -------------------------------------------------------------------
STATUS = "(CASE {i} % 5 WHEN 0 THEN 'M ' WHEN 1 THEN ' M' WHEN 2 THEN '??' WHEN 3 THEN 'AM' ELSE 'R ' END) || ' f' || {i} || '_' || length(x)"
_ARR = "array_to_string({}, ',')"


@query("e15_git_status_porcelain", f"""WITH {sql.rewritten(STATUS)}, l AS (SELECT run_id, {sql.lines('text')} AS ls FROM docs), v AS (SELECT run_id,
    list_transform(list_filter(ls, lambda q: NOT starts_with(q, '??') AND q[1:1] NOT IN (' ', '?')), lambda q: q[4:]) AS s,
    list_transform(list_filter(ls, lambda q: NOT starts_with(q, '??') AND q[2:2] NOT IN (' ', '?')), lambda q: q[4:]) AS m,
    list_transform(list_filter(ls, lambda q: starts_with(q, '??')), lambda q: q[4:]) AS u FROM l)
  SELECT run_id, '' AS branch, len(s) + len(m) + len(u) = 0 AS clean, {_ARR.format('s')} AS staged, {_ARR.format('m')} AS modified, {_ARR.format('u')} AS untracked FROM v""")
def e15(spark, sf):
    return _git(frames.rewrite(spark, sf, STATUS))


def _git(df):
    g = df.select("run_id", E.git_status(F.col("text")).alias("s")).select("run_id", "s.*")
    for c in ("staged", "modified", "untracked"):
        g = g.withColumn(c, F.array_join(c, ","))
    return g


HUMAN = ("CASE WHEN {i} = 0 THEN 'On branch b' || length(x) WHEN {i} % 12 = 1 THEN 'Changes to be committed:' WHEN {i} % 12 = 5 THEN 'Changes not staged for commit:' WHEN {i} % 12 = 8 THEN 'Untracked files:' "
         "WHEN {i} % 12 = 11 THEN '' ELSE chr(9) || (CASE WHEN {i} % 2 = 0 THEN 'modified:   ' ELSE '' END) || 'f' || {i} END")


@query("e15_git_status_human", f"""{_lines(HUMAN)}, h AS (SELECT *, CASE WHEN starts_with(line, 'Changes to be') THEN 's' WHEN starts_with(line, 'Changes not') THEN 'm' WHEN starts_with(line, 'Untracked') THEN 'u'
    WHEN line = '' THEN 'n' END AS hd FROM x), c AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no) AS sec FROM h),
  f AS (SELECT run_id, no, sec, 'f' || regexp_extract(line, 'f(\\d+)$', 1) AS f FROM c WHERE starts_with(line, chr(9))),
  g AS (SELECT run_id, array_to_string(list(f ORDER BY no) FILTER (sec = 's'), ',') AS s, array_to_string(list(f ORDER BY no) FILTER (sec = 'm'), ',') AS m, array_to_string(list(f ORDER BY no) FILTER (sec = 'u'), ',') AS u FROM f GROUP BY run_id)
  SELECT d.run_id, 'b' || length(split_part(o.text, chr(10), 1)) AS branch, false AS clean, coalesce(s, '') AS staged, coalesce(m, '') AS modified, coalesce(u, '') AS untracked
  FROM docs d JOIN documents o ON o.doc_id = d.run_id LEFT JOIN g ON g.run_id = d.run_id""")
def e15h(spark, sf):
    return _git(frames.rewrite(spark, sf, HUMAN))


ACTIONS = "CASE WHEN {i} % 6 = 2 THEN '[main abcdef0' || (100 + {i} % 90) || '] ' || x || '!' WHEN {i} % 9 = 4 THEN '   a..b  main -> origin' || {i} WHEN {i} % 31 = 30 THEN 'Everything up-to-date' ELSE x END"


@query("e16_git_actions", f"""WITH {sql.rewritten(ACTIONS)}, v AS (SELECT run_id, text AS t, '(?m)^\\[([^\\]]+)\\s+([0-9a-f]+)\\]\\s+(.+)$' AS p FROM docs)
  SELECT run_id, coalesce({sql.trim("nullif(regexp_extract(t, '(?m)^\\[([^\\]]+)\\s+([0-9a-f]+)\\]\\s+(.+)$', 1), '')")}, '') AS branch, nullif(regexp_extract(t, '(?m)^\\[([^\\]]+)\\s+([0-9a-f]+)\\]\\s+(.+)$', 2)[1:8], '') AS hash,
    CASE WHEN regexp_matches(t, '(?m)^\\[([^\\]]+)\\s+([0-9a-f]+)\\]\\s+(.+)$') THEN {sql.trim("regexp_extract(t, '(?m)^\\[([^\\]]+)\\s+([0-9a-f]+)\\]\\s+(.+)$', 3)")} END AS message,
    CASE WHEN regexp_matches(t, '(?i)Everything up-to-date') THEN '✓ up-to-date (nothing pushed)' WHEN regexp_matches(t, '\\s+(\\S+)\\s+->\\s+(\\S+)') THEN '✓ pushed → ' || regexp_extract(t, '\\s+(\\S+)\\s+->\\s+(\\S+)', 2)
      WHEN run_id % 3 = 0 THEN '✓ pushed' ELSE t END AS push, '✓ staged' || CASE WHEN len({sql.nonblank(sql.lines('t'))}) = 0 THEN '' ELSE ' ' || len({sql.nonblank(sql.lines('t'))}) || ' file(s)' END AS add_text FROM v""")
def e16(spark, sf):
    d, t = frames.rewrite(spark, sf, ACTIONS), F.col("text")
    return d.select("run_id", E.git_commit(t).alias("c"), E.git_push_text(t, (F.col("run_id") % 3).cast("int")).alias("push"), E.git_add_text(t).alias("add_text")).select(
        "run_id", "c.*", "push", "add_text")


PS = "CASE WHEN {i} = 0 THEN 'CONTAINER ID   IMAGE' WHEN {i} % 4 = 1 THEN substr(md5(x), 1, 12) || '   registry.example/image-' || {i} || '   \"cmd run\"   2 hours ago   Up 12 minutes   80/tcp   name' || {i} ELSE x END"


@query("e17_containers", f"""WITH {sql.rewritten(PS)}, l AS (SELECT run_id, list_filter(({sql.lines('text')})[2:], lambda q: NOT {sql.blank('q')}) AS ls FROM docs),
  u AS (SELECT run_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS seq FROM l), c AS (SELECT *, regexp_split_to_array(regexp_replace(line, '\\s{{2,}}$', ''), '\\s{{2,}}') AS c FROM u)
  SELECT run_id, CAST(seq AS INTEGER) AS seq, CASE WHEN len(c) >= 7 THEN c[1][1:8] ELSE '' END AS id, CASE WHEN len(c) < 7 THEN '' WHEN length(c[2]) > 20 THEN c[2][1:19] || '…' ELSE c[2] END AS image,
    CASE WHEN len(c) >= 7 THEN c[5][1:10] ELSE '' END AS status, CASE WHEN len(c) >= 7 THEN c[-1] ELSE '' END AS name, CASE WHEN len(c) >= 7 THEN '' ELSE {sql.trim('line')} END AS raw FROM c""")
def e17(spark, sf):
    return E.rows(frames.rewrite(spark, sf, PS), E.containers(F.col("text")))


# --- E18, E19, E20 -----------------------------------------------------------------------
_MOD = '\'"@module":"terraform.ui",'
PLAN = ("CASE WHEN {i} % 8 = 0 THEN '{\"@level\":\"info\"," + _MOD[1:] + "\"type\":\"planned_change\",\"change\":{\"action\":\"' || (CASE WHEN {i} % 3 = 0 THEN 'replace' ELSE 'create' END) || "
        "'\",\"resource\":{\"addr\":\"aws_x.r' || {i} || '\",\"resource_type\":\"aws_x\"}}}' "
        "WHEN {i} % 8 = 1 THEN '{\"@level\":\"error\"," + _MOD[1:] + "\"type\":\"diagnostic\",\"diagnostic\":{\"summary\":\"bad ' || {i} || '\",\"range\":{\"filename\":\"main.tf\"}}}' "
        "WHEN {i} % 8 = 2 THEN '{\"@level\":\"info\"," + _MOD[1:] + "\"type\":\"change_summary\",\"changes\":{\"add\":' || {i} || ',\"change\":1,\"remove\":2}}' "
        "WHEN {i} % 8 = 3 THEN '{\"@level\":\"warn\"," + _MOD[1:] + "\"type\":\"log\",\"@message\":\"slow ' || {i} || '\"}' "
        "WHEN {i} % 8 = 4 THEN '{\"@level\":\"info\"," + _MOD[1:] + "\"type\":\"outputs\",\"outputs\":{\"o' || {i} || '\":{\"sensitive\":true,\"type\":\"string\"}}}' "
        "WHEN {i} % 8 = 5 THEN 'Error: plain ' || {i} ELSE 'note' END")


@query("e18_plan_events", f"""{_lines(PLAN)}, e AS (SELECT run_id, no, no - 1 AS i FROM x), r AS (SELECT run_id, no, CASE i % 8 WHEN 0 THEN 'aws_x.r' || i WHEN 1 THEN 'main.tf' WHEN 3 THEN 'slow ' || i WHEN 4 THEN 'o' || i WHEN 5 THEN 'Error: plain ' || i END AS address,
    CASE i % 8 WHEN 0 THEN (CASE WHEN i % 3 = 0 THEN 'replace' ELSE 'create' END) WHEN 1 THEN 'error' WHEN 3 THEN 'warn' WHEN 4 THEN 'output' WHEN 5 THEN 'error' END AS action,
    CASE i % 8 WHEN 1 THEN 'bad ' || i WHEN 4 THEN 'sensitive' END AS reason, CASE i % 8 WHEN 0 THEN 'aws_x' END AS type FROM e WHERE i % 8 IN (0, 1, 3, 4, 5))
  SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY no) - 1 AS INTEGER) AS seq, address, action, reason, type FROM r""")
def e18(spark, sf):
    return E.rows(frames.rewrite(spark, sf, PLAN), E.plan_events(F.col("text"), E.ALL)["rows"])


@query("e18_plan_summary", f"""{_lines(PLAN)}, g AS (SELECT run_id, max(no) AS n FROM x GROUP BY 1)
  SELECT d.run_id, CAST(CASE WHEN n >= 3 THEN ((n - 3) // 8) * 8 + 2 ELSE 0 END AS INTEGER) AS add, CASE WHEN n >= 3 THEN 1 ELSE 0 END AS change, CASE WHEN n >= 3 THEN 2 ELSE 0 END AS destroy,
    CAST(len(list_filter(range(n), lambda i: i % 24 = 0)) AS INTEGER) AS replace FROM docs d JOIN g ON g.run_id = d.run_id""")
def e18s(spark, sf):
    d = frames.rewrite(spark, sf, PLAN).select("run_id", E.plan_events(F.col("text"), E.ALL)["summary"].alias("s"))
    return d.select("run_id", "s.*")


def validations(spark, sf):
    k = F.col("event_id") % 3
    diag = F.array_repeat(F.lit('{"severity":"warning","summary":"w","range":{"filename":"a.tf","start":{"line":3}}}'), k.cast("int"))
    text = F.concat(F.lit('{"valid":'), F.when(k == 0, "true").otherwise("false"), F.lit(',"diagnostics":['), F.array_join(F.concat(
        diag, F.array(F.lit('{"severity":"error","detail":"d","address":"m.x"}'))), ","), F.lit("]}"))
    return frames.table(spark, sf, "events").select(F.col("event_id").alias("run_id"), text.alias("text"))


@query("e19_validate_result", """SELECT event_id AS run_id, event_id % 3 = 0 AS valid, 1 AS errors, CAST(event_id % 3 AS INTEGER) AS warnings, CAST(event_id % 3 + 1 AS INTEGER) AS findings,
  CASE WHEN event_id % 3 > 0 THEN 'a.tf:3 w' ELSE 'm.x d' END AS first FROM events""")
def e19(spark, sf):
    v = validations(spark, sf).select("run_id", E.validate_result(F.col("text")).alias("v"))
    f = F.get("v.findings", F.lit(0))
    return v.select("run_id", "v.valid", "v.errors", "v.warnings", F.size("v.findings").alias("findings"), F.concat(
        f["file"], F.coalesce(F.concat(F.lit(":"), f["line"].cast("string")), F.lit("")), F.lit(" "), f["message"]).alias("first"))


ADDR = "CASE WHEN {i} % 10 = 9 THEN x ELSE (CASE WHEN {i} % 3 = 0 THEN 'module.m.' ELSE '' END) || (CASE WHEN {i} % 4 = 0 THEN 'data.' ELSE '' END) || 'aws_t' || ({i} % 5) || '.r' || {i} END"


@query("e20_resource_address_counts", f"""{_lines(ADDR)}, t AS (SELECT run_id, no, {sql.trim('line')} AS line FROM x WHERE {sql.trim('line')} <> ''),
  a AS (SELECT *, NOT regexp_matches(line, '[ /]') AND regexp_matches(line, '{E.RESOURCE_ADDRESS}') AND (starts_with(line, 'module.') OR starts_with(line, 'data.') OR contains(split_part(line, '.', 1), '_')) AS ok FROM t),
  s AS (SELECT *, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY run_id) AS share, count(*) OVER (PARTITION BY run_id) AS n FROM a),
  k AS (SELECT run_id, split_part(regexp_replace(regexp_replace(line, '^(?:module\\.[A-Za-z0-9_-]+(?:\\[[^\\]]+\\])?\\.)+', ''), '^data\\.', ''), '.', 1) AS type, count(*) AS cnt, min(no) AS fst
    FROM s WHERE ok AND share >= 0.8 AND n >= 2 GROUP BY 1, 2)
  SELECT run_id, type, cnt, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, fst) AS INTEGER) AS rank FROM k""")
def e20(spark, sf):
    return E.resource_address_counts(frames.rewrite(spark, sf, ADDR))


# --- C16, C17, C20 ---------------------------------------------------------------------
DIFF = ("CASE WHEN {i} % 97 = 0 THEN 'diff --git a/f' || {i} || ' b/f' || {i} WHEN {i} % 97 = 1 THEN 'index 12..34 100644' WHEN {i} % 97 = 2 THEN '@@ -1,9 +1,9 @@ ' || {i} "
        "WHEN {i} % (run_id % 11 + 3) = 0 THEN '+' || x WHEN {i} % (run_id % 13 + 5) = 1 THEN '-' || x ELSE ' ' || x END")


@query("c17_diff_stat", f"""{_lines(DIFF)}, g AS (SELECT run_id, CAST(count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS INTEGER) AS additions,
  CAST(count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS INTEGER) AS deletions FROM x GROUP BY run_id) {_all('coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions')}""")
def c17(spark, sf):
    d = frames.rewrite(spark, sf, DIFF)
    return d.select("run_id", diffs.diff_counts(F.col("text")).alias("c")).select("run_id", "c.*")


@query("c16_diff_hunk_sample")
def c16(spark, sf):
    d = frames.rewrite(spark, sf, DIFF)
    out = diffs.diff_summary(F.col("text"), F.lit("git diff"), F.lit(False), F.lit(0))
    return d.select("run_id", out.alias("text")).withColumn("lines_out", F.size(lines_of(F.col("text"))))


CHECKS = "CASE {i} % 4 WHEN 0 THEN 'build' || {i} || chr(9) || 'pass' || chr(9) || '1m' WHEN 1 THEN 'lint' || {i} || chr(9) || 'fail' || chr(9) || '2m' || chr(9) || 'https://x/' || {i} WHEN 2 THEN '' ELSE 'odd failure ' || {i} END"


@query("c20_section_filter_checks", f"""{_lines(CHECKS)}, n AS (SELECT run_id, no, no - 1 AS i FROM x WHERE (no - 1) % 4 <> 2),
  g AS (SELECT run_id, count(*) AS total, count(*) FILTER (i % 4 = 0) AS ok, list('  ' || CASE WHEN i % 4 = 1 THEN '✗ lint' || i || ' (fail, 2m) https://x/' || i ELSE '✗ odd failure ' || i END ORDER BY no) FILTER (i % 4 <> 0) AS bad FROM n GROUP BY 1)
  {_all("CASE WHEN bad IS NULL OR len(bad) = 0 THEN '✓ all checks passed (' || ok || ' checks)' ELSE '✗ ' || len(bad) || ' of ' || total || ' checks failed:' || chr(10) || array_to_string(bad, chr(10)) || chr(10) || '✓ ' || ok || ' checks passed' END AS text")}""")
def c20(spark, sf):
    d = frames.rewrite(spark, sf, CHECKS)
    return d.select("run_id", sections.section_filter(F.col("text"), F.lit("gh pr checks"), F.lit(0), "gh").alias("text"))


VIEW = ("CASE WHEN {i} = 0 THEN 'title:' || chr(9) || 'T' || length(x) WHEN {i} = 1 THEN 'labels:' || chr(9) WHEN {i} = 2 THEN 'state: OPEN' WHEN {i} = 3 THEN '--' WHEN {i} % 5 = 0 THEN '<details>' "
        "WHEN {i} % 5 = 1 THEN '' WHEN {i} % 5 = 2 THEN '<b>bold</b> ' || {i} ELSE 'p ' || {i} END")


@query("c20_section_filter_view", f"""{_lines(VIEW)}, b AS (SELECT run_id, no, CASE WHEN (no - 1) % 5 = 1 THEN '' WHEN (no - 1) % 5 = 2 THEN 'bold ' || (no - 1) ELSE 'p ' || (no - 1) END AS line FROM x WHERE no > 4 AND (no - 1) % 5 <> 0),
  l AS (SELECT *, lag(line) OVER (PARTITION BY run_id ORDER BY no) AS prev, max(no) FILTER (line <> '') OVER (PARTITION BY run_id) AS last_full FROM b),
  s AS (SELECT run_id, list(line ORDER BY no) AS ls FROM l WHERE (line <> '' OR coalesce(prev, '') <> '') AND no <= last_full GROUP BY 1),
  c AS (SELECT run_id, max(no) AS n, max(line) FILTER (no = 1) AS title FROM x GROUP BY 1)
  SELECT d.run_id, CASE WHEN c.n < 4 THEN d.text ELSE title || chr(10) || 'state: OPEN' || chr(10) || '--' || CASE WHEN s.ls IS NULL THEN '' ELSE chr(10) || array_to_string(ls[1:12], chr(10))
    || CASE WHEN len(ls) > 12 THEN chr(10) || '... (' || (len(ls) - 12) || ' lines omitted) ...' ELSE '' END END END AS text FROM docs d JOIN c ON c.run_id = d.run_id LEFT JOIN s ON s.run_id = d.run_id""")
def c20v(spark, sf):
    d = frames.rewrite(spark, sf, VIEW)
    return d.select("run_id", sections.section_filter(F.col("text"), F.lit("gh pr view"), F.lit(0), "gh").alias("text"))
