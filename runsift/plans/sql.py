"""SQL fragments for the DuckDB twins: text helpers and derived frames."""

from __future__ import annotations

SP = (r"\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}"
      r"\x{2028}\x{2029}\x{205F}\x{3000}")
CT = r"\x00-\x20"


def lines(t: str) -> str:
    return rf"(CASE WHEN {t} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace({t}, '\n$', ''), chr(10)) END)"


def nlines(t: str) -> str:
    return f"CAST(len({lines(t)}) AS INTEGER)"


def blank(x: str) -> str:
    return f"(NOT regexp_matches({x}, '[^{SP}]'))"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{SP}]+$', '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{CT}]+|[{CT}]+$', '', 'g')"


def join(x: str) -> str:
    return f"array_to_string({x}, chr(10))"


def nonblank(x: str) -> str:
    return f"list_filter({x}, lambda q: regexp_matches(q, '[^{SP}]'))"


def pct(raw: str, out: str) -> str:
    return f"CAST(CASE WHEN {raw} = 0 THEN 0 ELSE trunc((100.0 * ({raw} - {out})) / {raw}) END AS BIGINT)"


IGN = r"[\x{200D}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{1F3FB}-\x{1F3FF}]"
DENSE = (r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}\x{3000}-\x{303F}\x{3200}-\x{33FF}\x{FE30}-\x{FE4F}"
         r"\x{FF00}-\x{FFEF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}]")


def tokens(t: str) -> str:
    marked = f"regexp_replace(regexp_replace({t}, '{IGN}', '', 'g'), '{DENSE}', chr(1), 'g')"
    runs = f"string_split({marked}, chr(1))"
    return (f"CAST(CASE WHEN {t} = '' THEN 0 ELSE list_sum(list_transform({runs}, lambda r: (length(r) + 3) // 4)) "
            f"+ len({runs}) - 1 END AS BIGINT)")


DOCS = "docs AS (SELECT doc_id AS run_id, source AS command, text FROM documents)"
DOC_RUNS = ("doc_runs AS (SELECT d.doc_id AS run_id, d.source AS command, d.lang AS project, d.text AS stdout, "
            "CAST(coalesce(l.toxic, 0) AS INTEGER) AS exit_code FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")


def rewritten(expr: str, name: str = "docs") -> str:
    """Documents with each line rewritten; ``x`` is the line, ``i`` counts from 0."""
    body = expr.replace("{i}", "(k - 1)").replace("run_id", "doc_id")
    return (f"{name} AS (SELECT doc_id AS run_id, source AS command, array_to_string(list_transform("
            f"string_split(text, chr(10)), lambda x, k: {body}), chr(10)) AS text FROM documents)")


def line_rows(name: str = "x", frame: str = "docs") -> str:
    """(run_id, line, no) with ``no`` from 1."""
    return (f"{name} AS (SELECT run_id, unnest({lines('text')}) AS line, generate_subscripts({lines('text')}, 1) AS no FROM {frame})")


HITS = rewritten("'src/f' || ({i} % 7) || '.py:' || {i} || ': ' || x")
PATHS = rewritten("'d' || ({i} % 3) || CASE WHEN {i} % 2 = 0 THEN '/s' || ({i} % 5) ELSE '' END || '/n' || length(x) "
                  "|| '_' || {i} || CASE {i} % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.txt' WHEN 2 THEN '.rs' ELSE '' END")
NOISY = rewritten("CASE WHEN {i} % 5 = 0 THEN 'progress 10%' || chr(13) ELSE '' END || CASE WHEN {i} % 3 = 0 "
                  "THEN chr(27) || '[31m' || x || chr(27) || '[0m' ELSE x END")

LEDGER = """ledger AS (SELECT event_id AS id, ts,
  (CASE event_type WHEN 'signup' THEN 'git' WHEN 'error' THEN 'mvn' WHEN 'click' THEN 'npm' WHEN 'view' THEN 'cargo' ELSE 'ls' END)
  || ' ' || (CASE user_id % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'test --quiet' ELSE 'build' END) AS command,
  CAST(user_id % 10 AS VARCHAR) AS project, '/work/p' || (user_id % 10) AS cwd,
  CAST(floor(value * 10) AS BIGINT) AS raw_tokens,
  CAST(CASE WHEN user_id % 5 = 0 THEN floor(CAST(floor(value * 10) AS BIGINT) * CAST(0.95 AS DOUBLE))
       ELSE floor(CAST(floor(value * 10) AS BIGINT) * (user_id % 12) / CAST(12 AS DOUBLE)) END AS BIGINT) AS out_tokens,
  event_id % 1000 AS exec_ms, CASE WHEN event_id % 97 = 0 THEN 'legacy' ELSE 'utf8_weighted_v1' END AS estimator,
  event_type, user_id FROM events)"""
OUTCOMES = """outcomes AS (SELECT id, ts, command, project, command AS filter_name, CASE id % 3 WHEN 0 THEN 'apply_fallback'
  WHEN 1 THEN 'stage_exception' ELSE 'short_circuit' END AS kind FROM ledger WHERE event_type = 'error')"""

SESSION_EVENTS = """session_events AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, event_id AS seq, ts,
  (CASE event_id % 4 WHEN 0 THEN 'mvn' WHEN 1 THEN 'npm' WHEN 2 THEN './mvnw' ELSE 'rustup' END) ||
  (CASE event_type WHEN 'error' THEN ' test' WHEN 'click' THEN ' run build && make all'
   WHEN 'view' THEN ' check; zig build | tee ''a;b''' WHEN 'signup' THEN ' install --token=abc123' ELSE ' verify' END) AS command,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
  CAST(floor(value * 20) AS BIGINT) AS duration_ms,
  CAST(CASE WHEN event_id % 3 = 0 THEN floor(value * 7) ELSE 0 END AS BIGINT) AS output_bytes,
  CASE WHEN event_type = 'error' THEN (CASE event_id % 7 WHEN 0 THEN 'BUILD FAILED: cannot find symbol x'
   WHEN 1 THEN '2 tests failed' WHEN 2 THEN 'eslint found 3 problems' WHEN 3 THEN 'merge conflict in a.txt'
   WHEN 4 THEN 'EACCES: permission denied' WHEN 5 THEN '' ELSE 'exit status 2' || chr(10) || 'second line' END)
   ELSE 'ok ' || props END AS output, event_id % 50 = 0 AS filtered,
  CASE WHEN event_id % 2 = 0 THEN '/w/' || (user_id % 9) END AS cwd FROM events)"""


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def redacted(t: str) -> str:
    from runsift.functions.redact import REDACTIONS
    for pattern, label in REDACTIONS:
        t = f"regexp_replace({t}, {q(pattern)}, {q(label.replace('$1', chr(92) + '1'))}, 'g')"
    return t


def rule_values(name: str = "rules") -> str:
    from runsift.sources.rules import definitions
    rows = ", ".join(f"({q(d['name'])}, {q(c)})" for d in definitions().values() for c in d["commands"])
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS v(rule, prefix))"


def normalized(c: str) -> str:
    return rf"lower(regexp_replace({trim(c)}, '\s+', ' ', 'g'))"


def plain(x: str) -> str:
    return x


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda dv, di: list_position({x}, dv) = di)"


SEG_RE = r"""(?s)(?:\\.|'[^']*'|"(?:\\.|[^"\\])*"|[^'";&|\n\r\\])+"""
QUOTE_RE = r"""(?s)\\.|'[^']*'|"(?:\\.|[^"\\])*\""""


def segments(c: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({c}, {q(SEG_RE)}), lambda s: {trim('s')}), "
            f"lambda s: s <> '')")


def split_error(c: str) -> str:
    rest = f"regexp_replace({c}, {q(QUOTE_RE)}, ' ', 'g')"
    sq, dq, here = f"instr({rest}, chr(39))", f"instr({rest}, chr(34))", f"instr({rest}, '<<')"
    first = f"CASE WHEN {sq} = 0 AND {dq} = 0 THEN 0 WHEN {sq} = 0 THEN {dq} WHEN {dq} = 0 THEN {sq} ELSE least({sq}, {dq}) END"
    return (f"CASE WHEN {here} > 0 AND ({first} = 0 OR {here} < {first}) THEN 'here-document' "
            f"WHEN suffix({rest}, chr(92)) AND {sq} = 0 THEN 'dangling escape' "
            f"WHEN {first} > 0 AND {first} = {sq} THEN 'unclosed single quote' "
            f"WHEN {first} > 0 THEN 'unclosed double quote' END")
