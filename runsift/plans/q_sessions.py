"""Queries over session mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.operators import sessions as S
from runsift.plans import frames, sql
from runsift.plans.registry import query
from runsift.sources.rules import definitions

PREFIXES = [" ".join(c.lower().split()) for d in definitions().values() for c in d["commands"]]
EV = f"WITH {sql.SESSION_EVENTS}"
KNOWN = ", ".join(sql.q(w) for w in S.known_words(PREFIXES))

CALLS = """calls AS (SELECT CAST(conv_id % 97 AS VARCHAR) AS session_id, conv_id || '-' || turn AS call_id, conv_id * 1000 + turn AS seq,
    make_timestamp((1704067200 + conv_id * 60 + turn * 7) * 1000000) AS ts, CASE WHEN turn % 3 = 2 THEN 'editor' ELSE 'Bash' END AS tool,
    'run ' || substr(text, 1, 40) AS command FROM conversations WHERE role = 'user'),
  results AS (SELECT CAST(conv_id % 97 AS VARCHAR) AS session_id, conv_id || '-' || (turn - 1) AS call_id, conv_id * 1000 + turn AS seq,
    make_timestamp((1704067200 + conv_id * 60 + turn * 7) * 1000000) AS ts, text AS content,
    CASE WHEN conv_id % 5 = 0 THEN CAST(turn % 3 AS INTEGER) END AS exit_code, conv_id % 4 = 0 AS is_error FROM conversations WHERE role = 'assistant')"""


@query("g1_pair_tool_calls", f"""WITH {CALLS}, p AS (SELECT c.session_id, c.call_id, c.seq AS cs, r.seq, c.ts AS cts, r.ts AS rts, c.command, r.content, r.exit_code, r.is_error,
    row_number() OVER (PARTITION BY c.session_id, c.call_id, c.seq ORDER BY r.seq) AS rn FROM calls c JOIN results r
    ON r.session_id = c.session_id AND r.call_id = c.call_id AND r.seq > c.seq WHERE lower(c.tool) IN ('bash', 'sh', 'terminal', 'exec'))
  SELECT session_id, seq, call_id AS event_id, cts AS ts, {sql.redacted('command')} AS command,
    coalesce(exit_code, CASE WHEN is_error THEN 1 ELSE 0 END) AS exit_code, greatest(0, datediff('millisecond', cts, rts)) AS duration_ms,
    CAST(length(content) AS BIGINT) AS output_bytes, {sql.redacted('content')} AS output, contains(content, '[reduced]') AS filtered FROM p WHERE rn = 1""")
def g1(spark, sf):
    return S.pair_tool_calls(*frames.tool_calls(spark, sf))


@query("g2_session_bounds", f"""{EV} SELECT session_id, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(cwd, seq) FILTER (cwd IS NOT NULL) AS workspace,
  count(*) AS events FROM session_events GROUP BY session_id""")
def g2(spark, sf):
    return S.session_bounds(frames.session_events(spark, sf))


@query("g3_flag_already_reduced", f"{EV} SELECT session_id, seq, starts_with(command, 'rustup ') OR contains(output, '\"k\": 7') AS filtered FROM session_events")
def g3(spark, sf):
    return frames.session_events(spark, sf).select("session_id", "seq", S.already_reduced(
        F.col("command"), F.col("output"), "rustup ", '"k": 7').alias("filtered"))


def _related(a: str, b: str) -> str:
    wa, wb = f"split_part({a}, ' ', 1)", f"split_part({b}, ' ', 1)"
    fam = " OR ".join(f"(contains({wa}, '{t}') AND contains({wb}, '{t}'))" for t in ["npm", "cargo", "mvn", "git", "docker"])
    return f"(lower({wa}) = lower({wb}) OR {fam})"


# Rows ordered per session; the waiting failure of a row is the last one before it.
PAIRS = f"""seg AS (SELECT *, sum(CASE WHEN exit_code <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS sg FROM session_events),
  fl AS (SELECT session_id, sg, command AS fc, exit_code AS fx, output AS fo, ts AS fts, seq AS fseq FROM seg WHERE exit_code <> 0),
  ok AS (SELECT s.*, f.*, floor((epoch_us(s.ts) - epoch_us(f.fts)) / 1000) AS delta FROM (SELECT session_id AS sid, sg AS ssg, command, ts, seq FROM seg WHERE exit_code = 0) s
    JOIN fl f ON f.session_id = s.sid AND f.sg = s.ssg),
  mk AS (SELECT *, min(CASE WHEN delta NOT BETWEEN 0 AND 1800000 THEN seq END) OVER (PARTITION BY sid, ssg) AS expired,
    min(CASE WHEN delta BETWEEN 0 AND 1800000 AND {_related('fc', 'command')} THEN seq END) OVER (PARTITION BY sid, ssg) AS fix FROM ok),
  pairs AS (SELECT session_id, fc AS failed_command, fx AS failed_exit, fo AS snippet, command AS corrected_command, CAST(delta AS BIGINT) AS delta_ms,
    fseq AS failed_seq, seq AS corrected_seq FROM mk WHERE seq = fix AND (expired IS NULL OR fix < expired))"""

# The sf tables hold few events per user and day, so a session here is one user.
WIDE = sql.SESSION_EVENTS.replace("user_id || '-' || strftime(ts, '%Y%m%d') AS session_id", "CAST(event_id % 3 AS VARCHAR) AS session_id")


def wide(spark, sf):
    """The same events in a few busy sessions, so that fixes fall inside the window."""
    return frames.session_events(spark, sf).withColumn("session_id", (F.col("seq") % 3).cast("string"))


@query("g4_correction_pairs", f"WITH {WIDE}, {PAIRS} SELECT * FROM pairs")
def g4(spark, sf):
    return S.correction_pairs(wide(spark, sf))


@query("g4_correction_pairs_by_user_day", f"{EV}, {PAIRS} SELECT * FROM pairs")
def g4u(spark, sf):
    return S.correction_pairs(frames.session_events(spark, sf))


_OTHER = "(CASE seq % 3 WHEN 0 THEN './npmx run' WHEN 1 THEN 'MVN clean' ELSE 'rust test' END)"


@query("g5_related_commands", f"{EV} SELECT session_id, seq, {_related('command', _OTHER)} AS related FROM session_events")
def g5(spark, sf):
    from runsift.functions.commands import related
    k = F.col("seq") % 3
    other = F.when(k == 0, "./npmx run").when(k == 1, "MVN clean").otherwise("rust test")
    return frames.session_events(spark, sf).select("session_id", "seq", related(F.col("command"), other).alias("related"))


TOK = "greatest(1, CASE WHEN output_bytes > 0 THEN output_bytes // 4 ELSE length(out) // 4 END)"


@query("g6_session_tokens", f"""{EV}, t AS (SELECT session_id, seq, {TOK} AS tokens FROM (SELECT *, {sql.redacted('output')} AS out FROM session_events))
  SELECT session_id, seq, CAST(tokens AS BIGINT) AS tokens, CAST(floor(tokens * 0.75 + 0.5) AS BIGINT) AS saved FROM t""")
def g6(spark, sf):
    from runsift.functions.redact import redact
    t = S.event_tokens(F.col("output_bytes"), redact(F.col("output")))
    return frames.session_events(spark, sf).select("session_id", "seq", t.alias("tokens"), S.saved_tokens(t).alias("saved"))


def _annotated(frame: str = sql.SESSION_EVENTS) -> str:
    exe = r"regexp_replace(lower(string_split(regexp_extract(s, '^\S+'), '/')[-1]), '\.(exe|cmd|bat)$', '')"
    return f"""{frame}, {sql.rule_values()},
  ev AS (SELECT *, {sql.redacted('command')} AS cmd, {sql.redacted('output')} AS out FROM session_events),
  tk AS (SELECT *, length(out) AS chars, {TOK} AS tokens, {sql.segments('cmd')} AS segs FROM ev),
  dist AS (SELECT DISTINCT unnest(segs) AS s FROM tk),
  sup AS (SELECT s, {exe} IN ({KNOWN}) OR EXISTS (SELECT 1 FROM rules WHERE lower(s) = prefix OR starts_with(lower(s), prefix || ' ')) AS ok FROM dist),
  oks AS (SELECT list(s) FILTER (ok) AS good FROM sup),
  ann AS (SELECT tk.*, filtered OR len(list_filter(segs, lambda s: list_contains(good, s))) > 0 AS supported FROM tk, oks),
  us AS (SELECT session_id, seq, chars, tokens, len(segs) AS n, unnest(segs) AS raw, generate_subscripts(segs, 1) - 1 AS seg_no FROM ann WHERE NOT supported),
  uu AS (SELECT *, CASE WHEN lower(split_part(raw, ' ', 1)) IN ('bundle', 'npm', 'pnpm', 'yarn', 'mvn', 'gradle', 'git', 'cargo', 'docker') AND contains(raw, ' ')
    THEN split_part(raw, ' ', 1) || ' ' || split_part(raw, ' ', 2) ELSE split_part(raw, ' ', 1) END AS prefix FROM us)"""


@query("g7_unsupported_commands", f"WITH {_annotated()} SELECT prefix, count(*) AS runs, CAST(sum(chars // n) AS BIGINT) AS chars, CAST(sum(tokens // n) AS BIGINT) AS tokens FROM uu GROUP BY prefix")
def g7(spark, sf):
    return S.unsupported_commands(frames.session_events(spark, sf), PREFIXES)


_LOW = "lower(out)"
_CLASS = "CASE " + " ".join(
    f"WHEN regexp_matches({_LOW}, '{'|'.join(words)}')" + (rf" OR regexp_matches({_LOW}, '^.*\bts\d{{4}}\b.*$')" if name == "COMPILATION_ERROR" else "") + f" THEN '{name}'"
    for name, words in S.FAILURE_CLASSES) + " ELSE 'GENERAL_FAILURE' END"


@query("g8_classify_failures", f"""{EV}, o AS (SELECT *, {sql.redacted('output')} AS out FROM session_events WHERE exit_code <> 0),
  c AS (SELECT session_id, seq, {_CLASS} AS category, CASE WHEN {sql.blank('out')} THEN 'Command exited with non-zero status' ELSE split_part(out, chr(10), 1) END AS sample FROM o)
  SELECT category, count(*) AS cnt, arg_min(sample, (session_id, seq)) AS sample FROM c GROUP BY category""")
def g8(spark, sf):
    return S.classify_failures(frames.session_events(spark, sf))


@query("g9_session_report", f"""WITH {_annotated(WIDE)}, {PAIRS}, a AS (SELECT count(DISTINCT session_id) AS sessions, count(*) AS commands, count(*) FILTER (exit_code <> 0) AS failed,
    CAST(sum(tokens) AS BIGINT) AS raw_tokens, CAST(sum(CASE WHEN supported THEN floor(tokens * 0.75 + 0.5) END) AS BIGINT) AS saved_tokens FROM ann)
  SELECT sessions, commands, failed, (SELECT count(*) FROM pairs) AS pairs, raw_tokens, saved_tokens, round(saved_tokens / CAST(raw_tokens AS DOUBLE), 6) AS ratio FROM a""")
def g9(spark, sf):
    return S.session_report(wide(spark, sf), PREFIXES)


@query("g10_propose_from_sessions", f"""WITH {_annotated(WIDE)}, {PAIRS}, u AS (SELECT prefix, count(*) AS runs, CAST(sum(tokens // n) AS BIGINT) AS tokens, arg_min(raw, (session_id, seq, seg_no)) AS sample FROM uu GROUP BY prefix),
  c AS (SELECT u.*, (SELECT count(*) FROM pairs WHERE starts_with(failed_command, u.prefix) OR starts_with(corrected_command, u.prefix)) AS corrections FROM u),
  s AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(prefix, '[^a-zA-Z0-9]+', '-', 'g')), '^-', ''), '-$', '') AS slug FROM c WHERE runs >= 2 OR corrections > 0)
  SELECT sha256(slug || ':' || prefix)[1:12] AS id, slug, prefix, runs, tokens, corrections, sample, CAST(floor(tokens * CAST(0.70 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS est_savings FROM s""")
def g10(spark, sf):
    return S.propose_from_sessions(wide(spark, sf), PREFIXES)


def _dur(x: str) -> str:
    return f"CASE WHEN {x} < 100 THEN '<100ms' WHEN {x} < 1000 THEN '100ms-1s' WHEN {x} < 5000 THEN '1s-5s' ELSE '>5s' END"


def _size(x: str) -> str:
    return f"CASE WHEN {x} < 1024 THEN '<1KB' WHEN {x} < 10240 THEN '1KB-10KB' WHEN {x} < 102400 THEN '10KB-100KB' ELSE '>100KB' END"


@query("g11_bucket_failures", f"SELECT event_id AS id, {_dur('floor(value * 40)')} AS duration_bucket, {_size('floor(value * 700)')} AS output_length_bucket FROM events")
def g11(spark, sf):
    return frames.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), S.duration_bucket(F.floor(F.col("value") * 40)).alias("duration_bucket"),
        S.size_bucket(F.floor(F.col("value") * 700)).alias("output_length_bucket"))


@query("g12_failure_breakdown", f"""WITH r AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'UNKNOWN' ELSE event_type END AS stage,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'TIMEOUT' ELSE 'PARSE' END AS category, CAST(event_id % 4 AS VARCHAR) AS exit_code,
    CASE WHEN event_id % 17 = 0 THEN 'unknown' ELSE '1.' || (event_id % 3) END AS version, {_dur('floor(value * 40)')} AS duration, {_size('floor(value * 700)')} AS size FROM events),
  v AS (SELECT * FROM r WHERE category IS NOT NULL)
  {' UNION ALL '.join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS cnt FROM v GROUP BY {d}" for d in ['stage', 'category', 'exit_code', 'version', 'duration', 'size'])}""")
def g12(spark, sf):
    return S.failure_breakdown(frames.failure_reports(spark, sf))
