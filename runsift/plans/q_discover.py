"""Queries over discovery, proposals and source corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.operators import discover as H
from runsift.operators import source_code as I
from runsift.plans import frames, sql
from runsift.plans.q_sessions import PREFIXES
from runsift.plans.registry import query
from runsift.sources.discovery_rules import DISCOVERY_RULES, signals_frame
from runsift.sources.rules import definitions, rules_frame

NAMES = ["package.json", "package-lock.json", "main.tf", "Cargo.toml", "go.mod", "conftest.py", ".git", "Justfile", "build.gradle", "pom.xml", "README"]
WORDS = max(len(p.split()) for p in PREFIXES)
EXTRA = ("needs-both", "needs", 5, [], ["make"], [("README", ["AUTO", "BUILD"])])


def repo_files(spark, sf):
    """One repository per customer; its files by key arithmetic."""
    c = frames.table(spark, sf, "customer")
    names = F.array(*map(F.lit, NAMES))
    return c.select(F.col("c_custkey").alias("root"), F.explode(F.filter(
        F.transform(names, lambda n, i: F.when((F.col("c_custkey") + i) % 3 == 0, n)), lambda x: x.isNotNull())).alias("path"),
        F.concat(F.lit("AUTO "), F.when(F.col("c_custkey") % 2 == 0, "BUILD").otherwise("")).alias("head_text"))


def _rules_sql() -> str:
    rows = []
    for rule, family, priority, signals, recommend, *extras in [*DISCOVERY_RULES, EXTRA]:
        for i, path in enumerate([*signals, *[p for p, _ in (extras[0] if extras else [])]]):
            rows.append(f"({sql.q(rule)}, {sql.q(family)}, {priority}, {i}, {sql.q(path)}, [{', '.join(sql.q(r) for r in recommend)}])")
    return f"sg AS (SELECT * FROM (VALUES {', '.join(rows)}) v(rule, family, priority, signal_no, path, recommend))"


_N = "[" + ", ".join(sql.q(n) for n in NAMES) + "]"
HITS = f"""WITH {_rules_sql()}, rf AS (SELECT c_custkey AS root, unnest(list_filter({_N}, lambda n, i: (c_custkey + i - 1) % 3 = 0)) AS path, c_custkey % 2 = 0 AS both_needles FROM customer),
  h AS (SELECT rf.root, sg.* FROM rf JOIN sg ON sg.path = rf.path WHERE sg.rule <> 'needs-both' OR both_needles),
  b AS (SELECT root, family, arg_min(rule, priority * 1000 + 0) AS rule0, min(priority) AS priority FROM h GROUP BY 1, 2),
  w AS (SELECT h.root, h.family, min(h.rule) AS rule, b.priority FROM h JOIN b ON b.root = h.root AND b.family = h.family AND b.priority = h.priority GROUP BY ALL),
  hits AS (SELECT w.root, w.family, w.rule, w.priority, list(h.path ORDER BY signal_no) AS signals, any_value(recommend) AS recommend FROM w JOIN h ON h.root = w.root AND h.rule = w.rule GROUP BY ALL)"""


def hits(spark, sf):
    return H.discover(repo_files(spark, sf), signals_frame(spark, [*DISCOVERY_RULES, EXTRA]))


@query("h1_discover", f"{HITS} SELECT root, family, rule, array_to_string(signals, ',') AS signals FROM hits")
def h1(spark, sf):
    return hits(spark, sf).select("root", "family", "rule", F.array_join("signals", ",").alias("signals"))


RECOMMENDED = f"""{HITS}, r AS (SELECT root, priority, rule, unnest(recommend) AS definition, generate_subscripts(recommend, 1) AS pos FROM hits),
  f AS (SELECT root, definition, min((priority, rule, pos)) AS k FROM r GROUP BY 1, 2),
  rec AS (SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY k) AS INTEGER) AS rank, definition FROM f)"""


@query("h2_recommendations", f"{RECOMMENDED} SELECT root, rank, definition FROM rec")
def h2(spark, sf):
    return H.recommendations(hits(spark, sf))


_DEFS = ", ".join(f"({sql.q(d['name'])}, {i}, {sql.q(c.lower())}, {str(bool(d.get('gate')) or bool(d.get('select_input'))).lower()})"
                  for d in definitions().values() for i, c in enumerate(d["commands"]))
COVERED = f"""{RECOMMENDED}, df AS (SELECT * FROM (VALUES {_DEFS}) v(definition, pos, command, blocked)),
  j AS (SELECT root, command, arg_min(df.definition, rank * 100 + pos) AS definition, arg_min(blocked, rank * 100 + pos) AS blocked FROM rec JOIN df ON df.definition = rec.definition GROUP BY 1, 2),
  cov AS (SELECT root, command, definition, CASE WHEN (command = 'npm ci' AND root % 2 = 0) OR (command = 'make' AND root % 4 = 0) THEN 'skipped_existing' WHEN blocked THEN 'blocked_not_representable' ELSE 'ready' END AS status FROM j)"""


def coverage(spark, sf):
    have = frames.table(spark, sf, "customer").select(F.col("c_custkey").alias("root"), F.explode(F.array(
        F.when(F.col("c_custkey") % 2 == 0, " NPM ci"), F.when(F.col("c_custkey") % 4 == 0, "make"))).alias("command")).where("command IS NOT NULL")
    return H.propose_coverage(H.recommendations(hits(spark, sf)), definitions(), have)


@query("h3_propose_coverage", f"{COVERED} SELECT root, command, definition, status FROM cov")
def h3(spark, sf):
    return coverage(spark, sf)


# Projects 1 to 4 run below the root, 5 elsewhere but shares a project with rows below it.
def led(spark, sf):
    cwd = F.when(F.col("user_id") % 10 < 4, F.concat(F.lit("/work/p"), F.col("user_id") % 10)).otherwise(F.lit("/tmp/x"))
    tool = F.when(F.col("id") % 5 == 0, "zig build").when(F.col("id") % 5 == 1, "-v deno test").otherwise(F.col("command"))
    cwd = F.when((F.col("id") % 700 == 9) & (F.col("user_id") % 10 == 5), F.lit("/work")).otherwise(cwd)
    return frames.ledger(spark, sf).withColumn("cwd", cwd).withColumn("command", tool)


LED = f"""{sql.LEDGER}, led AS (SELECT * REPLACE (CASE WHEN id % 700 = 9 AND user_id % 10 = 5 THEN '/work' WHEN user_id % 10 < 4 THEN '/work/p' || (user_id % 10) ELSE '/tmp/x' END AS cwd,
    CASE id % 5 WHEN 0 THEN 'zig build' WHEN 1 THEN '-v deno test' ELSE command END AS command) FROM ledger),
  fst AS (SELECT project, max((ts, id)) AS f FROM led WHERE cwd = '/work' OR starts_with(cwd, '/work/') GROUP BY 1),
  scoped AS (SELECT led.* FROM led LEFT JOIN fst ON fst.project = led.project WHERE cwd = '/work' OR starts_with(cwd, '/work/') OR led.project = '7' OR (f IS NOT NULL AND (ts, id) <= f))"""


@query("h6_project_scope", f"WITH {LED} SELECT id, project, cwd FROM scoped")
def h6(spark, sf):
    return H.project_scope(led(spark, sf), "/work", "7").select("id", "project", "cwd")


SAFETY = f"""{LED}, {sql.rule_values()}, oc AS (SELECT *, CASE id % 3 WHEN 0 THEN 'apply_fallback' WHEN 1 THEN 'stage_exception' ELSE 'short_circuit' END AS kind FROM led WHERE event_type = 'error'),
  rc AS (SELECT * FROM oc WHERE kind <> 'short_circuit' AND ts >= TIMESTAMP '{frames.AS_OF}' - INTERVAL 90 DAY),
  sc AS (SELECT * FROM rc WHERE project = '7' OR project IN (SELECT project FROM scoped) OR lower(command) IN (SELECT lower(command) FROM scoped)),
  ky AS (SELECT sc.id, any_value(lower(sc.command)) AS cmd, max_by(prefix, length(prefix)) AS p FROM sc LEFT JOIN rules ON lower(command) = prefix OR starts_with(lower(command), prefix || ' ') GROUP BY sc.id),
  saf AS (SELECT coalesce(p, cmd) AS command, count(*) AS incidents FROM ky GROUP BY 1 HAVING count(*) >= 3)"""


def safety(spark, sf):
    k = F.col("id") % 3
    out = led(spark, sf).where(F.col("event_type") == "error").withColumn(
        "kind", F.when(k == 0, "apply_fallback").when(k == 1, "stage_exception").otherwise("short_circuit"))
    return H.propose_safety(out, H.project_scope(led(spark, sf), "/work", "7"), rules_frame(spark), WORDS, frames.AS_OF, "7")


@query("h4_propose_safety", f"WITH {SAFETY} SELECT command, incidents FROM saf")
def h4(spark, sf):
    return safety(spark, sf)


_FAM = ", ".join(sql.q(w) for w in sorted({p.split()[0] for p in PREFIXES} | {"runsift"}))
UNM = f"""un AS (SELECT string_split(lower(command), ' ') AS w, raw_tokens FROM scoped WHERE NOT EXISTS (SELECT 1 FROM rules WHERE lower(command) = prefix OR starts_with(lower(command), prefix || ' '))),
  uw AS (SELECT list_filter(w, lambda q: q <> '' AND NOT starts_with(q, '-'))[1] AS command, raw_tokens FROM un),
  unm AS (SELECT command, count(*) AS uses, CAST(sum(greatest(raw_tokens, 0)) AS BIGINT) AS sum_raw FROM uw WHERE command NOT IN ({_FAM}) GROUP BY 1 HAVING count(*) >= 5 AND sum(greatest(raw_tokens, 0)) >= 2000)"""


def unmatched(spark, sf):
    return H.propose_unmatched(H.project_scope(led(spark, sf), "/work", "7"), PREFIXES)


@query("h5_propose_unmatched", f"WITH {LED}, {sql.rule_values()}, {UNM} SELECT * FROM unm")
def h5(spark, sf):
    return unmatched(spark, sf)


@query("h7_merge_proposals", f"""{COVERED}, {SAFETY}, {UNM}, al AS (
    SELECT 0 AS claim, 'coverage' AS kind, command, status, NULL::BIGINT AS uses, NULL::BIGINT AS incidents, NULL::BIGINT AS sum_raw, root FROM cov
    UNION ALL SELECT 1, 'safety', command, 'ready', NULL, incidents, NULL, 3 FROM saf UNION ALL SELECT 2, 'unmatched', command, 'ready', uses, NULL, sum_raw, 3 FROM unm),
  fr AS (SELECT *, row_number() OVER (PARTITION BY root, command ORDER BY claim) AS rn FROM al WHERE command <> 'deno'),
  o AS (SELECT root, kind, status, command, uses, incidents, sum_raw FROM fr WHERE rn = 1 UNION ALL
    SELECT DISTINCT root, kind, 'skipped_existing', command, NULL, NULL, NULL FROM al WHERE command = 'deno')
  SELECT sha256(kind || chr(0) || command || chr(0) || concat_ws('|', status, uses, incidents))[1:12] AS id, * FROM o""")
def h7(spark, sf):
    # the ledger belongs to the repository of customer 3; every repository has an override for deno
    have = frames.table(spark, sf, "customer").select(F.col("c_custkey").alias("root"), F.lit(" Deno").alias("command"))
    root = F.lit(3).cast("bigint")
    return H.merge_proposals(coverage(spark, sf), safety(spark, sf).withColumn("root", root), unmatched(spark, sf).withColumn("root", root), have)


FIRST_SEEN = ",\n  fst AS"


# --- all roots at once: one for each nation, some below others, some that share a project ---
ROOT_PATHS = ["/work", "/work/p1/", "/work/p2", "/tmp", "/nowhere", "/work/p"]


def roots(spark, sf):
    k = F.col("n_nationkey")
    path = F.get(F.array(*map(F.lit, ROOT_PATHS)), (k % len(ROOT_PATHS)).cast("int"))
    return frames.table(spark, sf, "nation").select(k.cast("bigint").alias("root"), path.alias("path"), F.when(k % 2 == 0, (k % 10).cast("string")).alias("fingerprint"))


_ROOTS = f"""{LED.split(FIRST_SEEN)[0]},
  rt AS (SELECT CAST(n_nationkey AS BIGINT) AS root, rtrim([{', '.join(sql.q(x) for x in ROOT_PATHS)}][n_nationkey % {len(ROOT_PATHS)} + 1], '/') AS path, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey % 10 AS VARCHAR) END AS fp FROM nation),
  ins AS (SELECT rt.root, led.* FROM led JOIN rt ON led.cwd = rt.path OR starts_with(led.cwd, rt.path || '/')),
  fs AS (SELECT root, project, max((ts, id)) AS f FROM ins GROUP BY 1, 2),
  sp AS (SELECT root, id FROM ins UNION SELECT rt.root, led.id FROM led JOIN rt ON led.project = rt.fp UNION SELECT fs.root, led.id FROM led JOIN fs ON fs.project = led.project AND (led.ts, led.id) <= fs.f),
  scoped AS (SELECT sp.root, led.* FROM sp JOIN led ON led.id = sp.id)"""
_SAFETY_ALL = f"""{_ROOTS}, {sql.rule_values()}, oc AS (SELECT *, CASE id % 3 WHEN 0 THEN 'apply_fallback' WHEN 1 THEN 'stage_exception' ELSE 'short_circuit' END AS kind FROM led WHERE event_type = 'error'),
  rc AS (SELECT * FROM oc WHERE kind <> 'short_circuit' AND ts >= TIMESTAMP '{frames.AS_OF}' - INTERVAL 90 DAY),
  wa AS (SELECT DISTINCT root, project, lower(command) AS cmd FROM scoped),
  sc AS (SELECT DISTINCT rt.root, rc.id, rc.command FROM rc JOIN rt ON rc.project = rt.fp UNION SELECT wa.root, rc.id, rc.command FROM rc JOIN wa ON wa.project = rc.project UNION SELECT wa.root, rc.id, rc.command FROM rc JOIN wa ON wa.cmd = lower(rc.command)),
  ky AS (SELECT root, sc.id, any_value(lower(sc.command)) AS cmd, max_by(prefix, length(prefix)) AS p FROM sc LEFT JOIN rules ON lower(command) = prefix OR starts_with(lower(command), prefix || ' ') GROUP BY 1, 2),
  saf AS (SELECT root, coalesce(p, cmd) AS command, count(*) AS incidents FROM ky GROUP BY 1, 2 HAVING count(*) >= 3)"""
_UNM_ALL = f"""un AS (SELECT root, string_split(lower(command), ' ') AS w, raw_tokens FROM scoped WHERE NOT EXISTS (SELECT 1 FROM rules WHERE lower(command) = prefix OR starts_with(lower(command), prefix || ' '))),
  uw AS (SELECT root, list_filter(w, lambda q: q <> '' AND NOT starts_with(q, '-'))[1] AS command, raw_tokens FROM un),
  unm AS (SELECT root, command, count(*) AS uses, CAST(sum(greatest(raw_tokens, 0)) AS BIGINT) AS sum_raw FROM uw WHERE command NOT IN ({_FAM}) GROUP BY 1, 2 HAVING count(*) >= 5 AND sum(greatest(raw_tokens, 0)) >= 2000)"""


def scoped_all(spark, sf):
    return H.scope_all(led(spark, sf), roots(spark, sf))


def safety_all(spark, sf):
    k = F.col("id") % 3
    out = led(spark, sf).where(F.col("event_type") == "error").withColumn("kind", F.when(k == 0, "apply_fallback").when(k == 1, "stage_exception").otherwise("short_circuit"))
    return H.propose_safety_all(out, scoped_all(spark, sf), roots(spark, sf), rules_frame(spark), WORDS, frames.AS_OF)


@query("h6_scope_all_roots", f"WITH {_ROOTS} SELECT root, id, project, cwd FROM scoped")
def h6a(spark, sf):
    return scoped_all(spark, sf).select("root", "id", "project", "cwd")


@query("h4_safety_all_roots", f"WITH {_SAFETY_ALL} SELECT root, command, incidents FROM saf")
def h4a(spark, sf):
    return safety_all(spark, sf)


@query("h5_unmatched_all_roots", f"WITH {_ROOTS}, {sql.rule_values()}, {_UNM_ALL} SELECT * FROM unm")
def h5a(spark, sf):
    return H.propose_unmatched_all(scoped_all(spark, sf), PREFIXES)


@query("h7_merge_all_roots", f"""{COVERED}, {_SAFETY_ALL}, {_UNM_ALL}, al AS (
    SELECT 0 AS claim, 'coverage' AS kind, command, status, NULL::BIGINT AS uses, NULL::BIGINT AS incidents, NULL::BIGINT AS sum_raw, root FROM cov
    UNION ALL SELECT 1, 'safety', command, 'ready', NULL, incidents, NULL, root FROM saf UNION ALL SELECT 2, 'unmatched', command, 'ready', uses, NULL, sum_raw, root FROM unm),
  ex AS (SELECT *, command = 'deno' AND root % 2 = 1 AS have FROM al), fr AS (SELECT *, row_number() OVER (PARTITION BY root, command ORDER BY claim) AS rn FROM ex WHERE NOT have),
  o AS (SELECT root, kind, status, command, uses, incidents, sum_raw FROM fr WHERE rn = 1 UNION ALL SELECT DISTINCT root, kind, 'skipped_existing', command, NULL, NULL, NULL FROM ex WHERE have)
  SELECT sha256(kind || chr(0) || command || chr(0) || concat_ws('|', status, uses, incidents))[1:12] AS id, * FROM o""")
def h7a(spark, sf):
    # every second repository has an override for deno
    have = frames.table(spark, sf, "customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("root"), F.lit(" Deno").alias("command"))
    have = have.unionByName(roots(spark, sf).where("root % 2 = 1").select("root", F.lit("deno").alias("command")))
    return H.merge_proposals(coverage(spark, sf), safety_all(spark, sf), H.propose_unmatched_all(scoped_all(spark, sf), PREFIXES), have)


# --- I ----------------------------------------------------------------------------------
def html_files(spark, sf):
    return frames.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").alias("text"))


_HTML = """WITH t AS (SELECT 'p' || page_id || '.html' AS path, replace(html, chr(13), '') AS src, html, array_to_string(list_transform(regexp_extract_all(replace(html, chr(13), ''), '(?s)<!--.*?(?:-->|$)|[^<]+|<'),
    lambda q: CASE WHEN starts_with(q, '<!--') THEN regexp_replace(q, '[^\\n]+', '', 'g') ELSE q END), '') AS s FROM pages),
  l AS (SELECT path, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS line_no FROM t),"""
_KEEP = f" k AS (SELECT path, 'html' AS language, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE NOT {sql.blank('line')})"


@query("i2_strip_comments_html", f"{_HTML}{_KEEP} SELECT * FROM k")
def i2(spark, sf):
    return I.strip_comments(html_files(spark, sf))


_OUT = r"regexp_matches(line, '^\s*</?(html|head|body|main|section|article|h[1-6]|script|style)\b')"


@query("i3_outline_html", f"{_HTML}{_KEEP}, o AS (SELECT *, bool_or({_OUT}) OVER (PARTITION BY path) AS has FROM k) "
       f"SELECT path, language, CASE WHEN has THEN 'outline' ELSE 'comments' END AS level, line_no, line FROM o WHERE NOT has OR {_OUT}")
def i3(spark, sf):
    return I.outline(html_files(spark, sf))


EXTS = [".java", ".py", ".sql", ".css", ".yaml", ".zzz", ".go", ".json"]
CODE = ("CASE {i} % 6 WHEN 0 THEN 'a = \"x // y # z\" ' || substr(md5(x), 1, 6) || ' // tail' WHEN 1 THEN '/* block ' || {i} WHEN 2 THEN 'inside \"quote' || {i} WHEN 3 THEN ' end */ code(' || {i} || ')' "
        "WHEN 4 THEN '# hash -- dash' ELSE 'v' || {i} || ' -- c' || {i} END")


def code_files(spark, sf):
    d = frames.rewrite(spark, sf, CODE)
    ext = F.get(F.array(*map(F.lit, EXTS)), (F.col("run_id") % len(EXTS)).cast("int"))
    return d.select(F.concat(F.lit("src/f"), F.col("run_id"), ext).alias("path"), "text")


def _re2(lang: str) -> str:
    """A language's pattern in the oracle's dialect (no possessive loops, no lookahead)."""
    p = I.token_pattern(lang)
    for a, b in (("*+", "*"), ("++", "+"), ("}+", "}"), ("\\z", "$")):
        p = p.replace(a, b)
    return p


_LANG = "CASE run_id % 8 WHEN 0 THEN 'java' WHEN 1 THEN 'python' WHEN 2 THEN 'sql' WHEN 3 THEN 'css' WHEN 4 THEN 'yaml' WHEN 6 THEN 'go' WHEN 7 THEN 'json' END"
_TRIPLE = r'"""(?:[^"\\]|\\.|"(?!""))*(?:"""|$)|'
_CODE = f"""WITH {sql.rewritten(CODE)}, f AS (SELECT 'src/f' || run_id || {EXTS}[run_id % 8 + 1] AS path, {_LANG} AS language, text FROM docs),
  tk AS (SELECT *, CASE language WHEN 'java' THEN regexp_extract_all(text, {sql.q(_re2('java').replace(_TRIPLE, ''))})
    WHEN 'python' THEN regexp_extract_all(text, {sql.q(_re2('python').replace(_TRIPLE, '').replace(_TRIPLE.replace('"', "'"), ''))}) WHEN 'sql' THEN regexp_extract_all(text, {sql.q(_re2('sql'))})
    WHEN 'css' THEN regexp_extract_all(text, {sql.q(_re2('css'))}) WHEN 'yaml' THEN regexp_extract_all(text, {sql.q(_re2('yaml'))}) WHEN 'go' THEN regexp_extract_all(text, {sql.q(_re2('go'))}) ELSE [text] END AS tk FROM f),
  t AS (SELECT path, language, text, array_to_string(list_transform(tk, lambda q: CASE WHEN (language IN ('java', 'go') AND regexp_matches(q, '^(//|/\\*)')) OR (language IN ('python', 'yaml') AND starts_with(q, '#'))
    OR (language = 'sql' AND regexp_matches(q, '^(--|/\\*)')) OR (language = 'css' AND starts_with(q, '/*')) THEN regexp_replace(q, '[^\\n]+', '', 'g') ELSE q END), '') AS s FROM tk),
  l AS (SELECT path, coalesce(language, 'unknown') AS language, unnest(string_split(s, chr(10))) AS line, generate_subscripts(string_split(s, chr(10)), 1) AS line_no FROM t),
  k AS (SELECT path, language, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE NOT {sql.blank('line')})"""


@query("i1_detect_language", f"{_CODE} SELECT path, language FROM f")
def i1(spark, sf):
    return code_files(spark, sf).select("path", I.detect_language(F.col("path")).alias("language"))


@query("i2_strip_comments", f"{_CODE} SELECT * FROM k")
def i2c(spark, sf):
    return I.strip_comments(code_files(spark, sf))


@query("i4_corpus_savings", f"""{_CODE}, g AS (SELECT path, array_to_string(list(line ORDER BY line_no), chr(10)) AS kept FROM k GROUP BY path),
  j AS (SELECT coalesce(t.language, 'unknown') AS language, t.text, coalesce(g.kept, '') AS kept FROM t LEFT JOIN g ON g.path = t.path)
  SELECT language, count(*) AS files, CAST(sum({sql.nlines('text')}) AS BIGINT) AS lines_in, CAST(sum({sql.nlines('kept')}) AS BIGINT) AS lines_out, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
    CAST(sum({sql.tokens('text')}) AS BIGINT) AS raw_tokens, CAST(sum({sql.tokens('kept')}) AS BIGINT) AS out_tokens FROM j GROUP BY language""")
def i4(spark, sf):
    return I.corpus_savings(code_files(spark, sf))
