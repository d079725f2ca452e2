"""Queries over the line-reduction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.functions.text import decode_text, lines_of
from runsift.operators import reduce as R
from runsift.plans import frames, sql
from runsift.plans.registry import query


def _out(df, reduced):
    done = df.select("run_id", F.size(lines_of(F.col("text"))).alias("lines_in"), reduced.alias("text"))
    return done.select("run_id", "text", "lines_in", F.size(lines_of(F.col("text"))).alias("lines_out"))


def _sql(frame: str, body: str) -> str:
    """``body`` is a select giving run_id, t (input) and o (output) from docs."""
    return (f"WITH {frame}, r AS ({body}) SELECT run_id, o AS text, {sql.nlines('t')} AS lines_in, "
            f"{sql.nlines('o')} AS lines_out FROM r")


def _t():
    return F.col("text")


@query("c1_ansi_strip", _sql(sql.NOISY, r"""SELECT run_id, text AS t, regexp_replace(regexp_replace(text, '[^\n]*\r', '', 'g'),
  '\x1B\[[0-9;]*[mGKHFJABCDsu]', '', 'g') AS o FROM docs""").replace(sql.nlines("t"), sql.nlines("replace(t, chr(13), chr(10))")))
def c1(spark, sf):
    return _out(frames.noisy_runs(spark, sf), R.ansi_strip(_t()))


@query("c2_last_meaningful_line", f"WITH {sql.NOISY}, s AS (SELECT run_id, regexp_replace(regexp_replace(text, "
       r"'[^\n]*\r', '', 'g'), '\x1B\[[0-9;]*[mGKHFJABCDsu]', '', 'g') AS t FROM docs) "
       f"SELECT run_id, coalesce(({sql.nonblank(sql.lines('t'))})[-1], '') AS line FROM s")
def c2(spark, sf):
    return frames.noisy_runs(spark, sf).select("run_id", R.last_meaningful_line(_t()).alias("line"))


def _head_tail_sql(h: int, t: int, src: str = "text") -> str:
    ls = sql.lines(src)
    n = f"len({ls})"
    return (f"CASE WHEN {n} <= {h + t} THEN {src} ELSE " + sql.rstrip(sql.join(
        f"list_concat({ls}[1:{h}], ['... (' || ({n} - {h + t}) || ' lines omitted: lines {h + 1}..' || ({n} - {t}) || ' of ' "
        f"|| {n} || ') ...'], {ls}[{n} - {t} + 1:])")) + " END")


@query("c3_head_tail", _sql(sql.DOCS, f"SELECT run_id, text AS t, {_head_tail_sql(4, 6)} AS o FROM docs"))
def c3(spark, sf):
    return _out(frames.docs(spark, sf), R.head_tail(_t(), 4, 6))


@query("c4_tail_lines", _sql(sql.DOCS, f"""SELECT run_id, text AS t, CASE WHEN len(ls) <= 5 THEN {sql.join('ls')} ELSE
  '... (' || (len(ls) - 5) || ' lines omitted: lines 1..' || (len(ls) - 5) || ' of ' || len(ls) || ') ...' || chr(10)
  || {sql.join('ls[len(ls) - 4:]')} END AS o FROM (SELECT *, {sql.nonblank(sql.lines('text'))} AS ls FROM docs)"""))
def c4(spark, sf):
    return _out(frames.docs(spark, sf), R.tail_lines(_t(), 5, skip_blank=True))


@query("c4_tail_lines_header", _sql(sql.DOCS, f"""SELECT run_id, text AS t, CASE WHEN len(ls) <= 5 THEN
  '... (0 lines omitted: showing all ' || len(ls) || ' lines) ...' || chr(10) || {sql.join('ls')} ELSE
  '... (' || (len(ls) - 5) || ' lines omitted: lines 1..' || (len(ls) - 5) || ' of ' || len(ls) || ') ...' || chr(10)
  || {sql.join('ls[len(ls) - 4:]')} END AS o FROM (SELECT *, {sql.lines('text')} AS ls FROM docs)"""))
def c4b(spark, sf):
    return _out(frames.docs(spark, sf), R.tail_lines(_t(), 5, skip_blank=False, header_only_when_truncating=False))


def _dedup_sql(window: int) -> str:
    """Line-by-line recursion over all documents: the live keys travel as a list."""
    suffix = r"\s+\(×\d+\)$"
    return f"""WITH RECURSIVE {sql.DOCS}, l AS (SELECT run_id, {sql.lines('text')} AS ls, text FROM docs),
  st AS (SELECT run_id, 0 AS i, CAST([] AS VARCHAR[]) AS keys, CAST([] AS BIGINT[]) AS pos, CAST(0 AS BIGINT) AS hit FROM l
    UNION ALL
    SELECT st.run_id, st.i + 1,
      CASE WHEN p IS NOT NULL THEN keys WHEN len(keys) >= {window} THEN list_append(keys[2:], k) ELSE list_append(keys, k) END,
      CASE WHEN p IS NOT NULL THEN pos WHEN len(keys) >= {window} THEN list_append(pos[2:], st.i + 1) ELSE list_append(pos, st.i + 1) END,
      CASE WHEN p IS NOT NULL THEN pos[p] ELSE st.i + 1 END
    FROM (SELECT st.*, {sql.trim('l.ls[st.i + 1]')} AS k, list_position(st.keys, {sql.trim('l.ls[st.i + 1]')}) AS p
          FROM st JOIN l ON l.run_id = st.run_id WHERE st.i < len(l.ls)) st),
  c AS (SELECT run_id, hit, count(*) AS n FROM st WHERE i > 0 GROUP BY run_id, hit),
  o AS (SELECT c.run_id, array_to_string(list(CASE WHEN n = 1 THEN ls[hit] ELSE
      {sql.rstrip(f"regexp_replace(ls[hit], '{suffix}', '')")} || ' (×' || n || ')' END ORDER BY hit), chr(10)) AS o
    FROM c JOIN l ON l.run_id = c.run_id GROUP BY c.run_id),
  r AS (SELECT l.run_id, l.text AS t, coalesce(o.o, '') AS o FROM l LEFT JOIN o ON o.run_id = l.run_id)
  SELECT run_id, o AS text, {sql.nlines('t')} AS lines_in, {sql.nlines('o')} AS lines_out FROM r"""


@query("c5_deduplicate", _dedup_sql(50))
def c5(spark, sf):
    return _out(frames.docs(spark, sf), R.deduplicate(_t(), 50))


@query("c5_deduplicate_window5", _dedup_sql(5))
def c5b(spark, sf):
    return _out(frames.docs(spark, sf), R.deduplicate(_t(), 5))


WORD = r"^\W*(\w+)\s+\w+,"
WORD_SQL = r"^\W*(\w+)\s+\w+,"


@query("c6_grouping", f"""WITH {sql.DOCS}, x AS (SELECT run_id, unnest({sql.lines('text')}) AS line FROM docs),
  k AS (SELECT run_id, CASE WHEN regexp_matches(line, '^([A-Z][a-z]+) ') THEN trim(regexp_extract(line, '^([A-Z][a-z]+) ', 1))
    ELSE '(other)' END AS key FROM x)
  SELECT run_id, key, count(*) AS cnt, CAST(row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, key) AS INTEGER) AS rank
  FROM k GROUP BY run_id, key""")
def c6(spark, sf):
    return R.group_lines(frames.docs(spark, sf), "^([A-Z][a-z]+) ", include_other=True)


@query("c6_grouping_text", f"""WITH {sql.DOCS}, x AS (SELECT run_id, unnest({sql.lines('text')}) AS line FROM docs),
  k AS (SELECT run_id, regexp_extract(line, '^([A-Z][a-z]+) ', 1) AS key, count(*) AS cnt FROM x
    WHERE regexp_matches(line, '^([A-Z][a-z]+) ') GROUP BY 1, 2),
  w AS (SELECT *, max(length(key)) OVER (PARTITION BY run_id) AS kw, length(CAST(max(cnt) OVER (PARTITION BY run_id) AS VARCHAR)) AS cw FROM k),
  g AS (SELECT run_id, array_to_string(list('  ' || rpad(key, CAST(kw AS INTEGER), ' ') || ' : ' || lpad(CAST(cnt AS VARCHAR), CAST(cw AS INTEGER), ' ')
    ORDER BY cnt DESC, key), chr(10)) AS o FROM w GROUP BY run_id)
  SELECT d.run_id, coalesce(g.o, '') AS text, {sql.nlines('d.text')} AS lines_in, {sql.nlines("coalesce(g.o, '')")} AS lines_out
  FROM docs d LEFT JOIN g ON g.run_id = d.run_id""")
def c6t(spark, sf):
    return _out(frames.docs(spark, sf), R.grouping(_t(), "^([A-Z][a-z]+) "))


@query("c7_aggregate_by_key", f"""WITH {sql.HITS}, x AS (SELECT run_id, unnest({sql.nonblank(sql.lines('text'))}) AS line,
    generate_subscripts({sql.nonblank(sql.lines('text'))}, 1) AS no FROM docs),
  k AS (SELECT run_id, CASE WHEN instr(line, ':') > 1 THEN split_part(line, ':', 1) ELSE '(stdin)' END AS key, count(*) AS cnt, min(no) AS fst
    FROM x GROUP BY 1, 2)
  SELECT run_id, key, cnt, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, fst) AS INTEGER) AS rank FROM k) WHERE rank <= 3""")
def c7(spark, sf):
    return R.count_keys(frames.hit_texts(spark, sf), "prefix_before_colon", 3)


@query("c7_aggregate_by_key_text", f"""WITH {sql.PATHS}, x AS (SELECT run_id, unnest({sql.nonblank(sql.lines('text'))}) AS line,
    generate_subscripts({sql.nonblank(sql.lines('text'))}, 1) AS no FROM docs),
  k AS (SELECT run_id, CASE WHEN contains(line, '.') THEN '.' || string_split(line, '.')[-1] ELSE '(no extension)' END AS key,
    count(*) AS cnt, min(no) AS fst FROM x GROUP BY 1, 2),
  q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, fst) AS rk FROM k),
  g AS (SELECT run_id, CAST(sum(cnt) AS BIGINT) || ' lines, ' || count(*) || ' keys' || chr(10) || array_to_string(list('  ' || key || ': ' || cnt
    ORDER BY rk) FILTER (rk <= 2), chr(10)) AS o FROM q GROUP BY run_id)
  SELECT d.run_id, coalesce(g.o, '0 lines, 0 keys') AS text, {sql.nlines('d.text')} AS lines_in,
    {sql.nlines("coalesce(g.o, '0 lines, 0 keys')")} AS lines_out FROM docs d LEFT JOIN g ON g.run_id = d.run_id""")
def c7t(spark, sf):
    return _out(frames.path_texts(spark, sf), R.aggregate_by_key(_t(), "file_extension", "{lines} lines, {keys} keys", 2))


@query("c8_regex_capture", _sql(sql.DOCS, r"""SELECT run_id, text AS t, CASE WHEN regexp_matches(text, '([A-Z]\w+) (\w+)[.,]')
  THEN regexp_extract(text, '([A-Z]\w+) (\w+)[.,]', 2) || ' <- ' || regexp_extract(text, '([A-Z]\w+) (\w+)[.,]', 1) || ' in ' ||
  regexp_extract(text, '([A-Z]\w+) (\w+)[.,]', 0) ELSE 'none' END AS o FROM docs"""))
def c8(spark, sf):
    return _out(frames.docs(spark, sf), R.regex_capture(_t(), r"([A-Z]\w+) (\w+)[.,]", "$2 <- $1 in $0", "none"))


MACHINE = dict(initial="KEEP", transitions=[
    {"from_state": "KEEP", "pattern": "^[A-F]", "action": "DISCARD", "next_state": "SKIP"},
    {"from_state": "KEEP", "pattern": "^[G-M]", "action": "EMIT", "next_state": "KEEP"},
    {"from_state": "SKIP", "pattern": "^[A-F]", "action": "DISCARD", "next_state": "SKIP"},
    {"from_state": "SKIP", "pattern": "^[N-Z]", "action": "EMIT", "next_state": "KEEP"}],
    defaults={"KEEP": "EMIT", "SKIP": "DISCARD"})


@query("c9_state_machine", f"""WITH {sql.DOCS}, x AS (SELECT run_id, unnest({sql.lines('text')}) AS line,
    generate_subscripts({sql.lines('text')}, 1) AS no FROM docs),
  e AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-F]') THEN 'SKIP' WHEN regexp_matches(line, '^[N-Z]') THEN 'KEEP' END AS mark FROM x),
  s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no), 'KEEP') AS after_state FROM e),
  g AS (SELECT run_id, array_to_string(list(line ORDER BY no) FILTER (after_state = 'KEEP'), chr(10)) AS o FROM s GROUP BY run_id)
  SELECT d.run_id, coalesce(g.o, '') AS text, {sql.nlines('d.text')} AS lines_in, {sql.nlines("coalesce(g.o, '')")} AS lines_out
  FROM docs d LEFT JOIN g ON g.run_id = d.run_id""")
def c9(spark, sf):
    return _out(frames.docs(spark, sf), R.state_machine(_t(), **MACHINE))


@query("c10_tree_compression", f"""WITH {sql.PATHS}, x AS (SELECT run_id, unnest({sql.lines('text')}) AS p,
    generate_subscripts({sql.lines('text')}, 1) AS no FROM docs),
  f AS (SELECT run_id, no, regexp_extract(p, '^(.*)/[^/]*$', 1) AS d, string_split(p, '/')[-1] AS name FROM x),
  dirs AS (SELECT DISTINCT run_id, d FROM f UNION SELECT DISTINCT run_id, split_part(d, '/', 1) FROM f),
  b AS (SELECT dirs.run_id, dirs.d, repeat('  ', len(string_split(dirs.d, '/')) - 1) AS pad, count(f.no) AS n,
    list(f.name ORDER BY f.no) FILTER (f.no IS NOT NULL) AS names FROM dirs LEFT JOIN f ON f.run_id = dirs.run_id AND f.d = dirs.d GROUP BY 1, 2),
  t AS (SELECT run_id, d, pad || string_split(d, '/')[-1] || '/' || CASE WHEN n = 0 THEN '' WHEN n > 8 THEN chr(10) || pad || '  (' || n || ' files)'
    ELSE chr(10) || array_to_string(list_transform(names, lambda q: pad || '  ' || q), chr(10)) END AS blk FROM b),
  g AS (SELECT run_id, array_to_string(list(blk ORDER BY string_split(d, '/')), chr(10)) AS o FROM t GROUP BY run_id)
  SELECT d.run_id, coalesce(g.o, '') AS text, {sql.nlines('d.text')} AS lines_in, {sql.nlines("coalesce(g.o, '')")} AS lines_out
  FROM docs d LEFT JOIN g ON g.run_id = d.run_id""")
def c10(spark, sf):
    return _out(frames.path_texts(spark, sf), R.tree_compression(_t()))


@query("c10_directory_counts", f"""WITH {sql.PATHS}, x AS (SELECT run_id, unnest({sql.lines('text')}) AS p FROM docs)
  SELECT run_id, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files, count(*) > 8 AS collapsed FROM x GROUP BY 1, 2""")
def c10b(spark, sf):
    return R.directory_counts(frames.path_texts(spark, sf))


@query("c11_empty_tree_fallback", f"""WITH {sql.DOCS} SELECT run_id, CASE WHEN run_id % 3 = 0 THEN
  len({sql.nonblank(sql.lines('text'))}) || ' items' ELSE 'tree' END AS text FROM docs""")
def c11(spark, sf):
    tree = F.when(F.col("run_id") % 3 == 0, F.lit("  \n")).otherwise(F.lit("tree"))
    return frames.docs(spark, sf).select("run_id", R.empty_tree_fallback(tree, _t()).alias("text"))


@query("c12_json_structure", """SELECT event_id AS run_id, '{' || chr(10) || '  "k" : 0,' || chr(10) || '  "tags" : [ "<string>"' ||
  CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "... +' || (event_id % 3) || ' more"' END || ' ],' || chr(10) || '  "o" : {' || chr(10) ||
  '    "t" : "<string>",' || chr(10) || '    "ok" : false' || chr(10) || '  }' || chr(10) || '}' AS text FROM events""")
def c12(spark, sf):
    e = frames.table(spark, sf, "events")
    tags = F.array_join(F.array_repeat(F.concat(F.lit('"'), "event_type", F.lit('"')), (F.col("event_id") % 3 + 1).cast("int")), ",")
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "tags": ['), tags, F.lit('], "o": {"t": "x", "ok": true}}'))
    return e.select(F.col("event_id").alias("run_id"), R.json_structure(doc).alias("text"))


@query("c12_json_profile", """SELECT event_type AS command, count(*) AS documents, 'k:number' AS fields FROM events GROUP BY 1""")
def c12b(spark, sf):
    return R.json_profile(frames.table(spark, sf, "events").select(F.col("event_type").alias("command"), F.col("props").alias("text")))


@query("c13_large_document_policy", _sql(sql.DOCS, f"""SELECT run_id, text AS t, CASE WHEN len({sql.lines('text')}) > 200 THEN
  {_head_tail_sql(120, 60)} ELSE text END AS o FROM (SELECT run_id, repeat(text || chr(10), 12) AS text FROM docs)"""))
def c13(spark, sf):
    long = frames.docs(spark, sf).withColumn("text", F.repeat(F.concat("text", F.lit("\n")), 12))
    return _out(long, R.large_document(_t()))


@query("c14_search_result_sample", f"""WITH {sql.HITS}, x AS (SELECT run_id, unnest({sql.nonblank(sql.lines('text'))}) AS line,
    generate_subscripts({sql.nonblank(sql.lines('text'))}, 1) AS no FROM docs),
  f AS (SELECT *, split_part(line, ':', 1) AS file, {sql.strip('line')} AS shown FROM x),
  a AS (SELECT *, min(no) OVER (PARTITION BY run_id, file) AS fst, row_number() OVER (PARTITION BY run_id, file ORDER BY no) AS rf,
    count(*) OVER (PARTITION BY run_id) AS total FROM f),
  v AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rf > 12, fst, no) AS rk FROM a),
  g AS (SELECT run_id, max(total) AS total, count(DISTINCT file) AS files, list(shown ORDER BY rk) FILTER (rf <= 12 AND rk <= 80) AS vis FROM v GROUP BY run_id),
  r AS (SELECT d.run_id, d.text AS t, CASE WHEN coalesce(total, 0) <= 40 THEN d.text ELSE {sql.rstrip(
      "total || ' match(es) in ' || files || ' file(s)' || chr(10) || array_to_string(vis, chr(10)) || CASE WHEN total > len(vis) "
      "THEN chr(10) || '... (' || (total - len(vis)) || ' matches omitted) ...' ELSE '' END")} END AS o
    FROM docs d LEFT JOIN g ON g.run_id = d.run_id)
  SELECT run_id, o AS text, {sql.nlines('t')} AS lines_in, {sql.nlines('o')} AS lines_out FROM r""")
def c14(spark, sf):
    return _out(frames.hit_texts(spark, sf), R.search_result_sample(_t()))


@query("c15_path_listing_sample", f"""WITH {sql.PATHS}, x AS (SELECT run_id, unnest({sql.lines('text')}) AS p,
    generate_subscripts({sql.lines('text')}, 1) AS no FROM docs),
  f AS (SELECT run_id, no, regexp_extract(p, '^(.*)/[^/]*$', 1) AS d, string_split(p, '/')[-1] AS name FROM x),
  n AS (SELECT run_id, count(*) AS n FROM f GROUP BY 1),
  dl AS (SELECT run_id, d, min(no) AS fst, d || '/: ' || array_to_string(list(name ORDER BY no), ', ') AS row FROM f WHERE no <= 100 GROUP BY 1, 2),
  dj AS (SELECT run_id, array_to_string(list(row ORDER BY fst), chr(10)) AS body FROM dl GROUP BY 1),
  ex AS (SELECT run_id, '.' || string_split(name, '.')[-1] AS e, count(*) AS c, min(no) AS fst FROM f WHERE contains(name, '.') GROUP BY 1, 2),
  ej AS (SELECT run_id, array_to_string(list(e || ': ' || c ORDER BY fst), ', ') AS hist FROM ex GROUP BY 1),
  r AS (SELECT docs.run_id, docs.text AS t, CASE WHEN coalesce(n.n, 0) <= 40 THEN docs.text ELSE body || chr(10) ||
    CASE WHEN n.n > 100 THEN '... (' || (n.n - 100) || ' paths omitted) ...' || chr(10) ELSE '' END || n.n || ' result(s)' || coalesce(' — ' || hist, '') END AS o
    FROM docs LEFT JOIN n ON n.run_id = docs.run_id LEFT JOIN dj ON dj.run_id = docs.run_id LEFT JOIN ej ON ej.run_id = docs.run_id)
  SELECT run_id, o AS text, {sql.nlines('t')} AS lines_in, {sql.nlines('o')} AS lines_out FROM r""")
def c15(spark, sf):
    return _out(frames.path_texts(spark, sf), R.path_listing_sample(_t()))


@query("c15_extension_counts", f"""WITH {sql.PATHS}, x AS (SELECT run_id, unnest({sql.lines('text')}) AS p,
    generate_subscripts({sql.lines('text')}, 1) AS no FROM docs),
  k AS (SELECT run_id, '.' || string_split(p, '.')[-1] AS key, count(*) AS cnt, min(no) AS fst FROM x WHERE contains(p, '.') GROUP BY 1, 2)
  SELECT run_id, key, cnt, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cnt DESC, fst) AS INTEGER) AS rank FROM k""")
def c15b(spark, sf):
    return R.extension_counts(frames.path_texts(spark, sf))


@query("c18_unhealthy_first", f"""WITH {sql.DOCS}, l AS (SELECT run_id, text, {sql.lines('text')} AS ls FROM docs),
  p AS (SELECT *, list_filter(ls[2:], lambda q: regexp_matches(q, '(?i)Error|CrashLoopBackOff|OOMKilled|Pending|Terminating')) AS bad,
    list_concat(ls[1:1], list_filter(ls[2:], lambda q: NOT regexp_matches(q, '(?i)Error|CrashLoopBackOff|OOMKilled|Pending|Terminating'))) AS good FROM l),
  r AS (SELECT run_id, text AS t, {sql.rstrip("CASE WHEN len(bad) > 0 THEN 'UNHEALTHY PODS:' || chr(10) || array_to_string(list_transform(bad, lambda q: '  ⚠ ' || "
      + sql.trim('q') + "), chr(10)) || chr(10) || chr(10) ELSE '' END || array_to_string(good, chr(10))")} AS o FROM p)
  SELECT run_id, o AS text, {sql.nlines('t')} AS lines_in, {sql.nlines('o')} AS lines_out FROM r""".replace("FROM docs)", "FROM docs)", 1).replace(
      "SELECT run_id, text, ", "SELECT run_id, replace(text, ' the', ' Pending') AS text, ", 1).replace(sql.lines("text"), sql.lines("replace(text, ' the', ' Pending')"), 1))
def c18(spark, sf):
    pods = frames.docs(spark, sf).withColumn("text", F.replace("text", F.lit(" the"), F.lit(" Pending")))
    return _out(pods, R.unhealthy_first(_t(), F.lit("kubectl get pods")))


LOG_LINE = "CASE WHEN {i} % 4 = 0 THEN 'commit ' || md5(x)[1:40] WHEN {i} % 4 = 1 THEN 'Author: a' WHEN {i} % 4 = 2 THEN '' ELSE '    ' || x END"


@query("c19_git_log_top", f"""WITH {sql.rewritten(LOG_LINE)}, x AS (SELECT run_id, unnest({sql.lines('text')}) AS line,
    generate_subscripts({sql.lines('text')}, 1) AS no FROM docs),
  h AS (SELECT *, CASE WHEN regexp_matches(line, '^commit [0-9a-f]{{8}}') THEN no END AS start FROM x),
  c AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no) AS cs FROM h),
  s AS (SELECT run_id, cs, min(no) AS sn FROM c WHERE cs IS NOT NULL AND start IS NULL AND NOT {sql.blank('line')}
    AND NOT regexp_matches(line, '^(Author:|Date:|Merge:)') GROUP BY 1, 2),
  m AS (SELECT s.run_id, s.cs, substr(a.line, 8, 8) || ' ' || {sql.trim('b.line')} AS row,
    row_number() OVER (PARTITION BY s.run_id ORDER BY s.cs) AS rk, count(*) OVER (PARTITION BY s.run_id) AS n
    FROM s JOIN x a ON a.run_id = s.run_id AND a.no = s.cs JOIN x b ON b.run_id = s.run_id AND b.no = s.sn),
  g AS (SELECT run_id, array_to_string(list(row ORDER BY rk) FILTER (rk <= 10), chr(10)) || CASE WHEN max(n) > 10 THEN chr(10) || '(+' || (max(n) - 10) || ' more)' ELSE '' END AS o
    FROM m GROUP BY run_id)
  SELECT d.run_id, coalesce(g.o, '(no commits)') AS text, {sql.nlines('d.text')} AS lines_in, {sql.nlines("coalesce(g.o, '(no commits)')")} AS lines_out
  FROM docs d LEFT JOIN g ON g.run_id = d.run_id""")
def c19(spark, sf):
    log = frames.doc_lines_text(spark, sf, lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("commit "), F.md5(x)))
                                .when(i % 4 == 1, "Author: a").when(i % 4 == 2, "").otherwise(F.concat(F.lit("    "), x)))
    return _out(log, R.git_log_top(_t()))


@query("b3_decode_text", f"""WITH {sql.NOISY}, r AS (SELECT run_id, regexp_replace(text, '[^\\n]*\\r', '', 'g') AS text FROM docs)
  SELECT run_id, text, {sql.nlines('text')} AS lines FROM r""")
def b3(spark, sf):
    raw = frames.noisy_runs(spark, sf).select("run_id", F.encode("text", "UTF-8").alias("raw"))
    out = raw.select("run_id", decode_text(F.col("raw")).alias("text"))
    return out.select("run_id", "text", F.size(lines_of(F.col("text"))).alias("lines"))
