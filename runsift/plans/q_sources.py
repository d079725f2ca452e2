"""Queries over sources and sinks. Inputs are tables rendered to the source format
and read back by the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsift.functions.tokens import estimate_tokens
from runsift.operators import reduce as R
from runsift.plans import frames, sql
from runsift.plans.q_reduce import _head_tail_sql
from runsift.plans.registry import query
from runsift.sources import ledger_store as S
from runsift.sources import reports, rules, transcripts


_LEDGER_ROWS = f"""WITH {sql.LEDGER} SELECT id, command, CASE WHEN id % 2 = 0 THEN 'utf8_weighted_v1' ELSE estimator END AS estimator, 1 AS schema_version, CAST(ts AS DATE) AS day FROM ledger"""


def ledger_folder(spark, sf):
    """A ledger of two batches, the first by an older schema; the second is appended twice, as a retry would."""
    led = frames.ledger(spark, sf)
    path = frames.shared_path(spark, "ledger")
    S.append_ledger(led.where("id % 2 = 0").select("id", "ts", "command", "raw_tokens"), path, "first")
    new = led.where("id % 2 = 1").select("id", "ts", "command", "raw_tokens", "estimator").withColumn("schema_version", F.lit(1))
    for _ in range(2):
        S.append_ledger(new, path, rows_per_file=50)
    return path


@query("a1_read_ledger", _LEDGER_ROWS)
def a1(spark, sf):
    return S.read_ledger(spark, ledger_folder(spark, sf)).select("id", "command", "estimator", "schema_version", "day")


@query("a2_append_ledger", f"WITH {sql.LEDGER} SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens FROM ledger GROUP BY 1")
def a2a(spark, sf):
    return S.read_ledger(spark, ledger_folder(spark, sf)).groupBy("day").agg(F.count("*").alias("rows"), F.sum("raw_tokens").alias("raw_tokens"))


_EVJ = """j AS (SELECT event_id, user_id, ts, event_type, value, event_type = 'error' AS bad FROM events)"""


def command_objects(spark, sf):
    """One whole-file transcript per event: a command list with one or two entries."""
    e = frames.table(spark, sf, "events")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.struct(F.concat(F.lit("make t"), F.col("user_id") % 7).alias("command"), (F.col("event_id") % 3).alias("exitCode"),
                   F.col("event_type").alias("output"), ts.alias("timestamp"))
    two = F.struct(F.lit("echo --token=abc").alias("cmd"), F.lit(0).alias("exit_code"), F.lit("x").alias("result"), (F.col("event_id") % 2 == 0).alias("filtered"))
    doc = F.to_json(F.struct(F.concat(F.lit("s"), F.col("user_id")).alias("sessionId"), F.lit("/w").alias("workspace")))
    body = F.concat(F.regexp_replace(doc, r"\}$", ""), F.lit(',"commands":['), F.to_json(one), F.lit(","), F.to_json(two), F.lit("]}"))
    return e.select(F.concat(F.lit("f"), F.col("event_id")).alias("session_id"), body.alias("text"), "event_id")


_LISTED = """SELECT 's' || user_id AS session_id, CAST(k AS BIGINT) AS seq, CASE WHEN k = 0 THEN 'make t' || (user_id % 7) ELSE 'echo --token=[REDACTED_SECRET]' END AS command,
  CASE WHEN k = 0 THEN CAST(event_id % 3 AS INTEGER) ELSE 0 END AS exit_code, CASE WHEN k = 0 THEN event_type ELSE 'x' END AS output,
  k = 1 AND event_id % 2 = 0 AS filtered, '/w' AS workspace FROM events, (SELECT unnest([0, 1]) AS k)"""


@query("a5_read_transcripts_json", _LISTED)
def a5(spark, sf):
    return transcripts.read_transcripts_json(command_objects(spark, sf)).select("session_id", "seq", "command", "exit_code", "output", "filtered", "workspace")


@query("a6_read_transcripts_steps", _LISTED.replace("'s' || user_id", "'c' || user_id"))
def a6(spark, sf):
    files = command_objects(spark, sf).withColumn("text", F.regexp_replace(F.regexp_replace("text", '"sessionId":"s', '"cascadeId":"c'), '"commands"', '"steps"'))
    return transcripts.read_transcripts_steps(files).select("session_id", "seq", "command", "exit_code", "output", "filtered", "workspace")


@query("a4_read_transcripts_jsonl", """SELECT 'f' || event_id AS session_id, CASE WHEN k = 0 THEN 'make t' || (user_id % 7) ELSE 'ls ' || (user_id % 5) END AS command,
  CASE WHEN k = 0 THEN CAST(event_id % 3 AS INTEGER) ELSE CAST(event_id % 2 AS INTEGER) END AS exit_code, CASE WHEN k = 0 THEN event_type ELSE 'out ' || event_type END AS output,
  CASE WHEN k = 0 THEN 0 ELSE 5000 END AS duration_ms, CASE WHEN k = 0 THEN 0 ELSE 196609 END AS seq FROM events, (SELECT unnest([0, 1]) AS k)""")
def a4(spark, sf):
    e = frames.table(spark, sf, "events")
    flat = F.to_json(F.struct(F.concat(F.lit("make t"), F.col("user_id") % 7).alias("command"), (F.col("event_id") % 3).alias("exitCode"), F.col("event_type").alias("output")))
    call = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("tool_use").alias("type"), F.lit("c1").alias("id"), F.lit("Bash").alias("name"),
                              F.struct(F.concat(F.lit("ls "), F.col("user_id") % 5).alias("command")).alias("input")))
    item = F.struct(F.lit("tool_result").alias("type"), F.lit("c1").alias("tool_use_id"), (F.col("event_id") % 2 == 1).alias("is_error"),
                    F.concat(F.lit("out "), "event_type").alias("content"))
    res = F.to_json(F.struct(F.lit("2024-01-01T00:00:05Z").alias("timestamp"), F.struct(F.array(item, item).alias("content")).alias("message")))
    # the second copy of the result is unanswered: a call answers once
    text = F.concat_ws("\n", flat, F.lit("{broken"), call, F.regexp_replace(res, r'\[\{"type":"tool_result"', '[{"type":"text"},{"type":"tool_result"'))
    files = e.select(F.concat(F.lit("f"), F.col("event_id")).alias("session_id"), text.alias("text"))
    return transcripts.read_transcripts_jsonl(files).select("session_id", "command", "exit_code", "output", "duration_ms", "seq")


# --- transcripts from files ---

_SESSION = "CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE concat('s', user_id % 50) END"
_BY_FOLDER = r"/session=([^/]+)/"


def transcript_folder(spark, sf):
    """A transcript file for each session, a line an event; every tenth line is no JSON, and every seventh has no command."""
    e = frames.table(spark, sf, "events")
    line = F.to_json(F.struct(F.concat(F.lit("make t"), F.col("user_id") % 7).alias("command"), (F.col("event_id") % 3).alias("exitCode"), F.col("event_type").alias("output")))
    line = F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"note":'), "event_id", F.lit("}"))).otherwise(line)
    path = frames.shared_path(spark, "transcripts")
    rows = e.select(F.expr(_SESSION).alias("session"), "event_id", line.alias("value")).repartition("session").sortWithinPartitions("session", "event_id")
    rows.select("session", "value").write.partitionBy("session").text(path)
    return path


def _folder_session(path):
    return F.regexp_extract(path, _BY_FOLDER, 1)


_TRANSCRIPTS = f"""l AS (SELECT {_SESSION} AS session_id, event_id, user_id, event_type, row_number() OVER (PARTITION BY {_SESSION} ORDER BY event_id) AS n,
  CASE WHEN event_id % 10 = 0 THEN '{{broken' WHEN event_id % 7 = 0 THEN '{{"note":' || event_id || '}}'
    ELSE '{{"command":"make t' || (user_id % 7) || '","exitCode":' || (event_id % 3) || ',"output":"' || event_type || '"}}' END AS line FROM events)"""


@query("a4_read_transcript_files", f"""WITH {_TRANSCRIPTS} SELECT session_id, (n - 1) * 65536 AS seq, 'evt-' || n AS event_id, 'make t' || (user_id % 7) AS command, CAST(event_id % 3 AS INTEGER) AS exit_code, event_type AS output
  FROM l WHERE event_id % 10 <> 0 AND event_id % 7 <> 0""")
def a4f(spark, sf):
    lines = transcripts.transcript_lines(spark, transcript_folder(spark, sf), "*.txt", session=_folder_session)
    return transcripts.read_transcripts_jsonl(lines).select("session_id", "seq", "event_id", "command", "exit_code", "output")


@query("a7_transcript_lines", f"WITH {_TRANSCRIPTS} SELECT session_id, n - 1 AS line_no, md5(line) AS line_md5 FROM l")
def a7(spark, sf):
    # the time of writing is later than any date in the tables, so the age keeps all of them
    lines = transcripts.transcript_lines(spark, transcript_folder(spark, sf), "*.txt", frames.AS_OF, transcripts.MAX_AGE_DAYS, session=_folder_session)
    return lines.select("session_id", "line_no", F.md5("line").alias("line_md5"))


@query("a7_transcript_scope", f"WITH {_TRANSCRIPTS} SELECT session_id, sum(strlen(line) + 1)::BIGINT AS bytes, md5(string_agg(line || chr(10), '' ORDER BY n)) AS text_md5 FROM l GROUP BY session_id")
def a7s(spark, sf):
    path = transcript_folder(spark, sf)
    texts = transcripts.transcript_scope(spark, path, "*.txt", frames.AS_OF, max_files=10_000, session=_folder_session)
    sizes = transcripts.transcript_files(spark, path, "*.txt").select("path", "bytes")
    return texts.join(sizes, "path").select("session_id", "bytes", F.md5("text").alias("text_md5"))


def failure_report_folder(spark, sf):
    """A JSON file of each user's failure reports; some have no category, and the files of every fiftieth user are broken."""
    e = frames.table(spark, sf, "events")
    report = F.struct(F.lit(1).alias("schema_version"), F.col("event_id").cast("string").alias("report_id"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("error_category"),
                      (F.col("event_id") % 4).alias("exit_code"))
    path = frames.shared_path(spark, "failure-reports")
    lines = e.select((F.col("user_id") % 200).alias("owner"), "event_id", F.concat(F.to_json(report), F.lit(",")).alias("value"))
    ends = lines.select("owner").distinct()
    first = ends.select("owner", F.lit(-1).cast("bigint").alias("event_id"), F.lit("[").alias("value"))
    last = ends.select("owner", F.lit(2 ** 62).alias("event_id"), F.when(F.col("owner") % 50 == 0, "{").otherwise('{"schema_version":1,"error_category":"last"}]').alias("value"))
    rows = lines.unionByName(first).unionByName(last).repartition("owner").sortWithinPartitions("owner", "event_id")
    rows.select("owner", "value").write.partitionBy("owner").text(path)
    return path


@query("a8_failure_report_totals", """WITH u AS (SELECT *, user_id % 200 AS owner, user_id % 200 % 50 = 0 AS broken FROM events), o AS (SELECT count(DISTINCT owner) FILTER (NOT broken) AS good, count(DISTINCT owner) FILTER (broken) AS bad FROM u)
  SELECT count(*) FILTER (NOT broken AND event_id % 13 <> 0) + (SELECT good FROM o) AS reports, count(*) FILTER (NOT broken AND event_id % 13 = 0) + (SELECT bad FROM o) AS unparseable FROM u""")
def a8(spark, sf):
    return reports.report_totals(reports.read_failure_reports(spark, failure_report_folder(spark, sf), "*.txt"))


def trx_files(spark, sf):
    """One XML report for each distinct order line; the four columns together name the run."""
    li = frames.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    k = F.col("l_suppkey") % 4
    case = lambda n: F.concat(F.lit('<UnitTestResult testName="A.B.T'), k + n, F.lit('" outcome="'), F.when((k + n) % 2 == 0, "Failed").otherwise("Passed"),
                              F.lit('" duration="00:00:01.5000000"><Output><ErrorInfo><Message> m'), F.col("l_suppkey"), F.lit(" </Message><StackTrace>at x</StackTrace></ErrorInfo></Output></UnitTestResult>"))
    body = F.concat(F.when(F.col("l_partkey") % 10 == 0, "<!DOCTYPE x>").otherwise(""), F.lit("<TestRun><ResultSummary><Counters total=\"2\" passed=\"1\" failed=\"1\" error=\"0\" notExecuted=\""), k,
                    F.lit('" inconclusive="0"/></ResultSummary><Results>'), case(0), case(1), F.lit("</Results></TestRun>"))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"), F.col("l_linenumber").alias("file_no"), body.alias("text"))


_LINES = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"
_LID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS run_id"


@query("a9_read_test_report_xml", f"""SELECT {_LID}, 0 AS seq, 'A.B.T' || t AS name, 'failed' AS status, 'Failed T' || t || ' m' || l_suppkey AS detail, 1500 AS duration_ms, 'at x' AS stack
  FROM (SELECT *, CASE WHEN (l_suppkey % 4) % 2 = 0 THEN l_suppkey % 4 ELSE l_suppkey % 4 + 1 END AS t FROM {_LINES} WHERE l_partkey % 10 <> 0)""")
def a9(spark, sf):
    return reports.read_test_report_xml(trx_files(spark, sf))


@query("a9_test_report_counters", f"""SELECT {_LID}, CASE WHEN r THEN 0 ELSE 1 END AS passed, CASE WHEN r THEN 0 ELSE 1 END AS failed, 0 AS errors, CAST(CASE WHEN r THEN 0 ELSE l_suppkey % 4 END AS INTEGER) AS skipped,
  CASE WHEN r THEN 0 ELSE 2 END AS total, CASE WHEN r THEN 1 ELSE 0 END AS refused FROM (SELECT *, l_partkey % 10 = 0 AS r FROM {_LINES})""")
def a9c(spark, sf):
    return reports.test_report_counters(trx_files(spark, sf))


# --- reports from files: a run has seven of them, each with the results of many order lines ---

def report_folder(spark, sf):
    li = frames.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    li = li.select((F.col("l_suppkey") % 20).alias("run"), F.col("l_linenumber").alias("file"), "l_orderkey", "l_partkey", "l_suppkey")
    name = F.format_string('testName="N.T%d_%d" outcome="%s" duration="00:00:0%d.250"', "l_orderkey", "l_partkey", F.when(F.col("l_partkey") % 2 == 0, "Failed").otherwise("Passed"), F.col("l_partkey") % 10)
    text = F.format_string("<Output><ErrorInfo>\n<Message>a &lt; b %d</Message><StackTrace><![CDATA[at <UnitTestResult x>]]></StackTrace></ErrorInfo></Output>", "l_suppkey")
    case = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("<UnitTestResult "), name, F.lit("/>"))).otherwise(F.concat(F.lit("<UnitTestResult "), name, F.lit(">"), text, F.lit("</UnitTestResult>")))
    rows = li.select("run", "file", F.lit(1).alias("part"), "l_orderkey", "l_partkey", "l_suppkey", case.alias("value"))
    ends = li.select("run", "file").distinct()
    no = [F.lit(0).cast("bigint").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    doctype = F.when((F.col("file") == 7) & (F.col("run") % 5 == 0), "<!DOCTYPE x>").otherwise("")
    head = ends.select("run", "file", F.lit(0).alias("part"), *no, F.concat(F.lit('<?xml version="1.0"?>'), doctype, F.lit("<TestRun><Results>")).alias("value"))
    foot = ends.select("run", "file", F.lit(2).alias("part"), *no, F.format_string('</Results><ResultSummary><Counters total="%d" passed="1" failed="2" notExecuted="3"></Counters></ResultSummary></TestRun>', "file").alias("value"))
    path = frames.shared_path(spark, "reports")
    every = rows.unionByName(head).unionByName(foot).repartition("run", "file").sortWithinPartitions("run", "file", "part", "l_orderkey", "l_partkey", "l_suppkey")
    every.select("run", "file", "value").write.partitionBy("run", "file").text(path)
    return path


def _report_run(path):
    return F.regexp_extract(path, r"/run=(\d+)/", 1).cast("bigint")


_REPORTS = "l AS (SELECT l_suppkey % 20 AS run_id, l_linenumber AS f, * FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))"


@query("a9_read_report_files", f"""WITH {_REPORTS} SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY f, l_orderkey, l_partkey, l_suppkey) - 1 AS INTEGER) AS seq, 'N.T' || l_orderkey || '_' || l_partkey AS name, 'failed' AS status,
  'Failed T' || l_orderkey || '_' || l_partkey || CASE WHEN l_partkey % 5 = 0 THEN '' ELSE ' a < b ' || l_suppkey END AS detail, CAST(l_partkey % 10 * 1000 + 250 AS INTEGER) AS duration_ms,
  CASE WHEN l_partkey % 5 <> 0 THEN 'at <UnitTestResult x>' END AS stack FROM l WHERE l_partkey % 2 = 0 AND NOT (f = 7 AND run_id % 5 = 0)""")
def a9f(spark, sf):
    return reports.read_report_results(reports.report_pieces(spark, report_folder(spark, sf), "*.txt", _report_run))


@query("a9_report_file_counters", f"""WITH {_REPORTS}, g AS (SELECT DISTINCT run_id, f, f = 7 AND run_id % 5 = 0 AS no FROM l)
  SELECT run_id, CAST(count(*) FILTER (NOT no) AS INTEGER) AS passed, CAST(2 * count(*) FILTER (NOT no) AS INTEGER) AS failed, 0 AS errors, CAST(3 * count(*) FILTER (NOT no) AS INTEGER) AS skipped,
    CAST(sum(f) FILTER (NOT no) AS INTEGER) AS total, count(*) FILTER (no) AS refused FROM g GROUP BY run_id""")
def a9fc(spark, sf):
    return reports.report_file_counters(reports.report_pieces(spark, report_folder(spark, sf), "*.txt", _report_run))


@query("a10_read_format_report", """SELECT event_id AS run_id, CAST(k AS INTEGER) AS seq, 'src/f' || (user_id % 9) || '.cs' AS file, CAST(k + 1 AS INTEGER) AS line, 'IDE' || k AS code, 'IDE' || k || ': fix ' || event_type AS message,
  'warning' AS severity FROM events, (SELECT unnest(range(205)) AS k) WHERE event_id % 100 = 0 AND k < 200
  UNION ALL SELECT event_id, CAST(k AS INTEGER), 'src/f' || (user_id % 9) || '.cs', CAST(k + 1 AS INTEGER), 'IDE' || k, 'IDE' || k || ': fix ' || event_type, 'warning' FROM events, (SELECT unnest(range(2)) AS k) WHERE event_id % 100 <> 0""")
def a10(spark, sf):
    e = frames.table(spark, sf, "events")
    n = F.when(F.col("event_id") % 100 == 0, 205).otherwise(2)
    changes = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((k + 1).alias("LineNumber"), F.concat(F.lit("IDE"), k.cast("string")).alias("DiagnosticId"),
                                                                         F.concat(F.lit("fix "), F.col("event_type")).alias("FormatDescription")))
    text = F.to_json(F.array(F.struct(F.concat(F.lit("src/f"), F.col("user_id") % 9, F.lit(".cs")).alias("FilePath"), changes.alias("FileChanges"))))
    # the SQL tells the limited form
    return reports.read_format_report(e.select(F.col("event_id").alias("run_id"), text.alias("text")), reports.Limits(format_findings=200))


@query("a11_load_rules", f"""WITH {sql.rule_values()}, {sql.LEDGER}, p AS (SELECT rule, count(*) AS prefixes, max(len(string_split(prefix, ' '))) AS words FROM rules GROUP BY rule),
  u AS (SELECT rule, count(*) AS runs FROM (SELECT l.id, max_by(rule, length(prefix)) AS rule FROM ledger l JOIN rules ON command = prefix OR starts_with(command, prefix || ' ') GROUP BY l.id) GROUP BY rule)
  SELECT p.rule, prefixes, CAST(words AS INTEGER) AS words, coalesce(runs, 0) AS runs FROM p LEFT JOIN u ON u.rule = p.rule""")
def a11(spark, sf):
    from runsift.operators.prepare import match_rule
    table = rules.rules_frame(spark)
    used = match_rule(frames.ledger(spark, sf), table).groupBy("rule").agg(F.count("*").alias("runs"))
    per = table.groupBy("rule").agg(F.count("*").alias("prefixes"), F.max(F.size(F.split("prefix", " "))).alias("words"))
    return per.join(used, "rule", "left").select("rule", "prefixes", "words", F.coalesce("runs", F.lit(0).cast("bigint")).alias("runs"))


@query("a13_report_csv_rows", f"""WITH {sql.LEDGER}, s AS (SELECT command AS bucket, CAST(sum(raw_tokens) AS BIGINT) AS raw, CAST(sum(out_tokens) AS BIGINT) AS o, count(*) AS commands FROM ledger GROUP BY 1)
  SELECT bucket, commands, raw, o AS "out", raw - o AS saved, 'gpt-4o-2024-11-20' AS model, printf('%.6f', floor(raw * (2.5::DOUBLE / 1000000::DOUBLE) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE) AS usd_raw,
   printf('%.6f', floor(o * (2.5::DOUBLE / 1000000::DOUBLE) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE) AS usd_filtered,
   printf('%.6f', floor(greatest(0, raw - o) * (2.5::DOUBLE / 1000000::DOUBLE) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE) AS usd_saved FROM s""")
def a13(spark, sf):
    from runsift.operators.ledger import cost_by
    from runsift.sources.pricing import models_frame
    return S.report_columns(cost_by(frames.ledger(spark, sf), models_frame(spark), "gpt-4o-2024-11-20", "command"))


@query("a13_report_csv_file", f"""WITH {sql.LEDGER} SELECT command || ', "' || project || '"' || chr(10) AS bucket, count(*) AS commands, CAST(sum(raw_tokens) AS BIGINT) AS raw, printf('%.6f', CAST(sum(raw_tokens) AS DOUBLE)) AS usd_raw FROM ledger GROUP BY 1""")
def a13f(spark, sf):
    led = frames.ledger(spark, sf).withColumn("bucket", F.format_string('%s, "%s"\n', "command", "project"))
    df = led.groupBy("bucket").agg(F.count("*").alias("commands"), F.sum("raw_tokens").alias("raw"), F.sum("raw_tokens").cast("double").alias("usd_raw"))
    path = frames.shared_path(spark, "report")
    S.write_report_csv(df, path)
    return S.read_report_csv(spark, path, "bucket string, commands bigint, raw bigint, usd_raw string")


@query("a14_documents_json", """SELECT doc_id AS run_id, '{"schema_version":1,"kind":"opaque","command":"' || source || '","filter":null,"exit_code":0,"was_filtered":true,"document":{"body":"' || lang || '"}}' AS value FROM documents""")
def a14(spark, sf):
    d = frames.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.col("source").alias("command"), F.lit(None).cast("string").alias("rule"),
                                                    F.lit(0).alias("exit_code"), F.lit(True).alias("was_filtered"), "lang")
    return S.documents_json(d, F.lit("opaque"), F.struct(F.col("lang").alias("body")))


@query("a14_documents_json_file", """SELECT 1 AS schema_version, 'opaque' AS kind, source AS command, CAST(NULL AS VARCHAR) AS "filter", CAST(doc_id % 3 AS INTEGER) AS exit_code, doc_id % 2 = 0 AS was_filtered, '{"id":' || doc_id || ',"body":"' || lang || '"}' AS document FROM documents""")
def a14f(spark, sf):
    d = frames.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.col("source").alias("command"), F.lit(None).cast("string").alias("rule"),
                                                    (F.col("doc_id") % 3).cast("int").alias("exit_code"), (F.col("doc_id") % 2 == 0).alias("was_filtered"), "lang")
    path = frames.shared_path(spark, "documents-json")
    S.write_documents_json(d, F.lit("opaque"), F.struct(F.col("run_id").alias("id"), F.col("lang").alias("body")), path)
    return S.read_documents_json(spark, path)


@query("a12_load_pricing", """SELECT 'm' || p_partkey AS id, 'a' || (p_partkey % 7) || ',b' || p_partkey AS aliases, p_brand AS provider, round(p_retailprice / 100, 4) AS input_cost_per_million, '2024-01-01' AS effective_date FROM part""")
def a12(spark, sf):
    from runsift.sources.pricing import load_pricing
    p = frames.table(spark, sf, "part")
    model = F.struct(F.concat(F.lit("m"), "p_partkey").alias("id"), F.array(F.concat(F.lit("a"), F.col("p_partkey") % 7), F.concat(F.lit("b"), "p_partkey")).alias("aliases"), F.col("p_name").alias("name"),
                     F.col("p_brand").alias("provider"), F.round(F.col("p_retailprice") / 100, 4).alias("input_cost_per_million"), F.lit("2024-01-01").alias("effective_date"))
    docs = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.collect_list(model).alias("models"))  # a price list has 1,000 models at most
    path = frames.shared_path(spark, "pricing")
    docs.select(F.to_json(F.struct("models")).alias("value")).write.text(path)
    return load_pricing(spark, path, whole_file=False).select("id", F.array_join("aliases", ",").alias("aliases"), "provider", "input_cost_per_million", "effective_date")


@query("a15_retain_raw", f"""WITH {sql.DOC_RUNS}, c AS (SELECT run_id, exit_code, stdout, {_head_tail_sql(4, 6, 'stdout')} AS o FROM doc_runs),
  t AS (SELECT *, {sql.tokens('stdout')} AS rt, {sql.tokens('o')} AS ot FROM c)
  SELECT run_id FROM t WHERE exit_code <> 0 OR run_id % 50 = 0 OR (run_id % 2 = 0 AND (o <> stdout OR (rt > 0 AND ot * 2 <= rt) OR (length(stdout) >= 200 AND length(o) * 2 <= length(stdout)))) OR run_id % 40 = 1""")
def a15(spark, sf):
    runs = frames.doc_runs(spark, sf)
    out = runs.select("run_id", "exit_code", "stdout", F.lit("").alias("stderr"), F.when(F.col("run_id") % 50 == 0, "OUTPUT_CAP").otherwise("CHILD_EXIT").alias("termination"),
                      R.head_tail(F.col("stdout"), 4, 6).alias("text_out"), (F.col("run_id") % 2 == 0).alias("was_filtered"),
                      F.when(F.col("run_id") % 40 == 1, "apply_fallback").alias("incident"))
    out = out.withColumn("raw_tokens", estimate_tokens(F.col("stdout"))).withColumn("out_tokens", estimate_tokens(F.col("text_out")))
    return S.retain_raw(out).select("run_id")


@query("a16_expand_raw", f"""WITH {sql.DOCS}, l AS (SELECT run_id, {sql.lines("repeat(text || chr(10), 3)")} AS ls FROM docs), x AS (SELECT run_id, unnest(ls[3:102]) AS line, generate_subscripts(ls[3:102], 1) AS no FROM l),
  b AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY run_id ORDER BY no) AS used FROM x), f AS (SELECT run_id, min(no) FILTER (used > 32768) AS stop FROM b GROUP BY 1),
  g AS (SELECT b.run_id, string_agg(line || chr(10), '' ORDER BY no) AS content, count(*) AS n FROM b JOIN f ON f.run_id = b.run_id WHERE stop IS NULL OR no < stop GROUP BY 1)
  SELECT l.run_id, coalesce(content, '') AS content, 3 AS start_line, CAST(coalesce(n, 0) + 2 AS INTEGER) AS end_line, CAST(len(ls) AS INTEGER) AS total_lines, CAST(coalesce(n, 0) AS INTEGER) AS returned,
    f.stop IS NOT NULL AS truncated FROM l LEFT JOIN g ON g.run_id = l.run_id LEFT JOIN f ON f.run_id = l.run_id""")
def a16(spark, sf):
    d = frames.docs(spark, sf).withColumn("text", F.repeat(F.concat("text", F.lit("\n")), 3))
    return S.expand_raw(d, 3)


@query("a17_apply_retention", f"WITH {sql.LEDGER} SELECT count(*) AS rows, min(ts) AS oldest FROM ledger WHERE ts >= TIMESTAMP '2024-04-09 00:00:00' - INTERVAL 90 DAY")
def a17(spark, sf):
    return S.apply_retention(S.by_day(frames.ledger(spark, sf)), "2024-04-09 00:00:00").agg(F.count("*").alias("rows"), F.min("ts").alias("oldest"))
