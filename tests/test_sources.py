import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from runsift.operators import source_code as I
from runsift.sources import ledger_store as S
from runsift.sources import pricing, reports, transcripts


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "session_id string, text string")


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(dt.datetime(2024, 1, d, 3), "git status", "p", "/w", 10, 5, 1) for d in (1, 1, 2)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, command string, project string, cwd string, raw_tokens bigint, out_tokens bigint, exec_ms bigint")
    S.append_ledger(df, path)
    S.append_ledger(df.withColumn("estimator", F.lit("legacy")), path)
    assert sorted(p for p in os.listdir(path) if p.startswith("day=")) == ["day=2024-01-01", "day=2024-01-02"]
    back = S.read_ledger(spark, path)
    assert {(r.estimator, r["count"]) for r in back.groupBy("estimator").count().collect()} == {("utf8_weighted_v1", 3), ("legacy", 3)}
    kept = S.apply_retention(back, "2024-03-31 12:00:00")
    assert kept.count() == 2 and "day" in kept._jdf.queryExecution().executedPlan().toString()


def test_drop_expired_partitions(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS runsift_old (id INT, day STRING) USING parquet PARTITIONED BY (day)")
    try:
        spark.sql("INSERT INTO runsift_old VALUES (1, '2024-01-01'), (2, '2024-06-01')")
        assert S.drop_expired(spark, "runsift_old", "2024-06-10 00:00:00") == ["2024-01-01"]
        assert [r.id for r in spark.table("runsift_old").collect()] == [2]
    finally:
        spark.sql("DROP TABLE runsift_old")


def test_csv_quotes(spark, tmp_path):
    path = str(tmp_path / "csv")
    S.write_report_csv(spark.createDataFrame([('say "hi", x', 1.5)], "command string, usd_saved double"), path)
    text = "".join((tmp_path / "csv" / f).read_text() for f in os.listdir(path) if f.endswith(".csv"))
    assert text == 'command,usd_saved\n"say ""hi"", x",1.500000\n'


def test_csv_has_one_header(spark, tmp_path):
    """Many writers, none with rows, or no rows at all: one header, rows in order, values come back."""
    path = str(tmp_path / "csv")
    rows = [(f"c{i:05d} , \"x\"\n y ", i, None if i % 3 else i / 7) for i in range(5000)] + [(None, 1, 0.0)]
    df = spark.createDataFrame(rows, "command string, n bigint, usd_saved double").repartition(9)
    S.write_report_csv(df, path)
    parts = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    text = "".join((tmp_path / "csv" / f).read_text() for f in parts)
    assert text.count("command,n,usd_saved") == 1 and text.startswith("command,n,usd_saved\n") and text.index("c00001") < text.index("c04999")
    back = S.read_report_csv(spark, path, "command string, n bigint, usd_saved string")
    assert sorted(map(str, back.collect())) == sorted(map(str, S.report_columns(df).collect()))
    S.write_report_csv(df.where("n < 0"), path)
    assert "".join((tmp_path / "csv" / f).read_text() for f in os.listdir(path) if f.endswith(".csv")) == "command,n,usd_saved\n"
    assert S.read_report_csv(spark, path, "command string, n bigint, usd_saved string").count() == 0


def test_append_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(dt.datetime(2024, 1, 1 + i % 3, 3), f"c{i}", i) for i in range(3000)] + [(None, "no time", 1)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, command string, raw_tokens bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small partitions are joined to one file
    try:
        for _ in range(2):
            S.append_ledger(df, path, rows_per_file=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "day=2024-01-01" in d]
    assert S.read_ledger(spark, path).count() == 3001 and 2 < len(files) <= 10
    S.append_ledger(df.where("raw_tokens < 10"), path, "named")
    S.append_ledger(df.where("raw_tokens < 5"), path, "named")  # a batch that is sent again with other rows replaces those days
    assert S.read_ledger(spark, path).count() == 3001 + 5 + 1
    S.append_ledger(df.limit(0), path)
    assert S.read_ledger(spark, path).count() == 3007


def test_documents_strict(spark, tmp_path):
    ok, bad = tmp_path / "ok", tmp_path / "bad"
    doc = {"schema_version": 1, "kind": "opaque", "command": "x", "filter": None, "exit_code": 0, "was_filtered": True, "document": {"body": "b"}}
    ok.mkdir(), bad.mkdir()
    (ok / "a.json").write_text(json.dumps(doc))
    assert S.read_documents_json(spark, str(ok)).first().kind == "opaque"
    for change in ({"zzz": 1}, {"schema_version": 2}):
        (bad / "a.json").write_text(json.dumps({**doc, **change}))
        with pytest.raises(Exception, match="unknown keys|unsupported"):
            S.read_documents_json(spark, str(bad)).collect()


def test_keep_raw_modes(spark):
    df = spark.createDataFrame([(1, 1, "", "o", "", True, 10, 9, None), (2, 0, "", "x" * 300, "y", True, 10, 9, None), (3, 0, "", "o", "o", True, 10, 9, None),
                                (4, 0, "", "o", "... (3 lines omitted: x) ...", True, 10, 9, None), (5, 0, "OUTPUT_CAP", "o", "o", True, 10, 9, None)],
                               "run_id int, exit_code int, termination string, stdout string, text_out string, was_filtered boolean, raw_tokens int, out_tokens int, incident string")
    df = df.withColumn("stderr", F.lit(""))
    ids = lambda mode: {r.run_id for r in S.retain_raw(df, mode).collect()}
    assert ids("omissions") == {1, 2, 4, 5} and ids("failures") == {1} and ids("never") == set() and len(ids("always")) == 5


def test_expand_stops_at_bytes(spark):
    df = spark.createDataFrame([(1, "\n".join(["x" * 20_000] * 3))], "run_id int, text string")
    r = S.expand_raw(df).first()
    assert (r.returned, r.truncated, r.total_lines, r.end_line) == (1, True, 3, 1)


def test_jsonl_transcript(spark):
    text = "\n".join([
        '{"timestamp":"2024-01-01T00:00:00Z","command":"ls","exitCode":2,"output":"x"}', "{broken", "",
        '{"timestamp":"2024-01-01T00:00:01Z","message":{"content":[{"type":"tool_use","id":"c","name":"Bash","input":{"command":"make --password=pw"}}]}}',
        '{"timestamp":"2024-01-01T00:00:03Z","type":"tool_result","tool_use_id":"c","content":"[reduced] ok","is_error":true,"exit_code":5}',
        '{"type":"tool_result","tool_use_id":"c","content":"again"}'])
    got = [(r.command, r.exit_code, r.duration_ms, r.filtered) for r in transcripts.read_transcripts_jsonl(files(spark, text)).orderBy("seq").collect()]
    assert got == [("ls", 2, 0, False), ("make --password=[REDACTED_SECRET]", 5, 2000, True)]


def test_object_array_and_line_transcripts(spark):
    texts = ['{"sessionId":"S","commands":[{"command":"a","exitCode":"1"},{"cmd":""},{"terminalCommand":"b","result":"r"}]}', '[{"command":"c"}]',
             '{"command":"d"}\nbroken\n{"cmd":"e"}', "{nonsense"]
    got = {(r.session_id, r.seq, r.command, r.exit_code, r.output) for r in transcripts.read_transcripts_json(files(spark, *texts)).collect()}
    assert got == {("S", 0, "a", 1, ""), ("S", 2, "b", 0, "r"), ("f1", 0, "c", 0, ""), ("f2", 0, "d", 0, ""), ("f2", 2, "e", 0, "")}


def test_transcript_scope(spark, tmp_path):
    now = dt.datetime(2024, 6, 1).timestamp()
    for name, age in (("new.jsonl", 1), ("mid.jsonl", 2), ("old.jsonl", 40), ("skip.txt", 1)):
        p = tmp_path / name
        p.write_text(name * 10)
        os.utime(p, (now - age * 86400,) * 2)
    got = transcripts.transcript_scope(spark, str(tmp_path), "*.jsonl", "2024-06-01 00:00:00", 30, 1, 5).collect()
    assert [(r.session_id, r.text) for r in got] == [("new", "new.j")]


def aged(tmp_path, name, age, data):
    now = dt.datetime(2024, 6, 1).timestamp()
    p = tmp_path / name
    p.write_bytes(data)
    os.utime(p, (now - age * 86400,) * 2)


def test_large_transcript_is_read_by_many_tasks(spark, tmp_path):
    """A file far over 10 MiB, in several blocks: no line is lost or cut and the numbers are those of the file."""
    body = [json.dumps({"command": f"make {i}", "output": "x" * (i % 300)}) + ("\r\n" if i % 5 else "\n") for i in range(90_000)]
    body[70_000] = json.dumps({"command": "one long line", "output": "y" * 3_000_000}) + "\n"
    aged(tmp_path, "big [1].jsonl", 1, "".join(body).encode())
    aged(tmp_path, "small.jsonl", 1, b'{"command":"ls"}\n\n{"command":"\xff"}')
    aged(tmp_path, "none.jsonl", 1, b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        lines = transcripts.transcript_lines(spark, str(tmp_path), "*.jsonl")
        parts = lines.where("session_id LIKE 'big%'").select(F.spark_partition_id()).distinct().count()
        got = transcripts.read_transcripts_jsonl(lines)
        rows = {(r.session_id, r.event_id): (r.command, r.output_bytes) for r in got.select("session_id", "event_id", "command", "output_bytes").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 5
    assert len(rows) == 90_002
    big = next(s for s, _ in rows if s.startswith("big"))
    assert all(rows[big, f"evt-{i + 1}"] == (f"make {i}", i % 300) for i in range(90_000) if i != 70_000)
    assert rows[big, "evt-70001"] == ("one long line", 3_000_000)
    assert rows["small", "evt-1"] == ("ls", 0) and rows["small", "evt-3"][0] == "\ufffd"


@pytest.mark.parametrize("choice", [{"max_age_days": 30}, {"max_files": 2}])
def test_other_files_are_not_opened(spark, tmp_path, choice):
    """An old file that no reader can open does no harm while it is not chosen."""
    aged(tmp_path, "a.jsonl", 1, b'{"command":"a"}\n')
    aged(tmp_path, "b.jsonl", 2, b'{"command":"b"}\n')
    aged(tmp_path, "old.jsonl.gz", 40, b"no gzip file")
    aged(tmp_path, "c.txt", 1, b"not asked for")
    when = "2024-06-01 00:00:00"
    lines = transcripts.transcript_lines(spark, str(tmp_path), "*.jsonl*", when, **choice)
    assert sorted((r.session_id, r.line_no, r.line) for r in lines.collect()) == [("a", 0, '{"command":"a"}'), ("b", 0, '{"command":"b"}')]
    texts = transcripts.transcript_scope(spark, str(tmp_path), "*.jsonl*", when, **choice)
    assert sorted(r.session_id for r in texts.collect()) == ["a", "b"]
    assert sorted(r.session_id for r in transcripts.transcript_files(spark, str(tmp_path), "*.jsonl*", when, **choice).collect()) == ["a", "b"]
    with pytest.raises(Exception):
        transcripts.transcript_lines(spark, str(tmp_path), "*.jsonl*").collect()


def test_transcripts_of_no_file(spark, tmp_path):
    aged(tmp_path, "a.jsonl", 9, b"{}")
    assert transcripts.transcript_lines(spark, str(tmp_path), "*.jsonl", "2024-06-01 00:00:00", 2, 5).count() == 0
    assert transcripts.transcript_lines(spark, str(tmp_path), "*.jsonl", "2024-06-01 00:00:00", 2).count() == 0


def test_failure_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"error_category":"X","exit_code":3}')
    (tmp_path / "b.json").write_text('{"exit_code":3}')
    (tmp_path / "c.json").write_text("{bad")
    r = reports.report_totals(reports.read_failure_reports(spark, str(tmp_path))).first()
    assert (r.reports, r.unparseable) == (1, 2)


def test_trx(spark):
    ok = ('<TestRun xmlns="http://x"><ResultSummary><Counters total="3" passed="2" failed="1" error="0" notExecuted="0" inconclusive="0"/></ResultSummary><Results>'
          '<UnitTestResult testName="N.A" outcome="Passed"/><UnitTestResult testName="N.B" outcome="Failed" duration="00:01:00.25"><Output><ErrorInfo>'
          "<Message> boom </Message></ErrorInfo></Output></UnitTestResult></Results></TestRun>")
    df = spark.createDataFrame([(1, 1, ok), (1, 2, "<!DOCTYPE x>" + ok)], "run_id int, file_no int, text string")
    r = reports.read_test_report_xml(df).collect()
    assert [(x.name, x.detail, x.duration_ms) for x in r] == [("N.B", "Failed B boom", 60250)]
    c = reports.test_report_counters(df).first()
    assert (c.passed, c.failed, c.total, c.refused) == (2, 1, 3, 1)


def test_reports_are_read_whole(spark):
    stack = "at x\n" * 3000
    case = lambda n: f'<UnitTestResult testName="N.T{n}" outcome="Failed"><Output><ErrorInfo><Message>m</Message><StackTrace>{stack if n == 0 else "s"}</StackTrace></ErrorInfo></Output></UnitTestResult>'
    one = "".join(case(n) for n in range(60))
    trx = '<TestRun><ResultSummary><Counters total="60" passed="0" failed="60" error="0" notExecuted="0" inconclusive="0"/></ResultSummary><Results>' + one + "</Results></TestRun>"
    quoted = trx.replace("<Message>m<", "<Message><![CDATA[<!DOCTYPE html>]]><", 1)
    late = "<!--" + "x" * 9000 + "--><!DOCTYPE x>" + trx
    df = spark.createDataFrame([(1, n, quoted if n == 12 else trx) for n in range(1, 13)] + [(1, 13, late)], "run_id int, file_no int, text string")
    rows = reports.read_test_report_xml(df).orderBy("seq").collect()
    assert len(rows) == 720 and rows[719].name == "N.T59" and len(rows[0].stack) > 8192
    c = reports.test_report_counters(df).first()
    assert (c.failed, c.total, c.refused) == (720, 720, 1)
    few = reports.Limits(files=2, results=50, failures=70, stack=10)
    assert len(back := reports.read_test_report_xml(df, few).collect()) == 70 and max(len(r.stack) for r in back) == 10
    changes = [{"LineNumber": n, "DiagnosticId": f"IDE{n}", "FormatDescription": "d" * 3000} for n in range(500)]
    text = json.dumps([{"FilePath": "a.cs", "FileChanges": changes}])
    df = spark.createDataFrame([(1, text)], "run_id int, text string")
    assert len(text) > 1 << 20 and reports.read_format_report(df).count() == 500
    assert reports.read_format_report(df, reports.Limits(format_findings=200)).count() == 200


def test_reports_from_files(spark, tmp_path):
    """Several files of a run, one far larger than a block; closed, nested and broken results, character data that looks like tags."""
    (tmp_path / "7").mkdir(), (tmp_path / "8").mkdir()
    case = lambda n, more="": f'<UnitTestResult testName="N.T{n}" outcome="Failed"\n duration="00:00:01">\n<Output><ErrorInfo><Message>m{n} &amp; é</Message><StackTrace>{more or "s"}</StackTrace></ErrorInfo></Output></UnitTestResult>\n'
    start, end = '\ufeff<?xml version="1.0"?><!-- <!DOCTYPE no> -->\n<TestRun xmlns="http://x"><Results>', '</Results><ResultSummary><Counters total="9" passed="4" failed="x" error="5"/></ResultSummary></TestRun>'
    (tmp_path / "7" / "a.trx").write_text(start + "".join(case(n, "at y\n" * 200) for n in range(8000)) + end)
    odd = ['<UnitTestResult testName="shut" outcome="failed"/>', '<UnitTestResult testName="ok > no" outcome="Passed"/>',
           '<UnitTestResult testName="out" outcome="Failed"><InnerResults>' + case("in1") + case("in2") + "</InnerResults></UnitTestResult>",
           case("data", "<![CDATA[<UnitTestResult testName='x'> <!DOCTYPE y>]]>"), '<UnitTestResult testName=" " outcome="Error"></UnitTestResult>',
           "<!-- <UnitTestResult testName='c' outcome='Failed'/> -->", '<UnitTestResult testName="broken" outcome="Error"><Output>']
    (tmp_path / "7" / "b.trx").write_text(start + "".join(odd))
    (tmp_path / "8" / "c.trx").write_text("<!DOCTYPE x>" + start + case(1) + end)
    (tmp_path / "8" / "d.trx").write_text(start + end)
    (tmp_path / "8" / "e.txt").write_text(start + case(1) + end)
    (tmp_path / "8" / "f.trx").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        pieces = reports.report_pieces(spark, str(tmp_path))
        assert pieces.where("path LIKE '%a.trx'").select(F.spark_partition_id()).distinct().count() > 3
        rows = reports.read_report_results(pieces).orderBy("run_id", "seq").collect()
        counters = {r.run_id: (r.passed, r.failed, r.errors, r.total, r.refused) for r in reports.report_file_counters(pieces).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in rows] == list(range(len(rows))) and {r.run_id for r in rows} == {"7"}
    assert [(r.name, r.detail, r.duration_ms) for r in rows[:8000]] == [(f"N.T{n}", f"Failed T{n} m{n} & é", 1000) for n in range(8000)]
    assert all(len(r.stack) > 900 for r in rows[:8000])
    assert [r.name for r in rows[8000:]] == ["shut", "N.Tin1", "N.Tin2", "N.Tdata", "broken"]
    assert rows[8003].stack == "<UnitTestResult testName='x'> <!DOCTYPE y>"
    assert counters == {"7": (4, 0, 5, 9, 0), "8": (4, 0, 5, 9, 1)}


def test_outcome_detail_is_whole(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "c", "p", "r", "k", "d" * 2000)], "ts timestamp_ntz, command string, project string, rule string, incident string, detail string")
    assert [len(r.detail) for r in S.outcome_rows(df).collect()] == [2000]
    assert [len(r.detail) for r in S.outcome_rows(df, 500).collect()] == [500]


def test_pricing(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"models": [{"id": "m", "aliases": ["a"], "name": "M", "provider": "P", "input_cost_per_million": 2.0, "effective_date": "2024-01-01"}]}))
    r = pricing.load_pricing(spark, str(p)).first()
    assert (r.id, r.aliases, r.input_cost_per_million) == ("m", ["a"], 2.0)


@pytest.mark.parametrize("path, text, want", [
    ("a.py", 'x = "#no" # yes\n"""doc # no"""\ny = r"\\" # z', ['x = "#no" ', '"""doc # no"""', 'y = r"\\" ']),
    ("a.java", 'String s = "/* no */"; /* a\nb */ int x; // t\nvar t = """\n// no\n""";', ['String s = "/* no */"; ', " int x; ", 'var t = """', "// no", '""";']),
    ("a.rs", 'let a = r#"// "no""#; // c\n/* a /* b */ c */ fn x() {}', ['let a = r#"// "no""#; ', " fn x() {}"]),
    ("a.kt", "/* a /* b\n*/ c */ fun x() {}\nval s = \"/*\"", [" fun x() {}", 'val s = "/*"']),
    ("a.sql", "SELECT 'it''s -- no' -- yes", ["SELECT 'it''s -- no' "]),
    ("a.cpp", 'auto s = R"x(// no )" )x"; // c', ['auto s = R"x(// no )" )x"; ']),
    ("a.js", "let t = `// no ${x}`; // c", ["let t = `// no ${x}`; "]),
    ("a.html", "<p><!-- a\nb --></p>", ["<p>", "</p>"]),
    ("Makefile", "a: # c\n\tb", ["a: ", "\tb"]),
    ("a.zzz", "# kept // kept", ["# kept // kept"]),
])
def test_comment_removal(spark, path, text, want):
    df = spark.createDataFrame([(path, text)], "path string, text string")
    assert [r.line for r in I.strip_comments(df).orderBy("line_no").collect()] == want


def test_long_string_needs_no_regex_stack(spark):
    df = spark.createDataFrame([("a.py", 'x = "' + 'a\\"' * 60_000 + '" # c')], "path string, text string")
    assert I.strip_comments(df).first().line.endswith('a\\"" ')


def test_outline_and_listing(spark):
    df = spark.createDataFrame([("a.py", "# c\nclass A:\n  x = 1\n  def f(self):\n    pass"), ("b.py", "x = 1"), ("c.py", "# only")], "path string, text string")
    got = {(r.path, r.level, r.line_no) for r in I.outline(df).collect()}
    assert got == {("a.py", "outline", 2), ("a.py", "outline", 4), ("b.py", "comments", 1)}
    body = {r.path: r.body for r in I.render_file(df, "outline").collect()}
    assert body == {"a.py": "2| class A:\n4|   def f(self):\n", "b.py": "1| x = 1\n", "c.py": I.EMPTY_NOTICE}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_report_is_parsed_once(spark):
    result = '<UnitTestResult testName="A.{0}" outcome="{1}" duration="00:00:01"/>'
    text = '<TestRun><ResultSummary><Counters total="2" passed="1" failed="1"/></ResultSummary><Results>' + result.format("x", "Failed") + result.format("y", "Passed") + "</Results></TestRun>"
    texts = [text, "<!-- c --><!DOCTYPE x>" + text, "<?xml version='1.0'?>" + text, text.replace("A.x", "&lt;!DOCTYPE"), "<!--<!DOCTYPE y>-->" + text, None]
    files = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "run_id int, file_no int, text string")
    found, counted = reports.read_test_report_xml(files), reports.test_report_counters(files)
    assert plan_of(found).count("from_xml(") == plan_of(counted).count("from_xml(") == 1
    assert sorted((r.run_id, r.name) for r in found.collect()) == [(0, "A.x"), (2, "A.x"), (3, "<!DOCTYPE"), (4, "A.x")]
    assert {r.run_id: (r.total, r.refused) for r in counted.collect()} == {0: (2, 0), 1: (0, 1), 2: (2, 0), 3: (2, 0), 4: (2, 0), 5: (0, 0)}


def test_only_results_that_may_have_failed_are_parsed(spark):
    tag = '<UnitTestResult testName="T{0}" outcome="{1}"{2}'
    pieces = "".join(tag.format(i, o, "/>") for i, o in enumerate(["Passed", "FAILED", "F&#97;iled", "error", "None"])) + tag.format(9, "Failed", ">")
    df = spark.createDataFrame([("r", "p", 0, 0, pieces)], "run_id string, path string, block bigint, at bigint, piece string")
    out = reports.read_report_results(df)
    assert "(?i)failed|error|&" in plan_of(out)
    assert [r.name for r in out.orderBy("seq").collect()] == ["T1", "T2", "T3", "T9"]


def test_lint_totals_parse_a_report_once(spark):
    from runsift.operators import extract
    from runsift.plans import q_extract
    text = ' \x01\n[{"errorCount":2,"warningCount":1},{"errorCount":3}]\x00 '
    df = spark.createDataFrame([(text,), ("x",), (None,)], "text string").select(extract.lint_json_totals(F.col("text")).alias("t"))
    assert plan_of(df).count("from_json(") == 1
    assert [tuple(r.t) if r.t else r.t for r in df.collect()][0] == (5, 1)
    assert plan_of(q_extract.e8t(spark, "/root/testdata/sf0.001")).count("from_json(") == 1


def test_transcript_lines_are_parsed_where_they_can_matter(spark):
    call = r'{"type":"tool_use","id":"c1","name":"Bash","input":{"command":"ls"}}'
    lines = [call, '{"type":"tool_result","tool_use_id":"c1","content":"out"}', "{'command':'make'}", r'{"command":"pwd"}', '{"note":1}', "{broken"]
    files = spark.createDataFrame([("s", "\n".join(lines))], "session_id string, text string")
    out = transcripts.read_transcripts_jsonl(files)
    assert plan_of(out).count("from_json(") <= 5
    assert [r.command for r in out.orderBy("seq").collect()] == ["ls", "make", "pwd"]
