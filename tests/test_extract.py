import json

from pyspark.sql import functions as F

from runsift.operators import extract as E
from runsift.operators import sections


def names(apply, fn, text):
    return [c["name"] for c in apply(fn, text)]


def test_pytest(apply):
    text = "x\n=== short test summary info ===\nFAILED a::b - 3 failed\nERROR c\n== 1 failed, 2 passed ==\nFAILED late"
    assert names(apply, E.pytest_cases, text) == ["a::b", "c"]
    c = apply(E.pytest_counts, text)
    assert (c["passed"], c["failed"], c["errors"]) == (2, 1, 0)
    assert apply(E.pytest_text, "nothing here\n") == "nothing here" and apply(E.pytest_text, "") == E.ALL_PASSED


def test_cargo(apply):
    assert apply(E.cargo_text, "   Compiling x\nerror: y", 101) == "cargo test: compile error\nerror: y"
    assert apply(E.cargo_text, "test a ... FAILED\ntest result: FAILED. 1 passed; 1 failed", 101) == (
        "cargo test: 1 failure(s)\n  FAILED: a\ntest result: FAILED. 1 passed; 1 failed")


def test_jest_caps(apply):
    text = "FAIL a.js\n  ● one\n" + "\n".join(f"    d{i}" for i in range(20)) + "\n" + "\n".join("    at x" for _ in range(9)) + "\nTests: 1 failed, 4 passed, 5 total"
    case = apply(E.jest_cases, text)[0]
    detail = case["detail"].split("\n")
    assert case["suite"] == "a.js" and len(detail) == 15 + 1 + 5 + 1
    c = apply(E.jest_counts, text)
    assert (c["passed"], c["failed"], c["total"]) == (4, 1, 5)
    assert apply(E.jest_cases, "FAIL b.js\nTests: x")[0]["name"] == "(suite error)"


def test_browser_drops_call_log(apply):
    text = "  1) [x] t ───\nErr\nCall log:\n  - waiting\n    deep\nafter\nattachment #1: s\na.png\nend\n  1 failed"
    assert apply(E.browser_cases, text)[0]["detail"] == "    Err\n    after\n    end"


def test_git_status(apply):
    s = apply(E.git_status, "On branch main\nChanges to be committed:\n\tnew file:   a\n\nUntracked files:\n\tb\n")
    assert (s["branch"], s["staged"], s["untracked"], s["clean"]) == ("main", ["a"], ["b"], False)
    assert apply(E.git_status_text, "") == "✓ clean"
    assert apply(E.git_status_text, "M  a\n M b\n?? c") == "staged: 1 | modified: 1 | untracked: 1"


def test_plan_version_and_caps(apply):
    ui = '{"@module":"terraform.ui","type":"planned_change","change":{"action":"create","resource":{"addr":"a.b"}}}'
    assert apply(E.plan_text, '{"type":"version","ui":"2.0"}\n' + ui) is None
    assert apply(E.plan_text, "plain text") is None
    p = apply(E.plan_events, "\n".join([ui] * 1005))
    assert len(p["rows"]) == 1000 and p["capped"]


def test_plan_whole(apply):
    ui = '{"@module":"terraform.ui","type":"planned_change","change":{"action":"replace","resource":{"addr":"a.b"}}}'
    diag = '{"@module":"terraform.ui","type":"diagnostic","@level":"error","diagnostic":{"summary":"s"}}'
    text = "\n".join([ui] * 10_005 + [diag] * 250)
    p = apply(lambda t: E.plan_events(t, E.ALL), text)
    assert len(p["rows"]) == 10_255 and not p["capped"] and p["summary"]["replace"] == 10_005
    assert apply(E.plan_events, "\n".join([ui] * 1005))["summary"]["replace"] == 1005


def test_go_diagnostics_whole(spark):
    def event(action, test, **more):
        return json.dumps({"Action": action, "Package": "p" if test else "q", **({"Test": test} if test else {}), **more})

    texts = [event("output", t, Output=f"line {n}\n") for t in ("T", "") for n in range(40)] + [event("fail", "T"), event("fail", "")]
    df = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "run_id int, line_no int, line string")
    want = "\n".join(f"line {n}" for n in range(40))
    assert [(r.diagnostics, r.omitted) for r in E.go_failed_tests(df).collect()] == [(want, 0)]
    assert [r.diagnostics for r in E.go_failed_packages(df).collect()] == [want]
    assert [r.omitted for r in E.go_failed_tests(df, limit=15).collect()] == [25]


def test_validate(apply):
    assert apply(E.validate_text, '{"valid": true, "error_count": 0, "warning_count": 0, "diagnostics": []}') == "validate: ok"
    assert apply(E.validate_text, '{"other": 1}') is None
    assert apply(E.validate_result, '{"valid":false,"x":' + "[" * 9 + "]" * 9 + "}") is None


def test_addresses(apply):
    text = "module.a.aws_x.b\ndata.aws_x.c\naws_y.d[0]\n"
    assert apply(lambda c: E.resource_graph_text(c, "{lines} in {keys}", 1), text) == "3 in 2\naws_x: 2\nmodule.a.aws_x.b\ndata.aws_x.c\naws_y.d[0]"
    assert apply(lambda c: E.resource_graph_text(c, "h"), "one line\nother line") == "one line\nother line"


def test_containers(apply):
    text = "ID  IMAGE\nabcdef123456  img  \"c\"  now  Up 5 minutes  80  web\nshort row"
    assert apply(E.containers_text, text).split("\n")[2:] == ["abcdef12 img                  Up 5 minut web", "short row"]


def test_run_view(apply):
    text = "X main build\n\nJOBS\n✓ lint in 1s\n  ✓ step\nX test in 2s\n  X run tests\n  ✓ setup\n\nANNOTATIONS\nX boom\nnote\n\nFor more information, see x"
    out = apply(lambda t: sections.section_filter(t, F.lit("gh run view 1"), F.lit(0), "gh"), text)
    assert out == "X main build\n\nJOBS\n✓ lint in 1s\nX test in 2s\n  X run tests\n\nANNOTATIONS\nX boom"


def test_ci_view(apply):
    out = apply(lambda t: sections.section_filter(t, F.lit("glab ci view"), F.lit(0), "glab"), "Pipeline #1\nJobs:\n✓ a\nb failed\n")
    assert out == "Pipeline #1\n\n✗ 1 of 2 jobs failed:\n  b failed\n✓ 1 jobs passed"


def test_errors_are_counted_before_the_text_is_cut(spark):
    text = "\n".join(f"make: Error {k}" for k in range(40))
    got = spark.createDataFrame([(text,)], "text string").select(E.build_status("make", F.col("text"), F.lit(2)).alias("s")).first().s
    assert got.errors == 40 and len(got.text.split("\n")) == 15


def test_go_events_in_rows_and_limited(spark):
    rows = [(1, i, '{"Action":"output","Package":"p","Test":"T","Output":"l%d\\n"}' % i) for i in range(40)]
    rows += [(1, 50, '{"Action":"fail","Package":"p","Test":"T"}'), (1, 51, '{"Action":"fail","Package":"p","Test":"quiet"}'), (1, 52, '{"Action":"output","Package":"q","Output":"oh\\nno\\n"}'),
             (1, 53, '{"Action":"fail","Package":"q"}'), (1, 54, '{"Action":"fail","Package":"p"}')]
    df = spark.createDataFrame(rows, "run_id int, line_no int, line string")
    assert [r.diagnostic for r in E.go_failed_test_lines(df).orderBy("line_no").collect()] == [f"l{i}" for i in range(40)]
    got = {(r.test, r.diagnostics, r.omitted) for r in E.go_failed_tests(df, limit=3).collect()}
    assert got == {("T", "l0\nl1\nl2", 37), ("quiet", "", 0)}
    assert {(r.test, r.diagnostics.count("\n"), r.omitted) for r in E.go_failed_tests(df).collect()} == {("T", 39, 0), ("quiet", 0, 0)}
    assert [tuple(r) for r in E.go_failed_packages(df).collect()] == [(1, "q", "package failed", "oh\nno")]
    assert [tuple(r) for r in E.go_failed_packages(df, limit=1).collect()] == [(1, "q", "package failed", "oh")]
