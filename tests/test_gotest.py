"""Go test output as text and tables, against a line-by-line model and fixed cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from runsift.operators import gotest as G


def ev(action, package="p", test=None, output=None):
    return json.dumps({"Action": action, "Package": package, **({"Test": test} if test is not None else {}), **({"Output": output} if output is not None else {})})


def texts(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "run_id int, text string").repartition(3)
    return [r.v for r in df.select("run_id", fn(F.col("text")).alias("v")).orderBy("run_id").collect()]


CASES = [
    ([ev("run", "m", "A"), ev("output", "m", "A", "=== RUN   A\n"), ev("pass", "m", "A"), ev("pass", "m", "B"), ev("pass", "m")], "passed: 2"),
    ([ev("output", "c", "M", "=== RUN   M\n"), ev("output", "c", "D", "    d.go:20: zero\n"), ev("output", "c", "M", "    c.go:12: want 4\n    c.go:13: got 5\n"),
      ev("output", "c", "M", "--- FAIL: M (0.01s)\n"), ev("fail", "c", "M"), ev("skip", "c", "S"), ev("fail", "c", "D"), ev("fail", "c")],
     "go test: 2 failure(s)\n  FAIL: M\n    c.go:12: want 4\n    c.go:13: got 5\n  FAIL: D\n    d.go:20: zero\npassed: 0 | skipped: 1 | failed: 2"),
    ([ev("output", "b", output="# b\n"), ev("output", "b", output="./x.go:5:2: syntax\n"), ev("output", "b", output="FAIL\tb [build failed]\n"), ev("fail", "b"), ev("output", "a", output="panic: oh\n"), ev("fail", "a")],
     "go test: build failed in b\n  # b\n  ./x.go:5:2: syntax\n\ngo test: panic in a\n  panic: oh"),
    ([ev("output", "a", "T", f"line {i}\n") for i in range(40)] + [ev("fail", "a", "T")],
     "go test: 1 failure(s)\n  FAIL: T\n" + "".join(f"    line {i}\n" for i in range(15)) + "    ... (25 lines omitted) ...\npassed: 0 | failed: 1"),
    ([ev("output", "a", "T", "old\n"), ev("fail", "a", "T"), ev("pass", "a", "T"), ev("output", "a", "T", "new\n"), ev("fail", "a", "T")],
     "go test: 1 failure(s)\n  FAIL: T\n    new\npassed: 1 | failed: 1"),
    (["ok  \tpackage/foo\t0.01s", ""], None),
    (["=== RUN   A", "--- PASS: A (0.00s)", "=== RUN   B", "    b.go:15: want 1", "--- FAIL: B (0.00s)", "FAIL", ""], "go test: 1 failure(s)\n  FAIL: B\n    b.go:15: want 1"),
    (["--- FAIL: m::x (0.0s)", "--- FAIL: m::y (0.0s)", "FAILED"], "go test: 2 failure(s)\n  FAIL: m::x\n  FAIL: m::y"),
    (["FAIL\tm [build failed]", "FAIL"], "go test: 2 failure(s)\n  FAIL\tm [build failed]\n  FAIL"),
    (["{not json}", '{"Action":}', ""], None),
    ([""], None), (["   ", "\t  "], None),
]


def test_fixed_texts(spark):
    raw = ["\n".join(lines) for lines, _ in CASES]
    assert texts(spark, G.go_test_text, raw) == [want if want is not None else r for r, (_, want) in zip(raw, CASES, strict=True)]
    assert texts(spark, G.go_test_text, [None]) == [""]
    whole = texts(spark, lambda t: G.go_test_text(t, None), [raw[3]])[0]
    assert whole.count("    line ") == 40


def event_model(text):
    """Buffers by test, events in turn: (passed, skipped, tests, packages)."""
    buffers, own, failed, packages, passed, skipped = {}, {}, {}, {}, 0, 0
    for line in text.split("\n"):
        try:
            e = json.loads(line.strip())
        except ValueError:
            continue
        key, out = (e.get("Package", ""), e.get("Test", "")), e.get("Output")
        action = e.get("Action", "")
        if action == "output" and out is not None:
            if key[1].strip():
                buffers.setdefault(key, []).append(out)
            elif key[0].strip():
                own.setdefault(key[0], []).append(out)
        elif action in ("pass", "skip") and key[1].strip():
            passed, skipped = passed + (action == "pass"), skipped + (action == "skip")
            buffers.pop(key, None)
        elif action == "fail":
            if key[1].strip():
                failed.setdefault(key, None)
            elif key[0].strip():
                packages.setdefault(key[0], None)

    def clean(chunks, drop):
        return [y for c in chunks for x in c.split("\n") if (y := x.strip()) and not re.match(drop, y)]
    tests = [(p, t, clean(buffers.get((p, t), []), r"=== (RUN|PAUSE|CONT)\s|--- (PASS|FAIL|SKIP):\s")) for p, t in failed]
    out = []
    for p in packages:
        d, said = clean(own.get(p, []), "FAIL[\t ]"), " ".join(own.get(p, []))
        if d or p not in {x for x, _, _ in tests}:
            kind = "build failed" if "build failed" in said else "panic" if "panic:" in said else "panic / timeout" if "panic" in said or "timed out" in said else "package failed"
            out.append((p, kind, d))
    return passed, skipped, tests, out


def test_events_against_model(spark):
    rng = random.Random(3)
    says = ["=== RUN   T\n", "--- FAIL: T (0s)\n", "a.go:1: x\n  more\n", "panic: y\n", "FAIL\tp\n", "build", "failed\n", "timed out\n", "\n", "plain"]
    runs = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 60)):
            action = rng.choice(["run", "output", "output", "output", "pass", "skip", "fail", "fail"])
            lines.append(rng.choice(["{broken", "noise"]) if rng.random() < 0.05 else ev(action, rng.choice(["p", "q", "r"]), rng.choice([None, "", "T1", "T2", "T1/sub"]), rng.choice(says) if action == "output" else None))
        runs.append("\n".join(lines))
    got = texts(spark, G.event_summary, runs)
    for s, text in zip(got, runs, strict=True):
        assert (s.passed, s.skipped, [(t.package, t.name, t.diagnostics) for t in s.tests], [(p.package, p.kind, p.diagnostics) for p in s.packages]) == event_model(text)
    df = spark.createDataFrame(list(enumerate(runs)), "run_id int, text string")
    rows = G.go_text_failures(df).where("run_id < 5").orderBy("run_id", "seq").collect()
    want = [(i, p, t, "\n".join(d)) for i in range(5) for m in [event_model(runs[i])] for p, t, d in [*m[2], *((p, None, d) for p, _, d in m[3])]]
    assert [(r.run_id, r.package, r.name, r.diagnostics) for r in rows] == want


def log_model(text, limit=None):
    """Lines in turn: (name, diagnostics) of failures."""
    out, buffers, loose, current = [], {}, [], None
    for line in text.split("\n"):
        t = line.strip()
        if not t:
            continue
        if m := re.match(G.RUN, t):
            current = m[1]
            buffers.setdefault(current, [])
            loose = []
        elif m := re.match(G.PAUSE, t):
            current = None if m[1] == current else current
        elif m := re.match(G.FAIL, t):
            d = buffers.pop(m[1], [])
            if not d:
                d, loose = loose, []
            out.append((m[1], d))
            current = None if m[1] == current else current
        elif m := re.match(G.PASS, t):
            buffers.pop(m[1], None)
            current = None if m[1] == current else current
            loose = []
        elif line[0] in " \t" and not re.match(G.STATUS_MARK, t):
            if current is None:
                if limit is None or len(loose) < limit:
                    loose.append(t)
            else:
                d = buffers.setdefault(current, [])
                if limit is None or len(d) < limit:
                    d.append(t)
                elif len(d) == limit:
                    d.append(G.LOG_NOTE)
    return out


@pytest.mark.parametrize("limit", [None, 2])
def test_logs_against_model(spark, limit):
    rng = random.Random(4)
    marks = ["=== RUN   {}", "=== CONT  {}", "=== PAUSE {}", "--- FAIL: {} (0s)", "    --- FAIL: {} (0s)", "FAIL: {}", "--- PASS: {} (0s)", "--- SKIP: {}", "--- PASS: (x)", "  --- PASS: (x)"]
    logs = []
    for _ in range(80):
        logs.append("\n".join(rng.choice(marks).format(rng.choice(["A", "B", "A/s"])) if rng.random() < 0.4 else rng.choice(["    d{}", "\td{}", "free {}", "", "  "]).format(i) for i in range(rng.randint(0, 60))))
    got = texts(spark, lambda t: G.log_failures(t, limit), logs)
    assert [[(f.name, f.diagnostics) for f in g] for g in got] == [log_model(x, limit) for x in logs]


def test_json_lines(spark):
    raw = ["\n".join([ev("pass", test="A"), ev("skip", test="B"), ev("fail", test="C"), " " + ev("fail", test="D"), ev("fail"), "{bad"]), "--- FAIL: x\nok", "nothing", ""]
    assert texts(spark, G.json_lines_text, raw) == ["go test: 1 failure(s)\n  FAIL: C\npassed: 1 | skipped: 1 | failed: 1", "go test: 1 failure(s)\n  --- FAIL: x", "nothing", ""]


def test_long_run_stays_linear(spark):
    """A run of 60,000 interleaved events is one row's work."""
    lines = [ev("output", f"p{i % 7}", f"T{i % 501}", f"x.go:{i}: said\n") for i in range(60_000)] + [ev("fail", f"p{i}", f"T{i}") for i in range(7)]
    s = texts(spark, G.event_summary, ["\n".join(lines)])[0]
    assert len(s.tests) == 7 and sum(len(t.diagnostics) for t in s.tests) == sum(1 for i in range(60_000) if i % 501 < 7 and i % 7 == i % 501)


def test_pipeline_reduces_go_runs(spark):
    from runsift.plans.pipeline import run_pipeline
    raw = "\n".join([*[ev("output", "c", "M", f"=== RUN   M{i}\n") for i in range(30)], ev("output", "c", "M", "    c.go:12: want 4\n"), ev("fail", "c", "M")])
    df = spark.createDataFrame([(1, "go test -json ./...", 1, raw, "")], "run_id int, command string, exit_code int, stdout string, stderr string")
    r = run_pipeline(df).first()
    assert (r.rule, r.was_filtered, r.text_out) == ("go-test", True, "go test: 1 failure(s)\n  FAIL: M\n    c.go:12: want 4\npassed: 0 | failed: 1")
