import pytest
from pyspark.sql import functions as F

from runsift.operators import fidelity as D


@pytest.fixture(scope="module")
def failures(spark):
    def run(command, exit_code, before, after):
        df = spark.createDataFrame([(1, command, exit_code, before, after)], "run_id int, command string, exit_code int, before string, after string")
        return D.fidelity_check(df).first().failures
    return run


def test_empty_output(failures):
    assert failures("x", 0, "a", " ") == ["filtered output is empty"]
    assert failures("x", 1, "ok", "ok") == []


def test_lost_signals(failures):
    assert failures("psql", 0, "ERROR: no table\nrow", "row") == ["sql error message dropped no table"]
    assert failures("x", 0, "CVE-2024-1234 found", "found") == ["security advisory dropped CVE-2024-1234"]
    assert failures("tf", 0, "a must be replaced", "a") == ["terraform replacement signal dropped"]


def test_evidence_in_the_middle_of_a_long_text(failures):
    fill = "plain line of output\n" * 20_000
    assert failures("x", 0, fill + "CVE-2024-1234 found\n" + fill, "found") == ["security advisory dropped CVE-2024-1234"]


def test_strict_checks_need_a_failure(failures):
    before = "  at a.B.c(B.java:1)\nrest"
    assert failures("x", 0, before, "rest") == []
    assert failures("x", 1, before, "rest") == ["stack frames dropped"]
    assert failures("ls", 1, before, "rest") == []


def test_compiler_location(failures):
    assert failures("gcc", 1, "a.c:3:1: error: x\nmore", "more") == ["compiler diagnostic dropped a.c:3"]
    assert failures("gcc", 1, "notes.txt:3:1: error: x\nmore", "more") == []


def test_diff_headers(failures):
    before = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+a"
    assert failures("git diff", 0, before, "diff --git a/x b/x\n+a") == [
        "unified diff --- header dropped", "unified diff +++ header dropped", "unified diff hunk header dropped"]
    assert failures("git diff --stat", 0, before, "1 file changed") == []


def test_bare_success_on_failure(failures):
    assert failures("x", 2, "lots", " Build successful. ") == ["misleading clean summary on non-zero exit"]


def test_identifiers(apply):
    ids = lambda b, a: apply(D.dropped_ids, b, a)
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    assert ids(f"{uuid} ABC-12 UTF-8 dead12beef", "") == [uuid, "ABC-12", "dead12beef"]
    assert ids("deadbeef 1234567", "") == []
    assert ids("ABC-12", "see ABC-12") == []
    many = " ".join(f"AB-{i}" for i in range(10, 40))
    assert len(ids(many, "")) == 30
    assert len(apply(lambda b, a: D.dropped_ids(b, a, 12), many, "")) == 12


def test_factsheet_length(spark):
    df = spark.createDataFrame([(["x" * 100, "y" * 100, "z" * 100],)], "ids array<string>")
    line = df.select(D.factsheet(F.col("ids"))).first()[0]
    assert line == f"[preserved ids: {'x' * 100}, {'y' * 100}]"


def test_net_win(apply):
    gate = lambda cmd, x, b, a: apply(lambda c, e, p, q: D.net_win_gate(c, e, p, q, F.length(p), F.length(q)), cmd, x, b, a)
    assert gate("x", 0, "ab", "abcd") == "ab"
    assert gate("x", 1, "ab", "abcd") == "abcd"
    assert gate("npm ci", 0, "ab", "abcd") == "abcd"
    assert gate("kubectl get pods", 0, "ab", "xabx") == "xabx"


def test_line_diff_accounts_for_every_line(spark):
    df = spark.createDataFrame([(1, "a\nb\na\n", "a\nc\n"), (2, "", "x")], "run_id int, before string, after string")
    rows = {(r.run_id, r.line, r.side, r.line_no) for r in D.line_diff(df).collect()}
    assert rows == {(1, "a", "kept", 0), (1, "b", "dropped", 1), (1, "a", "dropped", 2), (1, "", "kept", 3), (1, "c", "added", 1),
                    (2, "", "dropped", 0), (2, "x", "added", 0)}
    inrow = df.select("run_id", D.diff_in_row(F.col("before"), F.col("after")).alias("d")).select("run_id", "d.*")
    assert {(r.run_id, r.kept, r.dropped, r.added) for r in inrow.collect()} == {(1, 2, 2, 1), (2, 0, 1, 1)}
    counts = {(r.run_id, r.kept, r.dropped, r.added) for r in D.line_diff_counts(df).collect()}
    assert counts == {(1, 2, 2, 1), (2, 0, 1, 1)}


def test_all_evidence_is_reported(spark):
    lines = [f"CVE-2024-100{k}" for k in range(6)] + [f"src/m{k}.c:{k}: error: bad" for k in range(5)]
    df = spark.createDataFrame([("make", 1, "\n".join(lines), "nothing")], "command string, exit_code int, before string, after string")
    args = [F.col(c) for c in ("command", "exit_code", "before", "after")]
    found = df.select(D.fidelity_failures(*args)).first()[0]
    assert found == [f"security advisory dropped CVE-2024-100{k}" for k in range(6)] + [f"compiler diagnostic dropped src/m{k}.c:{k}" for k in range(5)]
    few = df.select(D.fidelity_failures(*args, D.Limits(cves=2, locations=1))).first()[0]
    assert len(few) == 3
    signals = df.select(D.signals_of(F.col("command"), F.col("before"))).first()[0]
    assert [s.kind for s in signals].count("cve") == 6 and [s.kind for s in signals].count("pointer") == 5


def test_diff_signals_with_and_without_limits(spark):
    text = "\n".join(line for k in range(30) for line in (f"diff --git a/f{k} b/f{k}", f"+{'x' * 90}{k}"))
    df = spark.createDataFrame([("git diff", text)], "command string, before string")
    every = df.select(D.signals_of(F.col("command"), F.col("before"))).first()[0]
    assert [s.kind for s in every].count("diff_file") == 30 and [s.value for s in every].count("x" * 90 + "29") == 1
    some = df.select(D.signals_of(F.col("command"), F.col("before"), D.Limits(files=20, changes=5, chars=80))).first()[0]
    assert [s.kind for s in some].count("diff_added") == 5 and {len(s.value) for s in some if s.kind == "diff_added"} == {80}
