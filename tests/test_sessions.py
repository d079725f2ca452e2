import datetime as dt

import pytest
from pyspark.sql import functions as F

from runsift.functions import commands as C
from runsift.functions.redact import redact
from runsift.operators import prepare as P
from runsift.operators import sessions as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    def make(*rows):
        data = [(s, i, T0 + dt.timedelta(minutes=m), c, x, "", 0, False, None) for i, (s, m, c, x) in enumerate(rows)]
        return spark.createDataFrame(data, "session_id string, seq int, ts timestamp_ntz, command string, exit_code int, output string, "
                                           "output_bytes bigint, filtered boolean, cwd string")
    return make


def pairs(df):
    return {(r.session_id, r.failed_command, r.corrected_command, r.delta_ms) for r in S.correction_pairs(df).collect()}


def test_unrelated_success_leaves_the_failure_waiting(events):
    assert pairs(events(("a", 0, "mvn test", 1), ("a", 1, "ls", 0), ("a", 2, "mvn verify", 0), ("a", 3, "mvn x", 0))) == {
        ("a", "mvn test", "mvn verify", 120_000)}


def test_never_across_sessions_and_only_the_latest_failure(events):
    assert pairs(events(("a", 0, "git push", 1), ("b", 1, "git push", 0))) == set()
    assert pairs(events(("a", 0, "git a", 1), ("a", 1, "git b", 1), ("a", 2, "git c", 0))) == {("a", "git b", "git c", 60_000)}


def test_out_of_window_success_ends_the_wait(events):
    assert pairs(events(("a", 0, "npm t", 1), ("a", 31, "ls", 0), ("a", 32, "npm t", 0))) == set()
    assert pairs(events(("a", 10, "npm t", 1), ("a", 5, "ls", 0), ("a", 11, "npm t", 0))) == set()
    assert pairs(events(("a", 0, "npm t", 1), ("a", 30, "npm t", 0))) == {("a", "npm t", "npm t", 1_800_000)}


def test_related(apply):
    assert apply(C.related, "MVN a", "mvn b") and apply(C.related, "./mvnw a", "mvn b") and not apply(C.related, "ls", "lsx")


def test_call_pairing(spark):
    calls = spark.createDataFrame([("s", "c1", 1, T0, "Bash", "ls"), ("s", "c1", 4, T0, "Bash", "pwd"), ("s", "c2", 5, T0, "editor", "x")],
                                  "session_id string, call_id string, seq int, ts timestamp_ntz, tool string, command string")
    late = T0 + dt.timedelta(seconds=2)
    results = spark.createDataFrame([("s", "c1", 2, late, "one", None, True), ("s", "c1", 3, late, "again", 0, False), ("s", "c1", 6, late, "two", 7, False),
                                     ("s", "c2", 7, late, "no", 0, False)],
                                    "session_id string, call_id string, seq int, ts timestamp_ntz, content string, exit_code int, is_error boolean")
    got = {(r.command, r.output, r.exit_code, r.duration_ms) for r in S.pair_tool_calls(calls, results).collect()}
    assert got == {("ls", "one", 1, 2000), ("pwd", "two", 7, 2000)}


def test_split_compound(spark):
    df = spark.createDataFrame([(1, "sudo -u root git push && FOO=1 /bin/LS.exe 'a;b' | time -p make"), (2, "echo 'x"), (3, "cat <<EOF"),
                                (4, "a `b`; eval c"), (5, "  "), (6, "> out ls")], "run_id int, command string")
    got = {(r.run_id, r.seg_no): (r.raw, r.executable, r.reason) for r in P.split_compound(df).collect()}
    assert got == {
        (1, 0): ("sudo -u root git push", "git", None), (1, 1): ("FOO=1 /bin/LS.exe 'a;b'", "ls", None), (1, 2): ("time -p make", "make", None),
        (2, 0): ("echo 'x", None, C.REASON_SINGLE), (3, 0): ("cat <<EOF", None, C.REASON_HEREDOC),
        (4, 0): ("a `b`", None, C.REASON_SUBSHELL), (4, 1): ("eval c", "eval", C.REASON_DYNAMIC), (6, 0): ("> out ls", "ls", None)}


def test_long_quoted_command_needs_no_regex_stack(spark):
    df = spark.createDataFrame([(1, 'echo "' + "x\\n" * 40_000 + '" ; ls')], "run_id int, command string")
    assert [r.executable for r in P.split_compound(df).orderBy("seg_no").collect()] == ["echo", "ls"]


def test_redaction(apply):
    assert apply(redact, "curl --token=abc https://u:p@h") == "curl --token=[REDACTED_SECRET] https://u:[REDACTED_SECRET]@h"
    assert "[REDACTED_GOOGLE_KEY]" in apply(redact, "k AIza" + "x" * 30)
    assert "[REDACTED_BEARER_TOKEN]" in apply(redact, "Authorization: Bearer abcdefghijk")
    assert "sk-ant" not in apply(redact, "sk-ant-abcdefgh12345")


def test_failure_classes(apply):
    assert apply(S.failure_class, "error TS2345: x") == "COMPILATION_ERROR"
    assert apply(S.failure_class, "first\nerror TS2345: x") == "GENERAL_FAILURE"
    assert apply(S.failure_class, "3 tests failed") == "TEST_FAILURE"
    assert apply(S.failure_sample, "  \n" + "x" * 101) == "x" * 97 + "..."


def test_unsupported_shares_tokens_between_segments(spark, events):
    df = events(("a", 0, "zig build && foo bar", 0), ("a", 1, "git status", 0)).withColumn("output_bytes", F.lit(44).cast("bigint"))
    got = {r.prefix: (r.runs, r.tokens) for r in S.unsupported_commands(df, ["git status"]).collect()}
    assert got == {"zig": (1, 5), "foo": (1, 5)}


def test_prefix_lookup_takes_the_longest(spark):
    runs = spark.createDataFrame([(1, " Git  STATUS -s"), (2, "git"), (3, "gitx"), (4, None)], "run_id int, command string")
    rules = spark.createDataFrame([("git", "short"), ("git status", "long")], "prefix string, rule string")
    assert {r.run_id: r.rule for r in P.match_rule(runs, rules).collect()} == {1: "long", 2: "short", 3: None, 4: None}


def test_large_dimension_gets_no_broadcast_hint(spark):
    dim = spark.range(50).selectExpr("id AS k")
    assert "broadcast" in P.with_bound(dim, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in P.with_bound(dim, 10)._jdf.queryExecution().logical().toString().lower()
