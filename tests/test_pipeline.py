import pytest
from pyspark.sql import functions as F

from runsift.plans import pipeline
from runsift.plans.stages import build_rule, register_stage, rule_tests, stage_errors
from runsift.sources.rules import definitions, duplicate_prefixes, load_definitions, rules_frame


def test_rule_table(spark):
    defs = definitions()
    assert len(defs) == 107
    assert duplicate_prefixes(rules_frame(spark)).count() == 0
    assert all(build_rule(d) for d in defs.values())


def test_definition_loading():
    one = 'name = "x"\ncommands = ["a b"]\n[[stages]]\nstrategy = "ansi_strip"\n'
    assert load_definitions([one])["x"]["commands"] == ["a b"]
    with pytest.raises(ValueError, match="unknown keys"):
        load_definitions([one + "\n[zzz]\n"])
    with pytest.raises(ValueError, match="owned by"):
        load_definitions([one, one.replace('"x"', '"y"')])


@pytest.mark.parametrize("bad, message", [
    ({"strategy": "nope"}, "unknown strategy"),
    ({"strategy": "dedup", "window_size": 0}, "between 1 and 10000"),
    ({"strategy": "grouping", "pattern": "x" * 501}, "exceeds 500"),
    ({"strategy": "grouping", "pattern": "("}, "invalid"),
    ({"strategy": "grouping", "pattern": "abc"}, "capture group"),
    ({"strategy": "aggregate_by_key", "key": "zz", "header": "h"}, "'key' must be"),
    ({"strategy": "head_tail", "head": 1}, "'tail' must be"),
    ({"strategy": "state_machine", "initial_state": "A", "transitions": [{"from_state": "A", "pattern": "x", "next_state": "B"}] * 51}, "more than 50"),
    ({"strategy": "resource_graph", "max_lines": 100_001}, "between 1 and 100000"),
])
def test_stage_validation(bad, message):
    assert message in "; ".join(stage_errors("stages[0]", bad))


def test_own_stage_and_inline_tests(spark):
    register_stage("shout", lambda t, run, p: F.upper(t), "REWRITE")
    tests = spark.createDataFrame([("a", "x\nx", "X (×2)"), ("b", "y", "z")], "id string, input string, expected string")
    got = {r.id: r.passed for r in rule_tests(tests, [{"strategy": "dedup"}, {"strategy": "shout"}]).collect()}
    assert got == {"a": True, "b": False}


def test_short_circuit_skips_the_rest(spark):
    text = '{"valid":true,"diagnostics":[]}'
    df = spark.createDataFrame([(1, "terraform validate", text)], "run_id int, command string, text string")
    stages = definitions()["terraform"]["stages"]
    got = {r.stage: r.status for r in pipeline.explain(df, stages).collect()}
    assert got == {"ansi_strip": "ran", "machine_ui": "ran", "validate_json": "short_circuited", "grouping": "skipped"}


def test_pipeline_outcomes(spark):
    long = "\n".join(f"row {i}" for i in range(40))
    rows = [(1, "psql", 0, long, ""), (2, "gcc a.c", 1, "fine\nstill", ""), (3, "grep x", 1, "", ""), (4, "sops x", 2, "secret", "boom"),
            (5, "unknown", 0, "a", "b"), (6, "mypy", 0, "a.py:1: x", "")]
    df = spark.createDataFrame(rows, "run_id int, command string, exit_code int, stdout string, stderr string")
    got = {r.run_id: r for r in pipeline.run_pipeline(df).collect()}
    assert got[1].was_filtered and "omitted" in got[1].text_out and got[1].out_tokens < got[1].raw_tokens
    assert (got[2].incident, got[2].text_out) == ("apply_fallback", "fine\nstill")
    assert (got[3].text_out, got[3].gate_kind) == ("(no matches)", "gate")
    assert (got[4].text_out, got[4].was_filtered) == ("secret\nboom", False)
    assert (got[5].text_out, got[5].rule, got[5].was_filtered) == ("a\nb", None, False)
    assert (got[6].text_out, got[6].gate_kind) == ("a.py:1: x", "net_win_gate")


def test_kept_signals_or_fallback(spark):
    """Whatever a rule drops, a run either keeps its signals or stays whole."""
    import random
    rng = random.Random(11)
    pool = ["Traceback (most recent call last)", "FAILED t", "src/a.rs:3:1: error: x", "CVE-2024-1111", "noise", "more noise", "a.py:1: e", "panic: x"]
    rows = [(i, rng.choice(["psql", "gcc a.c", "mypy", "ps", "du", "ssh h"]), rng.randint(0, 1), "\n".join(rng.choices(pool, k=rng.randint(1, 60))), "")
            for i in range(60)]
    df = spark.createDataFrame(rows, "run_id int, command string, exit_code int, stdout string, stderr string")
    out = pipeline.run_pipeline(df).withColumn("before", F.col("stdout")).withColumn("after", F.col("text_out"))
    from runsift.operators.fidelity import fidelity_check
    assert fidelity_check(out).where("NOT passed").count() == 0


def test_patterns_are_judged_by_their_engine(spark):
    """Forms that only the engine knows pass, forms that it lacks do not."""
    from runsift.plans import stages
    group = lambda p: stages.stage_errors("s", {"strategy": "grouping", "pattern": p})
    for good in (r"(\p{Lu}+)", r"(?<word>\w++)", r"(a)|b", r"^(?:x|(y))\z", r"([a-z&&[^q]])"):
        assert group(good) == []
    for bad in (r"(?P<word>a)", "(", "[a", r"\k<none>(a)"):
        assert group(bad) and "does not compile" in group(bad)[0]
    for flat in ("abc", r"(?:a)", r"\(a\)", r"[(]a[)]"):
        assert "capture group" in group(flat)[0]
    assert stages.stage_errors("s", {"strategy": "regex_capture", "pattern": "abc"}) == []
    df = spark.createDataFrame([(1, r"(\p{Lu})", True), (2, "(", False), (3, "a", True)], "id int, pattern string, needs_group boolean")
    assert {r.id: r.problem is None for r in stages.pattern_problems(df).collect()} == {1: True, 2: False, 3: False}
