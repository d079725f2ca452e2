"""Named stages and their validation: the extension surface.

A stage turns a text column into a text column. User code adds its own with
`register_stage`; a rule names stages with parameters and `build_rule` checks them
against the same bounds the built-in ones have.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.functions.text import let, nn
from runsift.operators import diffs, extract as E, gotest, reduce as R, sections

# Bounds of stage parameters.
MAX_WINDOW, MAX_PATTERN, MAX_TRANSITIONS, MAX_TOP_N, MAX_LINES = 10_000, 500, 50, 10_000, 100_000
MAX_RULE_PATTERNS = 100_000
CAPABILITIES = ("REDUCE", "REWRITE", "RESHAPE")
STREAMABILITIES = ("order_local", "windowed", "document")


@dataclass(frozen=True)
class RunColumns:
    """Columns of the run a stage may look at besides its text."""
    command: Column
    exit_code: Column
    stdout: Column
    verbose: Column
    ultra_compact: Column
    active: Column


# (text, run columns, parameters) -> text, or (text, stop)
StageFn = Callable[[Column, RunColumns, Mapping], "Column | tuple[Column, Column]"]


@dataclass(frozen=True)
class Stage:
    name: str
    fn: StageFn
    capability: str
    streamability: str


_STAGES: dict[str, Stage] = {}
_ALIASES: dict[str, str] = {}


def register_stage(name: str, fn: StageFn, capability: str = "RESHAPE", streamability: str = "document",
                   aliases: tuple[str, ...] = ()) -> Stage:
    if capability not in CAPABILITIES:
        raise ValueError(f"capability must be one of {CAPABILITIES}")
    if streamability not in STREAMABILITIES:
        raise ValueError(f"streamability must be one of {STREAMABILITIES}")
    stage = Stage(name, fn, capability, streamability)
    _STAGES[name] = stage
    for alias in (name, *aliases):
        _ALIASES[alias.strip().lower()] = name
    return stage


def stage(name: str) -> Stage:
    key = (name or "").strip().lower()
    if key not in _ALIASES:
        raise ValueError(f"unknown strategy: {name!r}; known: {', '.join(sorted(_STAGES))}")
    return _STAGES[_ALIASES[key]]


def stage_names() -> list[str]:
    return sorted(_STAGES)


def _stop_if(result: Column, text: Column) -> tuple[Column, Column]:
    """A structured reader ends the chain when it recognised the text."""
    return F.coalesce(result, text), result.isNotNull()


def _grouping(text: Column, run: RunColumns, p: Mapping) -> Column:
    pattern = p.get("pattern")
    return R.grouping(text, "(.*)" if pattern is None else pattern, p.get("include_other", False))


def _lint_json(text: Column, run: RunColumns, p: Mapping):
    known = E.lint_json(text).isNotNull()
    return F.when(known, E.lint_text_summary(text, run.exit_code)).otherwise(text), known


def _cat(text: Column, run: RunColumns, p: Mapping) -> Column:
    return R.large_document(text, run.ultra_compact, run.active)


def _same(text: Column, run: RunColumns, p: Mapping) -> Column:
    return text


def _builtin() -> None:
    add = register_stage
    add("ansi_strip", lambda t, r, p: R.ansi_strip(t), "REDUCE", "order_local", ("ansi-strip", "ansi"))
    add("tree_compression", lambda t, r, p: R.tree_compression(t), "REDUCE", "document", ("tree-compression", "tree"))
    add("deduplication", lambda t, r, p: R.deduplicate(t, p.get("window_size") or R.DEDUP_WINDOW), "REDUCE", "document", ("dedup",))
    add("head_tail", lambda t, r, p: R.head_tail(t, p.get("head", 20), p.get("tail", 20)), "REDUCE", "windowed", ("head-tail",))
    add("tail_lines", lambda t, r, p: R.tail_lines(t, p.get("max_lines", 20), bool(p.get("skip_blank", False)),
                                                    bool(p.get("header_only_when_truncating", True))), "REDUCE", "document", ("tail-lines",))
    add("regex_capture", lambda t, r, p: R.regex_capture(t, p.get("pattern") or "(.*)", p.get("format"), p.get("fallback") or ""),
        "REWRITE", "document", ("regex-capture",))
    add("state_machine", lambda t, r, p: R.state_machine(t, p.get("initial_state", "START"), p.get("transitions", ()), p.get("default_actions")),
        "REWRITE", "order_local", ("state-machine",))
    add("grouping", _grouping, aliases=("group",))
    add("aggregate_by_key", lambda t, r, p: R.aggregate_by_key(t, p.get("key", R.KEY_PREFIX), p.get("header", "{lines}"), p.get("top_n") or 10),
        aliases=("aggregate-by-key",))
    add("json_structure", lambda t, r, p: R.json_structure(t, r.active), aliases=("json-structure", "json"))
    add("cat_content", _cat)
    add("grep_summary", lambda t, r, p: R.search_result_sample(t))
    add("find_summary", lambda t, r, p: R.path_listing_sample(t))
    add("kubectl_dispatch", lambda t, r, p: R.unhealthy_first(t, r.command))
    add("git_log", lambda t, r, p: R.git_log_top(t, r.verbose, r.ultra_compact))
    add("ls_empty_tree_fallback", lambda t, r, p: R.empty_tree_fallback(t, r.stdout))
    add("git_diff_summary", lambda t, r, p: diffs.diff_summary(t, r.command, r.ultra_compact, r.verbose))
    add("gh_summary", lambda t, r, p: sections.section_filter(t, r.command, r.exit_code, "gh"))
    add("glab_summary", lambda t, r, p: sections.section_filter(t, r.command, r.exit_code, "glab"))
    add("pytest_summary", lambda t, r, p: E.pytest_text(t))
    add("cargo_test_summary", lambda t, r, p: E.cargo_text(t, r.exit_code))
    add("jest_summary", lambda t, r, p: E.jest_text(t, r.exit_code))
    add("vitest_summary", lambda t, r, p: E.vitest_text(t, r.exit_code))
    add("playwright_summary", lambda t, r, p: E.browser_text(t, r.exit_code))
    add("eslint_json", _lint_json)
    add("eslint_text", lambda t, r, p: E.lint_text_summary(t, r.exit_code))
    add("cargo_clippy_summary", lambda t, r, p: E.lint_count_text("clippy", t, r.exit_code))
    add("ruff_summary", lambda t, r, p: E.lint_count_text("ruff", t, r.exit_code))
    add("golangci_summary", lambda t, r, p: E.lint_count_text("golangci", t, r.exit_code))
    add("tsc_summary", lambda t, r, p: E.type_error_text(t, r.exit_code))
    add("gradle_summary", lambda t, r, p: E.build_status("gradle", t, r.exit_code)["text"])
    add("mvn_summary", lambda t, r, p: E.build_status("mvn", t, r.exit_code)["text"])
    add("make_summary", lambda t, r, p: E.build_status("make", t, r.exit_code)["text"])
    add("cargo_install_summary", lambda t, r, p: E.build_status("cargo-install", t, r.exit_code, r.command)["text"])
    add("docker_build_summary", lambda t, r, p: E.image_build(t, r.exit_code)["text"], "RESHAPE", "order_local")
    add("npm_install_summary", lambda t, r, p: E.npm_status(t, r.exit_code)["text"], "RESHAPE", "order_local")
    add("pip_install_summary", lambda t, r, p: E.pip_text(t))
    add("git_status", lambda t, r, p: E.git_status_text(t), aliases=("git-status",))
    add("git_commit_summary", lambda t, r, p: E.git_commit_text(t, r.ultra_compact))
    add("git_push_summary", lambda t, r, p: E.git_push_text(t, r.exit_code))
    add("git_add_summary", lambda t, r, p: E.git_add_text(t))
    add("docker_ps", lambda t, r, p: E.containers_text(t), aliases=("docker-ps",))
    add("machine_ui", lambda t, r, p: _stop_if(E.plan_text(t), t), aliases=("machine-ui",))
    add("validate_json", lambda t, r, p: _stop_if(E.validate_text(t), t), aliases=("validate-json",))
    add("resource_graph", lambda t, r, p: E.resource_graph_text(t, p.get("header") or "", p.get("top_n") or E.RESOURCE_TOP,
                                                               p.get("max_lines") or E.RESOURCE_CAP, p.get("fallback") or ""),
        aliases=("resource-graph",))
    # Readers of side-car files: without the artifact the text passes through.
    add("trx_report", _same, aliases=("trx-report",))
    add("msbuild_binlog", _same, aliases=("msbuild-binlog",))
    add("format_report", _same, aliases=("format-report",))
    add("go_test_summary", lambda t, r, p: gotest.go_test_text(t), aliases=("go-test-summary",))
    add("json_lines", lambda t, r, p: gotest.json_lines_text(t), aliases=("json-lines",))


_builtin()


# --- validation -----------------------------------------------------------------------

def _between(errors: list[str], where: str, p: Mapping, name: str, low: int, high: int) -> None:
    value = p.get(name)
    if value is not None and not low <= value <= high:
        errors.append(f"{where}: '{name}' must be between {low} and {high}, got: {value}")


def _pattern(errors: list[str], where: str, value: str | None, needs_group: bool, required: bool = True) -> None:
    if not value or not value.strip():
        if required:
            errors.append(f"{where}: 'pattern' must not be empty")
        return
    if len(value) > MAX_PATTERN:
        errors.append(f"{where}: 'pattern' exceeds {MAX_PATTERN} characters")
        return
    if problem := pattern_problem(value, needs_group):
        errors.append(f"{where}: {problem}")


@lru_cache(maxsize=4096)
def pattern_problem(pattern: str, needs_group: bool = False) -> str | None:
    """What the engine that runs a pattern has against it; None when it compiles.

    The pattern is put to the regular expression functions themselves, on one empty text: constant expressions are
    evaluated while the statement is planned, so this runs no job. The empty alternative lets the group be looked up.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    probe = spark.range(1).select(F.lit("").rlike(pattern).alias("v"))
    try:
        probe.collect()
    except Exception as e:
        if "PATTERN" not in str(e) and "regex" not in str(e).lower():
            raise
        return "invalid 'pattern': the regular expression does not compile"
    if needs_group:
        try:
            spark.range(1).select(F.regexp_extract(F.lit(""), f"{pattern}|", 1).alias("v")).collect()
        except Exception as e:
            if "GROUP" not in str(e).upper():
                raise
            return "'pattern' needs a capture group"
    return None


def pattern_problems(patterns: DataFrame) -> DataFrame:
    """(id, pattern, needs_group) -> id, problem: the patterns of a rule table that its engine refuses.

    A table of rules is configuration: its patterns come to the driver, which is where statements are planned.
    """
    found = [(r["id"], pattern_problem(r["pattern"], bool(r["needs_group"]))) for r in patterns.select("id", "pattern", "needs_group").limit(MAX_RULE_PATTERNS).collect()]
    return patterns.sparkSession.createDataFrame(found, f"id {patterns.schema['id'].dataType.simpleString()}, problem string")


def stage_errors(where: str, p: Mapping) -> list[str]:
    """Problems of one stage definition; empty when it is fine."""
    errors: list[str] = []
    name = p.get("strategy")
    if not name or not name.strip():
        return [f"{where}: missing 'strategy'"]
    try:
        kind = stage(name).name
    except ValueError as e:
        return [f"{where}: {e}"]
    if kind == "deduplication":
        _between(errors, where, p, "window_size", 1, MAX_WINDOW)
    elif kind == "grouping":
        _pattern(errors, where, p.get("pattern"), True)
    elif kind == "regex_capture":
        _pattern(errors, where, p.get("pattern"), False)
    elif kind == "head_tail":
        for side in ("head", "tail"):
            if p.get(side) is None or p[side] < 0:
                errors.append(f"{where}: '{side}' must be >= 0")
    elif kind == "tail_lines":
        if p.get("max_lines") is None or p["max_lines"] < 1:
            errors.append(f"{where}: 'max_lines' must be >= 1")
    elif kind == "aggregate_by_key":
        if (p.get("key") or "").strip().lower() not in (R.KEY_PREFIX, R.KEY_EXTENSION):
            errors.append(f"{where}: 'key' must be '{R.KEY_PREFIX}' or '{R.KEY_EXTENSION}'")
        if not (p.get("header") or "").strip():
            errors.append(f"{where}: 'header' must not be empty")
        _between(errors, where, p, "top_n", 1, MAX_TOP_N)
    elif kind == "resource_graph":
        if (p.get("key") or "resource_type").strip().lower() not in ("resource_type", "whole_line"):
            errors.append(f"{where}: 'key' must be 'resource_type' or 'whole_line'")
        _between(errors, where, p, "top_n", 1, MAX_TOP_N)
        _between(errors, where, p, "max_lines", 1, MAX_LINES)
    elif kind == "state_machine":
        if not (p.get("initial_state") or "").strip():
            errors.append(f"{where}: 'initial_state' must not be empty")
        moves = p.get("transitions") or []
        if len(moves) > MAX_TRANSITIONS:
            errors.append(f"{where}: more than {MAX_TRANSITIONS} transitions")
        for i, t in enumerate(moves):
            at = f"{where}.transitions[{i}]"
            for field in ("from_state", "next_state"):
                if not (t.get(field) or "").strip():
                    errors.append(f"{at}: '{field}' must not be empty")
            _pattern(errors, at, t.get("pattern"), False)
            if (t.get("action") or "EMIT").strip().upper() not in ("EMIT", "DISCARD", "COLLECT"):
                errors.append(f"{at}: 'action' must be EMIT, DISCARD or COLLECT")
        for state, action in (p.get("default_actions") or {}).items():
            if (action or "EMIT").strip().upper() not in ("EMIT", "DISCARD", "COLLECT"):
                errors.append(f"{where}.default_actions['{state}']: 'action' must be EMIT, DISCARD or COLLECT")
    return errors


def build_rule(definition: Mapping) -> Mapping:
    """The definition itself when valid; ValueError listing every problem otherwise."""
    errors = []
    if not definition.get("name"):
        errors.append("missing 'name'")
    if not definition.get("commands"):
        errors.append("'commands' must not be empty")
    for i, p in enumerate(definition.get("stages") or []):
        errors += stage_errors(f"stages[{i}]", p)
    if errors:
        raise ValueError("; ".join(errors))
    return definition


def required_capabilities(stages: list[Mapping]) -> set[str]:
    return {stage(p["strategy"]).capability for p in stages if p.get("strategy")} or {"REDUCE"}


# Stages whose vectorised helper may not sit inside a bound expression.
_UNBOUND = ("json_structure", "cat_content")


def apply_stages(text: Column, stages: list[Mapping], run: RunColumns) -> Column:
    """Chain of stages; a stage that stops hands its text past the rest.

    Every stage reads its input through one binding, so the output of the stage
    before is computed once however often the next one looks at it.
    """
    def chain(current: Column, rest: list[Mapping]) -> Column:
        if not rest:
            return current
        head, tail = rest[0], rest[1:]
        st = stage(head["strategy"])

        def go(t: Column) -> Column:
            out = st.fn(t, run, head)
            if not isinstance(out, tuple):
                return chain(out, tail)
            after, stop = out
            if not tail:
                return after
            return let(F.struct(after.alias("text"), stop.alias("stop")),
                       lambda p: F.when(p["stop"], p["text"]).otherwise(chain(p["text"], tail)))
        later = {stage(p["strategy"]).name for p in rest}
        return go(current) if later & set(_UNBOUND) else let(current, go)
    return chain(text, list(stages))


def rule_tests(tests: DataFrame, stages: list[Mapping]) -> DataFrame:
    """Inline rule tests as a job: (id, input, expected) -> passed and actual."""
    run = RunColumns(F.lit(""), F.lit(0), nn(F.col("input")), F.lit(0), F.lit(False), F.lit(True))
    out = tests.withColumn("actual", apply_stages(nn(F.col("input")), stages, run))
    return out.select("id", (F.col("actual") == F.col("expected")).alias("passed"), "actual")
