"""Tool output to tables: tests, findings, builds, resources, git state.

A run's text is one row, and its sections are cut inside the row: `blocks_at`
slices the line array at header lines, which carries a file, suite or test name
forward without a window. Results are arrays of structs that `rows` explodes, so
every job here is a narrow scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsift.functions.text import (
    any_line, contains_any, drop_first, is_blank, join_lines, last_match, let, lines_of, nn, non_blank, strip_trailing,
    strip_ws, trim_ctl,
)
from runsift.operators.reduce import (
    _aligned, _first_counts, _run_counts, ansi_strip, fold_lines, grouping, last_meaningful_line, ranked_counts,
)

# What each tool prints, and how much of it is kept.
ALL_PASSED = "✓ all tests passed"
STACK_CAP, DETAIL_CAP, BLOCK_CAP = 5, 15, 20
STACK_NOTE, DETAIL_NOTE = "    ... (stack trace omitted) ...", "    ... (detail lines omitted) ..."
PYTEST_SUMMARY, PYTEST_RULE = "short test summary", r"^=+.*=+$"
PYTEST_CASE = r"^(FAILED|ERROR)\s+(\S+)"
JEST_SUMMARY = r"^(?:Test Suites:|Tests:|Snapshots:|Time:|Ran all test suites).*$"
VITEST_FAIL, VITEST_SUMMARY = r"(?:^|\s)(?:×|✗|FAIL)(?:\s|$)", r"^Tests\s+\d+.*$"
BROWSER_FAIL, BROWSER_SUMMARY = r"^\s*\d+\)\s+(.+)$", r"^\s*\d+\s+(?:failed|passed|flaky|skipped).*$"
CALL_LOG, ATTACHMENT, DIVIDER = r"^(?:call\s+log|Call\s+log):.*$", r"^attachment\s+#\d+:.*$", r"^[─═-]{3,}$"
LINT_ISSUE = r"^\s*(\d+):\d+\s+(error|warning)\s+(.+?)\s+(\S+)\s*$"
LINT_RULE = r"\s+\d+:\d+\s+(?:error|warning)\s+.+?\s+(\S+)$"
CLIPPY_LINT, CLIPPY_WARNING = r"#\[warn\((.+?)\)\]", r"^warning: (.+)$"
RUFF_RULE, GOLANGCI_LINTER = r":\s+([A-Z]\d+)\s", r"\(([a-z][a-z0-9-]+)\)\s*$"
TSC_FILE = r"^(\S+\.ts)\("
IMAGE_ID, IMAGE_TAG = r"(?:Successfully built|writing image sha256:)\s*([0-9a-f]{8,12})", r"Successfully tagged (.+)"
IMAGE_DONE, IMAGE_ERROR, IMAGE_DONE_CAP = r"^#\d+ DONE\b", r"(?i)\bERROR\b|failed to", 30
NPM_ADDED, NPM_AUDIT, NPM_KEEP, NPM_CAP = (
    r"added (\d+) packages?", r"found (\d+) vulnerabilit", r"(?i)^npm (warn\b|err!)", 20)
COMMIT_LINE = r"(?m)^\[([^\]]+)\s+([0-9a-f]+)\]\s+(.+)$"
PUSH_TARGET, PUSH_CURRENT = r"\s+(\S+)\s+->\s+(\S+)", r"(?i)Everything up-to-date"
PORCELAIN = r"^[MADRCU?! ][MADRCU?! ] "
RESOURCE_ADDRESS = (r"^(?:module\.[A-Za-z0-9_-]+(?:\[[^\]]+\])?\.)*(?:data\.)?(?:[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+"
                    r"|[A-Za-z][A-Za-z0-9_]*)\.[A-Za-z0-9_-]+(?:\[[^\]]+\])?$")
MODULE_PREFIX = r"^(?:module\.[A-Za-z0-9_-]+(?:\[[^\]]+\])?\.)+"
ADDRESS_SHARE, RESOURCE_TOP, RESOURCE_CAP = 0.80, 20, 2000
PLAN_MODULE = "terraform.ui"
BUILD_LINES = {"gradle": 15, "mvn": 20, "make": 15, "cargo-install": 15}
VALIDATE_CHARS, JSON_MAX_DEPTH = 1_048_576, 8


@dataclass(frozen=True)
class Limits:
    """Most JSON objects, changes and diagnostics of a plan, and characters of one of its lines; None: all of them."""
    objects: int | None = None
    rows: int | None = None
    diagnostics: int | None = None
    line_chars: int | None = None


ALL = Limits()
#: Sizes of the plan that is rendered as text, and of ``plan_events`` unless it is told otherwise.
REPORT = Limits(10_000, 1_000, 200, VALIDATE_CHARS)

_STR = "array<string>"
_CASE = "array<struct<suite:string,name:string,status:string,detail:string>>"


def empty(kind: str = _STR) -> Column:
    return F.array().cast(kind)


def blocks_at(lines: Column, header: Callable[[Column], Column]) -> Column:
    """Slices of ``lines`` that each begin at a header line and end before the next."""
    starts = F.array_compact(F.transform(lines, lambda x, i: F.when(header(x), i + 1)))
    return let(F.struct(lines.alias("l"), starts.alias("s")), lambda p: F.transform(
        p["s"], lambda s, j: F.slice(p["l"], s, F.coalesce(F.get(p["s"], j + 1), F.size(p["l"]) + 1) - s)))


def rows(df: DataFrame, column: Column, key: str = "run_id") -> DataFrame:
    """One row per struct of an array column, with its position."""
    ex = df.select(key, F.posexplode(column).alias("seq", "_r"))
    fields = ex.schema["_r"].dataType.names
    return ex.select(key, "seq", *[F.col("_r")[f].alias(f) for f in fields])


def _int(col: Column) -> Column:
    return F.coalesce(col.try_cast("int"), F.lit(0))


def last_int(lines: Column, pattern: str) -> Column:
    return _int(last_match(lines, pattern, 1))


def _case(suite: Column, name: Column, status: str, detail: Column) -> Column:
    return F.struct(suite.alias("suite"), name.alias("name"), F.lit(status).alias("status"), detail.alias("detail"))


def _counts(passed: Column, failed: Column, errors: Column, skipped: Column, total: Column) -> Column:
    return F.struct(passed.alias("passed"), failed.alias("failed"), errors.alias("errors"),
                    skipped.alias("skipped"), total.alias("total"))


def capped_details(lines: Column, other_cap: int | None) -> Column:
    """Indented detail lines: five stack lines, optionally a cap on the others, one note each."""
    def is_stack(x: Column) -> Column:
        return trim_ctl(x).startswith("at ") | x.rlike(r"^\s+at\s+.*$")

    def build(p: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            text = F.concat(F.lit("    "), trim_ctl(x))
            keep = lambda cut, note: F.when(cut.isNull() | (i + 1 < cut), text).when(i + 1 == cut, F.lit(note))
            other = keep(p["o"], DETAIL_NOTE) if other_cap is not None else text
            return F.when(is_stack(x), keep(p["s"], STACK_NOTE)).otherwise(other)
        return F.array_compact(F.transform(p["l"], row))

    stack = F.array_compact(F.transform(lines, lambda x, i: F.when(is_stack(x), i + 1)))
    other = F.array_compact(F.transform(lines, lambda x, i: F.when(~is_stack(x), i + 1)))
    cut_o = F.get(other, F.lit(other_cap)) if other_cap is not None else F.lit(None).cast("int")
    return let(F.struct(lines.alias("l"), F.get(stack, F.lit(STACK_CAP)).alias("s"), cut_o.alias("o")), build)


def bounded_block(lines: Column) -> Column:
    """First twenty lines and a note about the rest."""
    return let(lines, lambda ls: F.when(F.size(ls) <= BLOCK_CAP, ls).otherwise(F.concat(
        F.slice(ls, 1, BLOCK_CAP), F.array(F.format_string("    ... (%d lines omitted) ...", F.size(ls) - BLOCK_CAP)))))


# --- E1 pytest ---------------------------------------------------------------------

def pytest_lines(text: Column) -> Column:
    """Case lines of the short summary and the rule lines that carry counts."""
    def short(x: Column) -> Column:
        return x.rlike(PYTEST_SUMMARY)

    def build(bs: Column) -> Column:
        def out(b: Column, j: Column) -> Column:
            head = F.element_at(b, 1)
            after_short = F.coalesce(short(F.get(F.get(bs, j - 1), F.lit(0))), F.lit(False))
            counted = contains_any(head, ["passed", "failed", "error"])
            cases = F.transform(F.filter(drop_first(b, 1), lambda x: x.rlike(r"^(?:FAILED|ERROR)\s+")), lambda x: trim_ctl(x))
            return F.when(short(head), cases).when(after_short | counted, F.array(trim_ctl(head))).otherwise(empty())
        return F.flatten(F.transform(bs, out))
    return let(blocks_at(lines_of(nn(text)), lambda x: short(x) | x.rlike(PYTEST_RULE)), build)


def pytest_cases(text: Column) -> Column:
    hits = F.filter(pytest_lines(text), lambda x: x.rlike(PYTEST_CASE))
    return F.transform(hits, lambda x: F.struct(
        F.lit("").alias("suite"), F.regexp_extract(x, PYTEST_CASE, 2).alias("name"),
        F.when(x.startswith("FAILED"), "failed").otherwise("error").alias("status"), x.alias("detail")))


def pytest_counts(text: Column) -> Column:
    zero = F.lit(0)
    return let(pytest_lines(text), lambda ls: _counts(
        last_int(ls, r"(\d+)\s+passed"), last_int(ls, r"(\d+)\s+failed"), last_int(ls, r"(\d+)\s+error"), zero, zero))


def pytest_text(text: Column) -> Column:
    tail = F.coalesce(F.try_element_at(non_blank(lines_of(nn(text))), F.lit(-1)), F.lit(ALL_PASSED))
    return let(pytest_lines(text), lambda ls: F.when(F.size(ls) == 0, tail).otherwise(join_lines(ls)))


# --- E2 cargo test ------------------------------------------------------------------

def _cargo_failed(x: Column) -> Column:
    return x.startswith("test ") & x.contains("...") & x.endswith("FAILED")


def cargo_failures(text: Column) -> Column:
    return F.transform(F.filter(lines_of(nn(text)), _cargo_failed),
                       lambda x: F.substring_index(F.substring(x, F.lit(6), F.length(x)), " ...", 1))


def cargo_result(text: Column) -> Column:
    hits = F.filter(lines_of(nn(text)), lambda x: ~_cargo_failed(x) & x.startswith("test result: ") & (
        x.contains("ok.") | x.contains("FAILED.")))
    return trim_ctl(F.try_element_at(hits, F.lit(-1)))


def cargo_errors(text: Column) -> Column:
    return F.slice(F.filter(lines_of(nn(text)), lambda x: x.startswith("error") | x.startswith("  -->")), 1, 10)


def cargo_compile_error(text: Column, exit_code: Column) -> Column:
    compiling = any_line(lines_of(nn(text)), lambda x: trim_ctl(x).startswith("Compiling "))
    return (F.size(cargo_failures(text)) == 0) & (exit_code != 0) & compiling


def cargo_cases(text: Column) -> Column:
    return F.transform(cargo_failures(text), lambda n: _case(F.lit(""), n, "FAILED", F.concat(F.lit("FAILED: "), n)))


def cargo_counts(text: Column) -> Column:
    line = F.array(F.coalesce(cargo_result(text), F.lit("")))
    return let(F.struct(line.alias("r"), F.size(cargo_failures(text)).alias("n")), lambda p: let(
        F.struct(last_int(p["r"], r"(\d+)\s+passed").alias("ok"), F.greatest(p["n"], last_int(p["r"], r"(\d+)\s+failed")).alias("bad"),
                 last_int(p["r"], r"(\d+)\s+ignored").alias("skip")),
        lambda c: _counts(c["ok"], c["bad"], F.lit(0), c["skip"], c["ok"] + c["bad"] + c["skip"])))


def cargo_text(text: Column, exit_code: Column) -> Column:
    def build(p: Column) -> Column:
        listed = join_lines(F.transform(p["f"], lambda n: F.concat(F.lit("  FAILED: "), n)))
        bad = strip_trailing(F.concat(F.format_string("cargo test: %d failure(s)\n", F.size(p["f"])), listed,
                                      F.lit("\n"), F.coalesce(p["r"], F.lit(""))))
        compile_ = F.concat(F.lit("cargo test: compile error\n"), join_lines(cargo_errors(text)))
        return F.when(F.size(p["f"]) > 0, bad).when(cargo_compile_error(text, exit_code), compile_).otherwise(
            F.coalesce(p["r"], F.lit(ALL_PASSED)))
    return let(F.struct(cargo_failures(text).alias("f"), cargo_result(text).alias("r")), build)


# --- E5 jest ----------------------------------------------------------------------------

def jest_cases(text: Column) -> Column:
    def top(x: Column) -> Column:
        return ~x.rlike(r"^[ \t]")

    def header(x: Column) -> Column:
        return (top(x) & x.rlike(r"^(?:FAIL|PASS)\s+.+$")) | trim_ctl(x).rlike(JEST_SUMMARY)

    def suite(b: Column) -> Column:
        name = trim_ctl(F.regexp_extract(F.element_at(b, 1), r"^FAIL\s+(.+)$", 1))
        body = F.filter(drop_first(b, 1), lambda x: trim_ctl(x) != "")

        def failure(f: Column) -> Column:
            title = F.regexp_replace(trim_ctl(F.element_at(f, 1)), r"^●\s*", "")
            return _case(name, title, "FAILED", join_lines(capped_details(drop_first(f, 1), DETAIL_CAP)))
        found = F.transform(blocks_at(body, lambda x: trim_ctl(x).startswith("●")), failure)
        return F.when(F.size(found) > 0, found).otherwise(F.array(_case(name, F.lit("(suite error)"), "FAILED", F.lit(""))))

    blocks = blocks_at(lines_of(ansi_strip(text)), header)
    return F.flatten(F.transform(F.filter(blocks, lambda b: F.element_at(b, 1).startswith("FAIL") & top(F.element_at(b, 1))),
                                 suite))


def jest_summary_lines(text: Column) -> Column:
    ls = F.transform(lines_of(ansi_strip(text)), lambda x: trim_ctl(x))
    return F.filter(ls, lambda x: x.startswith("Test Suites:") | x.startswith("Tests:"))


def _max_int(lines: Column, pattern: str, floor: Column) -> Column:
    found = F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1).try_cast("int"))
    return F.greatest(floor, F.coalesce(F.array_max(found), F.lit(0)))


def _last_or(lines: Column, pattern: str, default: Column) -> Column:
    return F.coalesce(last_match(lines, pattern, 1).try_cast("int"), default)


def jest_counts(text: Column) -> Column:
    return let(F.struct(jest_summary_lines(text).alias("s"), F.size(jest_cases(text)).alias("n")), lambda p: _counts(
        last_int(p["s"], r"(\d+)\s+passed"), _max_int(p["s"], r"(\d+)\s+failed", p["n"]), F.lit(0), F.lit(0),
        _last_or(p["s"], r"(\d+)\s+total", p["n"])))


def _status_text(failures: Column, summary: Column, text: Column, exit_code: Column, body: Column) -> Column:
    """Shared frame: nothing found, only a clean summary, or the failures."""
    return (F.when((F.size(failures) == 0) & (F.size(summary) == 0) & (exit_code == 0), F.lit(ALL_PASSED))
            .when((F.size(failures) == 0) & (F.size(summary) == 0), text)
            .when((F.size(failures) == 0) & (exit_code == 0), join_lines(summary))
            .otherwise(strip_trailing(body)))


def _with_detail(head: Column, detail: Column) -> Column:
    return F.when(detail == "", head).otherwise(F.concat(head, F.lit("\n"), detail))


def jest_text(text: Column, exit_code: Column) -> Column:
    def build(p: Column) -> Column:
        suites = F.array_distinct(F.transform(p["c"], lambda c: c["suite"]))

        def one(s: Column) -> Column:
            own = F.filter(p["c"], lambda c: c["suite"] == s)
            return F.concat(F.lit("  FAIL: "), s, F.lit("\n"), join_lines(F.transform(own, lambda c: _with_detail(
                F.concat(F.lit("  ● "), c["name"]), c["detail"]))))
        head = F.when(F.size(suites) > 0, F.concat(F.format_string("jest: %d suite(s) failed\n", F.size(suites)),
                                                   join_lines(F.transform(suites, one)), F.lit("\n"))).otherwise(F.lit(""))
        return _status_text(p["c"], p["s"], nn(text), exit_code, F.concat(head, join_lines(p["s"])))
    return let(F.struct(jest_cases(text).alias("c"), jest_summary_lines(text).alias("s")), build)


# --- E6 vitest ----------------------------------------------------------------------------

def _vitest_fail(x: Column) -> Column:
    return x.rlike(VITEST_FAIL) & ~x.contains("passed") & (trim_ctl(x) != "")


def vitest_cases(text: Column) -> Column:
    def header(x: Column) -> Column:
        t = trim_ctl(x)
        return _vitest_fail(x) | t.startswith("✓") | t.startswith("❯") | t.rlike(VITEST_SUMMARY)

    def failure(b: Column) -> Column:
        body = F.filter(drop_first(b, 1), lambda x: (trim_ctl(x) != "") & ~trim_ctl(x).startswith("RUN "))
        return _case(F.lit(""), trim_ctl(F.element_at(b, 1)), "FAILED", join_lines(bounded_block(capped_details(body, None))))
    blocks = blocks_at(lines_of(nn(text)), header)
    return F.transform(F.filter(blocks, lambda b: _vitest_fail(F.element_at(b, 1))), failure)


def vitest_summary_lines(text: Column) -> Column:
    plain = F.filter(lines_of(nn(text)), lambda x: ~_vitest_fail(x))
    return F.filter(F.transform(plain, lambda x: trim_ctl(x)),
                    lambda t: ~t.startswith("✓") & ~t.startswith("❯") & t.rlike(VITEST_SUMMARY))


def vitest_counts(text: Column) -> Column:
    def build(p: Column) -> Column:
        ok, skip = last_int(p["s"], r"(\d+)\s+passed"), last_int(p["s"], r"(\d+)\s+skipped")
        bad = _max_int(p["s"], r"(\d+)\s+failed", p["n"])
        return _counts(ok, bad, F.lit(0), skip, F.greatest(_last_or(p["s"], r"\((\d+)\)", p["n"]), ok + bad + skip))
    return let(F.struct(vitest_summary_lines(text).alias("s"), F.size(vitest_cases(text)).alias("n")), build)


def vitest_text(text: Column, exit_code: Column) -> Column:
    def build(p: Column) -> Column:
        shown = F.transform(F.slice(p["c"], 1, BLOCK_CAP), lambda c: _with_detail(F.concat(F.lit("  "), c["name"]), c["detail"]))
        head = F.when(F.size(p["c"]) > 0, F.concat(F.format_string("vitest: %d failure(s)\n", F.size(p["c"])),
                                                   join_lines(shown), F.lit("\n"))).otherwise(F.lit(""))
        return _status_text(p["c"], p["s"], nn(text), exit_code, F.concat(head, join_lines(p["s"])))
    return let(F.struct(vitest_cases(text).alias("c"), vitest_summary_lines(text).alias("s")), build)


# --- E7 browser tests -----------------------------------------------------------------------

def browser_cases(text: Column) -> Column:
    """Numbered failures without call logs and attachments."""
    def step(state: Column, line: Column):
        t, mode = trim_ctl(line), state["mode"]
        in_call = (mode == "call") & (t.startswith("- ") | t.startswith("waiting for") | line.startswith("    "))
        in_file = (mode == "file") & (t.endswith(".png") | t.endswith(".zip") | t.startswith("test-results/"))
        reset, call = (t == "") | t.rlike(DIVIDER), t.rlike(CALL_LOG)
        # an attachment list may follow directly on the end of a call log
        attach = t.rlike(ATTACHMENT)
        nxt = F.when(reset, "").when(call, "call").when(in_call, "call").when(attach, "file").when(in_file, "file").otherwise("")
        drop = reset | call | in_call | attach | in_file | t.startswith("✓")
        return {"mode": nxt}, F.when(drop, empty()).otherwise(F.array(line))

    def failure(b: Column) -> Column:
        title = strip_trailing(F.regexp_replace(F.element_at(b, 1), r"[─═-]+$", ""))
        body = let(fold_lines(drop_first(b, 1), {"mode": F.lit("")}, step), lambda r: r["out"])
        return _case(F.lit(""), title, "FAILED", join_lines(bounded_block(capped_details(body, None))))

    blocks = blocks_at(lines_of(nn(text)), lambda x: x.rlike(BROWSER_FAIL) | x.rlike(BROWSER_SUMMARY))
    return F.transform(F.filter(blocks, lambda b: F.element_at(b, 1).rlike(BROWSER_FAIL)), failure)


def browser_summary_lines(text: Column) -> Column:
    return F.transform(F.filter(lines_of(nn(text)), lambda x: x.rlike(BROWSER_SUMMARY) & ~x.rlike(BROWSER_FAIL)),
                       lambda x: strip_trailing(x))


def browser_counts(text: Column) -> Column:
    def build(p: Column) -> Column:
        ok, bad = last_int(p["s"], r"(\d+)\s+passed"), _max_int(p["s"], r"(\d+)\s+failed", p["n"])
        skip = F.aggregate(p["s"], F.lit(0), lambda a, x: a + _int(F.regexp_extract(x, r"(\d+)\s+(?:skipped|flaky)", 1)))
        return let(skip, lambda k: _counts(ok, bad, F.lit(0), k, ok + bad + k))
    return let(F.struct(browser_summary_lines(text).alias("s"), F.size(browser_cases(text)).alias("n")), build)


def browser_text(text: Column, exit_code: Column) -> Column:
    def build(p: Column) -> Column:
        shown = join_lines(F.transform(p["c"], lambda c: _with_detail(c["name"], c["detail"])))
        gap = F.when((F.size(p["c"]) > 0) & (F.size(p["s"]) > 0), F.lit("\n")).otherwise(F.lit(""))
        return _status_text(p["c"], p["s"], nn(text), exit_code, F.concat(shown, gap, join_lines(p["s"])))
    return let(F.struct(browser_cases(text).alias("c"), browser_summary_lines(text).alias("s")), build)


# --- E8, E9 lint findings ---------------------------------------------------------------------

LINT_JSON = ("array<struct<filePath:string,errorCount:bigint,warningCount:bigint,"
             "messages:array<struct<ruleId:string,severity:int,message:string,line:int>>>>")


def lint_json(text: Column) -> Column:
    """Parsed report or NULL when the text is not a JSON array."""
    return let(trim_ctl(nn(text)), lambda t: F.when(t.startswith("["), F.from_json(t, LINT_JSON)))


def lint_json_findings(text: Column) -> Column:
    def of_file(f: Column) -> Column:
        return F.transform(F.coalesce(f["messages"], F.array()), lambda m: F.struct(
            F.coalesce(f["filePath"], F.lit("")).alias("file"), m["line"].alias("line"),
            F.coalesce(m["ruleId"], F.lit("unknown")).alias("code"), F.coalesce(m["message"], F.lit("")).alias("message"),
            F.when(F.coalesce(m["severity"], F.lit(1)) >= 2, "error").otherwise("warning").alias("severity")))
    return F.flatten(F.transform(lint_json(text), of_file))


def lint_json_totals(text: Column) -> Column:
    def add(files: Column, field: str) -> Column:
        return F.aggregate(files, F.lit(0).cast("bigint"), lambda a, f: a + F.coalesce(f[field], F.lit(0)))
    return let(lint_json(text), lambda files: F.struct(add(files, "errorCount").alias("errors"), add(files, "warningCount").alias("warnings")))


def lint_text_findings(text: Column) -> Column:
    """Issue lines with the file name of the header above them."""
    mark = "\u0001"

    def header(x: Column) -> Column:
        name = ~is_blank(x) & ~x.rlike(LINT_ISSUE) & ~x.contains("  error  ") & ~x.contains("  warning  ")
        return (x == mark) | (name & ~x.startswith("✖") & ~x.startswith("✓"))

    def of_block(b: Column) -> Column:
        head = F.element_at(b, 1)
        file = F.when(head == mark, "").otherwise(strip_ws(head))
        return F.transform(F.filter(b, lambda x: x.rlike(LINT_ISSUE)), lambda x: F.struct(
            file.alias("file"), F.regexp_extract(x, LINT_ISSUE, 1).try_cast("int").alias("line"),
            F.regexp_extract(x, LINT_ISSUE, 4).alias("code"), strip_ws(F.regexp_extract(x, LINT_ISSUE, 3)).alias("message"),
            F.regexp_extract(x, LINT_ISSUE, 2).alias("severity")))
    lines = F.concat(F.array(F.lit(mark)), lines_of(nn(text)))
    return F.flatten(F.transform(blocks_at(lines, header), of_block))


def lint_text_totals(text: Column) -> Column:
    ls = lines_of(nn(text))
    return F.struct(F.size(F.filter(ls, lambda x: x.contains("  error  "))).cast("bigint").alias("errors"),
                    F.size(F.filter(ls, lambda x: x.contains("  warning  "))).cast("bigint").alias("warnings"))


def lint_text_summary(text: Column, exit_code: Column) -> Column:
    """The JSON report when there is one, else the text report."""
    def head(t: Column) -> Column:
        return F.concat(F.lit("eslint: "), t["errors"].cast("string"), F.lit(" error(s), "), t["warnings"].cast("string"),
                        F.lit(" warning(s)"))

    def from_json(p: Column) -> Column:
        ranked = ranked_counts(F.transform(p["f"], lambda f: f["code"]))
        groups = join_lines(F.transform(ranked, lambda c: F.concat(F.lit("  "), c["key"], F.lit(": "), (-c["neg"]).cast("string"))))
        clean = (p["t"]["errors"] == 0) & (p["t"]["warnings"] == 0)
        return F.when(clean, F.lit("✓ no lint issues")).otherwise(strip_trailing(_with_detail(head(p["t"]), groups)))

    def from_text(t: Column) -> Column:
        clean = (t["errors"] == 0) & (t["warnings"] == 0) & (exit_code == 0)
        return F.when(clean, F.lit("✓ no lint issues")).otherwise(
            strip_trailing(_with_detail(head(t), grouping(text, LINT_RULE))))
    report = let(F.struct(lint_json_totals(text).alias("t"), lint_json_findings(text).alias("f")), from_json)
    return F.when(lint_json(text).isNotNull(), report).otherwise(let(lint_text_totals(text), from_text))


# --- E10, E11 counts ----------------------------------------------------------------------------

def lint_pattern(tool: str, text: Column) -> Column:
    if tool == "clippy":
        named = any_line(lines_of(nn(text)), lambda x: x.rlike(CLIPPY_LINT))
        return F.when(named, F.lit(CLIPPY_LINT)).otherwise(F.lit(CLIPPY_WARNING))
    return F.lit({"ruff": RUFF_RULE, "golangci": GOLANGCI_LINTER}[tool])


def count_lint_rules(df: DataFrame, tool: str, key: str = "run_id") -> DataFrame:
    """(run_id, key, cnt, rank) of rule names; the counts combine on the map side."""
    src = df.select(key, lint_pattern(tool, F.col("text")).alias("_p"), F.explode(lines_of(nn(F.col("text")))).alias("line"))
    name = trim_ctl(F.call_function("regexp_extract", F.col("line"), F.col("_p"), F.lit(1)))
    counts = src.where(F.rlike("line", F.col("_p"))).groupBy(key, name.alias("key")).agg(F.count("*").alias("cnt"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("cnt"), "key")))


# Heading and clean text of the counting linters.
LINT_HEADS = {"clippy": ("cargo clippy: %d warning(s)\n", "✓ no clippy warnings"),
              "ruff": ("ruff: %d issue(s)\n", "✓ no lint issues"),
              "golangci": ("golangci-lint: %d issue(s)\n", "✓ no lint issues")}


def lint_count_text(tool: str, text: Column, exit_code: Column) -> Column:
    head, clean = LINT_HEADS[tool]

    def build(p: Column) -> Column:
        keys = F.transform(F.filter(p["l"], lambda x: F.rlike(x, p["p"])),
                           lambda x: trim_ctl(F.call_function("regexp_extract", x, p["p"], F.lit(1))))
        return let(keys, lambda k: F.when((F.size(k) == 0) & (exit_code == 0), F.lit(clean)).otherwise(
            strip_trailing(F.concat(F.format_string(head, F.size(k)), let(_run_counts(k), _aligned)))))
    return let(F.struct(lines_of(nn(text)).alias("l"), lint_pattern(tool, text).alias("p")), build)


def count_type_errors(df: DataFrame, key: str = "run_id") -> DataFrame:
    """Errors per source file, files in the order they first appear."""
    src = df.select(key, F.posexplode(lines_of(nn(F.col("text")))).alias("line_no", "line"))
    counts = src.where(F.col("line").rlike(TSC_FILE)).groupBy(key, F.regexp_extract("line", TSC_FILE, 1).alias("file")).agg(
        F.count("*").alias("cnt"), F.min("line_no").alias("_first"))
    return counts.select(key, "file", "cnt", F.row_number().over(W.partitionBy(key).orderBy("_first")).alias("rank"))


def type_error_text(text: Column, exit_code: Column) -> Column:
    files = F.transform(F.filter(lines_of(nn(text)), lambda x: x.rlike(TSC_FILE)), lambda x: F.regexp_extract(x, TSC_FILE, 1))

    def build(fs: Column) -> Column:
        counts = F.array_sort(F.transform(_first_counts(fs), lambda c: F.struct(
            c["pos"].alias("pos"), c["key"].alias("key"), c["neg"].alias("neg"))))
        body = join_lines(F.transform(counts, lambda c: F.concat(F.lit("  "), c["key"], F.lit(": "), (-c["neg"]).cast("string"))))
        return F.when((F.size(fs) == 0) & (exit_code == 0), F.lit("✓ no type errors")).otherwise(
            strip_trailing(F.concat(F.format_string("tsc: %d error(s)\n", F.size(fs)), body)))
    return let(files, build)


# --- E12 builds -------------------------------------------------------------------------------

def build_status(tool: str, text: Column, exit_code: Column, command: Column | None = None) -> Column:
    """struct(status, errors, text): text is what a reader sees, with the first BUILD_LINES error lines; errors counts all."""
    t = nn(text)
    ls = lines_of(t)
    most = BUILD_LINES[tool]

    def out(status: Column, errors: Column, shown: Column) -> Column:
        return F.struct(status.alias("status"), errors.cast("int").alias("errors"), shown.alias("text"))

    if tool == "gradle":
        ok, bad = t.contains("BUILD SUCCESSFUL"), t.contains("BUILD FAILED")
        details = F.filter(ls, lambda x: x.startswith("> ") | x.startswith("FAILURE:"))
        first = trim_ctl(F.try_element_at(F.filter(ls, lambda x: x.contains("BUILD SUCCESSFUL")), F.lit(1)))
        return let(details, lambda d: out(
            F.when(ok, "SUCCESS").when(bad, "FAILED").otherwise("UNKNOWN"),
            F.when(bad, F.greatest(F.lit(1), F.when(ok, 0).otherwise(F.size(d)))).otherwise(0),
            F.when(ok, F.concat(F.lit("✓ "), first)).when(bad, F.concat(F.lit("✗ BUILD FAILED\n"), join_lines(F.slice(d, 1, most)))).otherwise(t)))
    if tool == "mvn":
        ok, bad = t.contains("BUILD SUCCESS"), t.contains("BUILD FAILURE")
        errors = F.transform(F.filter(ls, lambda x: x.startswith("[ERROR]") | x.rlike(r"Tests run:.+Failures: [1-9]")), lambda x: trim_ctl(x))
        tests = trim_ctl(F.coalesce(F.try_element_at(F.filter(ls, lambda x: x.contains("Tests run:")), F.lit(-1)), F.lit("")))
        return let(errors, lambda e: out(
            F.when(ok, "SUCCESS").when(bad, "FAILURE").otherwise("UNKNOWN"),
            F.size(e),
            F.when(ok, F.concat(F.lit("✓ BUILD SUCCESS"), F.when(tests == "", "").otherwise(F.concat(F.lit(" — "), tests))))
            .when(bad, F.concat(F.lit("✗ BUILD FAILURE\n"), join_lines(F.slice(e, 1, most)))).otherwise(t)))
    if tool == "make":
        errors = F.filter(ls, lambda x: x.startswith("make") | x.contains("Error") | x.contains("error:"))
        tail = trim_ctl(F.coalesce(F.try_element_at(non_blank(ls), F.lit(-1)), F.lit("done")))
        bad = exit_code != 0
        return let(errors, lambda e: out(
            F.when(bad, "FAILED").otherwise("SUCCESS"), F.when(bad, F.greatest(F.lit(1), F.size(e))).otherwise(0),
            F.when(bad & (F.size(e) == 0), t).when(bad, join_lines(F.slice(e, 1, most))).otherwise(F.concat(F.lit("✓ make: "), tail))))
    if tool == "cargo-install":
        errors = F.filter(ls, lambda x: x.rlike(r"^error(\[.+?\])?:"))
        finished = F.regexp_extract(t, r"Finished .+ in (.+)", 0)
        words = F.split(nn(command if command is not None else F.lit("")), " ")
        verb = F.when(F.size(words) > 1, F.concat(F.get(words, 1), F.lit(" complete"))).otherwise(F.lit("complete"))
        bad = exit_code != 0
        return let(errors, lambda e: out(
            F.when(bad, "FAILED").otherwise("SUCCESS"), F.when(bad, F.size(e)).otherwise(0),
            F.when(bad & (F.size(e) == 0), t).when(bad, join_lines(F.slice(e, 1, most))).when(
                finished != "", F.concat(F.lit("✓ "), trim_ctl(finished))).otherwise(F.concat(F.lit("✓ "), verb))))
    raise ValueError(f"unknown build tool: {tool}")


# --- E13 image builds, E14 dependencies ----------------------------------------------------------

def image_build(text: Column, exit_code: Column) -> Column:
    """struct(status, image_id, tag, lines) of an image build."""
    def kept(ls: Column) -> Column:
        done = F.array_compact(F.transform(ls, lambda x, i: F.when(x.rlike(IMAGE_DONE), i + 1)))
        return let(F.get(done, F.lit(IMAGE_DONE_CAP)), lambda cut: F.filter(ls, lambda x, i: (
            x.rlike(IMAGE_DONE) & (cut.isNull() | (i + 1 < cut))) | x.rlike(IMAGE_ERROR)))

    def build(p: Column) -> Column:
        bad = exit_code != 0
        image, tag = last_match(p["l"], IMAGE_ID, 1), trim_ctl(last_match(p["l"], IMAGE_TAG, 1))
        last = F.concat(F.lit("✓ docker build"), F.coalesce(F.concat(F.lit(": "), image), F.lit("")),
                        F.coalesce(F.concat(F.lit(" → "), tag), F.lit("")))
        shown = F.when(bad & (F.size(p["k"]) > 0), F.concat(p["k"], F.array(F.lit("docker build failed")))).when(
            bad, p["k"]).otherwise(F.concat(p["k"], F.array(last)))
        return F.struct(F.when(bad, "FAILED").otherwise("SUCCESS").alias("status"), image.alias("image_id"), tag.alias("tag"),
                        join_lines(shown).alias("text"))
    return let(lines_of(nn(text)), lambda ls: let(F.struct(ls.alias("l"), kept(ls).alias("k")), build))


def npm_status(text: Column, exit_code: Column) -> Column:
    def build(ls: Column) -> Column:
        keep = F.slice(F.filter(ls, lambda x: x.rlike(NPM_KEEP)), 1, NPM_CAP)
        added, audit = last_match(ls, NPM_ADDED, 1), last_match(ls, NPM_AUDIT, 0)
        bad = exit_code != 0
        done = F.concat(F.lit("✓ npm install"), F.coalesce(F.concat(F.lit(": "), added, F.lit(" packages")), F.lit("")),
                        F.coalesce(F.concat(F.lit(" | "), audit), F.lit("")))
        shown = F.when(bad & (F.size(keep) > 0), F.concat(keep, F.array(F.lit("npm install failed")))).when(bad, keep).otherwise(
            F.concat(keep, F.array(done)))
        return F.struct(added.try_cast("int").alias("added"), last_match(ls, NPM_AUDIT, 1).try_cast("int").alias("vulnerabilities"),
                        F.coalesce(audit, F.lit("")).alias("vulnerability_text"), join_lines(keep).alias("irrevocable"),
                        bad.alias("failed"), join_lines(shown).alias("text"))
    return let(lines_of(nn(text)), build)


def pip_text(text: Column) -> Column:
    hit = F.try_element_at(F.filter(lines_of(nn(text)), lambda x: x.startswith("Successfully installed")), F.lit(-1))
    tail = last_meaningful_line(text)
    return F.coalesce(trim_ctl(hit), F.when(is_blank(tail), F.lit("✓ pip install")).otherwise(tail))


# --- E15, E16 git -------------------------------------------------------------------------------

def git_status(text: Column) -> Column:
    """struct(branch, clean, staged, modified, untracked) from either status format."""
    def state(branch: Column, clean: Column, staged: Column, modified: Column, untracked: Column) -> Column:
        return F.struct(branch.alias("branch"), clean.alias("clean"), staged.alias("staged"), modified.alias("modified"),
                        untracked.alias("untracked"))

    def porcelain(ls: Column) -> Column:
        rows_ = F.filter(ls, lambda x: F.length(x) >= 3)
        path = lambda x: F.substring(x, F.lit(4), F.length(x))
        new = lambda x: x.startswith("??")
        col = lambda x, k: F.substring(x, k, 1)
        untracked = F.transform(F.filter(rows_, new), path)
        staged = F.transform(F.filter(rows_, lambda x: ~new(x) & ~col(x, 1).isin(" ", "?")), path)
        modified = F.transform(F.filter(rows_, lambda x: ~new(x) & ~col(x, 2).isin(" ", "?")), path)
        return let(F.struct(staged.alias("s"), modified.alias("m"), untracked.alias("u")), lambda p: state(
            F.lit(""), F.size(p["s"]) + F.size(p["m"]) + F.size(p["u"]) == 0, p["s"], p["m"], p["u"]))

    heads = {"staged": "Changes to be committed:", "modified": "Changes not staged for commit:", "untracked": "Untracked files:"}

    def human(ls: Column) -> Column:
        on = last = F.try_element_at(F.filter(ls, lambda x: x.startswith("On branch ") | x.startswith("HEAD detached at ")), F.lit(1))
        branch = F.when(on.startswith("On branch "), trim_ctl(F.substring(last, F.lit(11), F.length(last)))).otherwise(
            F.concat(F.lit("detached@"), trim_ctl(F.substring(last, F.lit(18), F.length(last)))))
        blocks = blocks_at(ls, lambda x: (x == "") | x.startswith(heads["staged"]) | x.startswith(heads["modified"]) | x.startswith(heads["untracked"]))

        def file_of(x: Column) -> Column:
            f = trim_ctl(F.substring(x, F.lit(2), F.length(x)))
            at = F.instr(f, ":")
            return F.when((at > 0) & (at < F.length(f)), trim_ctl(F.substring(f, at + 1, F.length(f)))).otherwise(f)

        def section(bs: Column, head: str) -> Column:
            own = F.flatten(F.filter(bs, lambda b: F.element_at(b, 1).startswith(head)))
            return F.transform(F.filter(own, lambda x: x.startswith("\t")), file_of)
        clean = any_line(ls, lambda x: x.rlike("(?i)nothing to commit"))
        return let(blocks, lambda bs: state(F.coalesce(branch, F.lit("")), clean, section(bs, heads["staged"]),
                                            section(bs, heads["modified"]), section(bs, heads["untracked"])))
    return let(lines_of(nn(text)), lambda ls: F.when(F.forall(F.slice(ls, 1, 5), lambda x: x.rlike(PORCELAIN)), porcelain(ls)).otherwise(human(ls)))


def git_status_text(text: Column) -> Column:
    def build(s: Column) -> Column:
        prefix = F.when(s["branch"] == "", "").otherwise(F.concat(F.lit("["), s["branch"], F.lit("] ")))
        parts = F.array_compact(F.array(*[
            F.when(F.size(s[k]) > 0, F.concat(F.lit(f"{k}: "), F.size(s[k]).cast("string"))) for k in ("staged", "modified", "untracked")]))
        body = F.when(s["clean"] | (F.size(parts) == 0), F.lit("✓ clean")).otherwise(F.array_join(parts, " | "))
        return F.concat(prefix, body)
    return let(git_status(text), build)


def git_commit(text: Column) -> Column:
    t = nn(text)
    hit = t.rlike(COMMIT_LINE)
    return F.struct(F.when(hit, trim_ctl(F.regexp_extract(t, COMMIT_LINE, 1))).otherwise("").alias("branch"),
                    F.when(hit, F.substring(F.regexp_extract(t, COMMIT_LINE, 2), 1, 8)).alias("hash"),
                    F.when(hit, trim_ctl(F.regexp_extract(t, COMMIT_LINE, 3))).alias("message"))


def git_commit_text(text: Column, ultra_compact: Column) -> Column:
    return let(git_commit(text), lambda c: F.when(c["hash"].isNull(), F.lit("✓ committed")).when(
        ultra_compact, F.concat(F.lit("["), c["branch"], F.lit("] "), c["hash"], F.lit(" "), c["message"])).otherwise(
            F.concat(F.lit("✓ committed ["), c["branch"], F.lit("] "), c["hash"], F.lit(" — "), c["message"])))


def git_push_text(text: Column, exit_code: Column) -> Column:
    t = nn(text)
    return F.when(t.rlike(PUSH_CURRENT), F.lit("✓ up-to-date (nothing pushed)")).when(
        t.rlike(PUSH_TARGET), F.concat(F.lit("✓ pushed → "), trim_ctl(F.regexp_extract(t, PUSH_TARGET, 2)))).when(
            exit_code == 0, F.lit("✓ pushed")).otherwise(t)


def git_add_text(text: Column) -> Column:
    n = F.size(non_blank(lines_of(nn(text))))
    return F.when(n == 0, F.lit("✓ staged")).otherwise(F.concat(F.lit("✓ staged "), n.cast("string"), F.lit(" file(s)")))


# --- E17 containers --------------------------------------------------------------------------------

def containers(text: Column) -> Column:
    def row(x: Column) -> Column:
        def build(c: Column) -> Column:
            wide = F.size(c) >= 7
            image = F.get(c, F.lit(1))
            short = F.when(F.length(image) > 20, F.concat(F.substring(image, 1, 19), F.lit("…"))).otherwise(image)
            return F.struct(F.when(wide, F.substring(F.get(c, F.lit(0)), 1, 8)).otherwise("").alias("id"),
                            F.when(wide, short).otherwise("").alias("image"),
                            F.when(wide, F.substring(F.get(c, F.lit(4)), 1, 10)).otherwise("").alias("status"),
                            F.when(wide, F.try_element_at(c, F.lit(-1))).otherwise("").alias("name"),
                            F.when(wide, "").otherwise(trim_ctl(x)).alias("raw"))
        # trailing empty cells do not count as columns
        cells = F.split(F.regexp_replace(x, r"\s{2,}\z", ""), r"\s{2,}")
        return let(cells, build)
    return F.transform(non_blank(drop_first(lines_of(nn(text)), 1)), row)


def containers_text(text: Column) -> Column:
    def build(rs: Column) -> Column:
        line = F.transform(rs, lambda r: F.when((r["id"] == "") & ~is_blank(r["raw"]), r["raw"]).otherwise(
            F.format_string("%-8s %-20s %-10s %s", r["id"], r["image"], r["status"], r["name"])))
        head = F.array(F.lit("ID       IMAGE                STATUS    NAME"), F.lit("─" * 55))
        return join_lines(F.concat(head, line))
    return F.when(F.size(lines_of(nn(text))) <= 1, F.lit("(no containers running)")).otherwise(let(containers(text), build))


# --- E18 plan events ------------------------------------------------------------------------------

PLAN_JSON = ("struct<`@level`:string,`@message`:string,`@module`:string,type:string,ui:string,"
             "change:struct<action:string,reason:string,resource:struct<addr:string,resource_type:string>>,"
             "changes:struct<add:int,change:int,remove:int>,"
             "diagnostic:struct<address:string,summary:string,range:struct<filename:string>>,"
             "outputs:map<string,struct<sensitive:boolean>>>")
_PLAN_ROW = "array<struct<cls:string,address:string,action:string,reason:string,type:string>>"


def plan_events(text: Column, limits: Limits = REPORT) -> Column:
    """struct(rows, summary, capped) of a machine-readable plan, NULL when it is none.

    Rows keep text order. Within ``limits``, diagnostics count up to theirs; changes and outputs
    are kept while fewer than the limit of rows stand before them. Replacements are counted
    before rows are cut.
    """
    def clean(c: Column) -> Column:
        return F.coalesce(strip_ws(c), F.lit(""))

    def none_if_blank(c: Column) -> Column:
        return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(c)

    def row(cls: str, address: Column, action: Column, reason: Column, type_: Column) -> Column:
        return F.struct(F.lit(cls).alias("cls"), address.alias("address"), action.alias("action"), reason.alias("reason"),
                        type_.alias("type"))

    null = F.lit(None).cast("string")

    def is_ui(j: Column) -> Column:
        return (clean(j["@module"]) == PLAN_MODULE) | ((clean(j["type"]) == "version") & j["ui"].isNotNull())

    def parsed(ls: Column) -> Column:
        items = F.transform(ls, lambda x: let(strip_ws(x), lambda t: F.struct(
            t.alias("t"), F.when(t.startswith("{") & (F.lit(True) if limits.line_chars is None else F.length(t) <= limits.line_chars), F.from_json(t, PLAN_JSON, {"mode": "PERMISSIVE"})).alias("j"))))
        return F.filter(items, lambda x: x["t"] != "")

    def rows_of(x: Column, detected: Column) -> Column:
        j, t = x["j"], x["t"]
        level, kind = F.lower(clean(j["@level"])), clean(j["type"])
        no_rows = F.array().cast(_PLAN_ROW)
        plain_error = ~t.startswith("{") & (F.lower(t).startswith("error") | F.lower(t).contains("error:"))
        addr = F.when(~is_blank(clean(j["change"]["resource"]["addr"])), clean(j["change"]["resource"]["addr"])).otherwise(clean(j["@message"]))
        action = clean(j["change"]["action"])
        action = F.when(action != "", action).when(kind == "resource_drift", "drift").otherwise("change")
        change = F.when(addr != "", F.array(row("change", addr, action, none_if_blank(clean(j["change"]["reason"])),
                                                none_if_blank(clean(j["change"]["resource"]["resource_type"]))))).otherwise(no_rows)
        d_addr = F.when(clean(j["diagnostic"]["address"]) != "", clean(j["diagnostic"]["address"])).otherwise(
            clean(j["diagnostic"]["range"]["filename"]))
        d_msg = F.when(clean(j["diagnostic"]["summary"]) != "", clean(j["diagnostic"]["summary"])).otherwise(clean(j["@message"]))
        diag = F.when((d_addr == "") & (d_msg == ""), no_rows).otherwise(F.array(row(
            "diag", F.when(d_addr == "", d_msg).otherwise(d_addr), F.when(level == "", "error").otherwise(level),
            F.when(d_addr == "", null).otherwise(none_if_blank(d_msg)), null)))
        outs = F.transform(F.map_entries(j["outputs"]), lambda e: row(
            "change", e["key"], F.lit("output"), F.when(F.coalesce(e["value"]["sensitive"], F.lit(False)), "sensitive"), null))
        log = F.when(level.isin("error", "warn", "warning") & ~is_blank(clean(j["@message"])),
                     F.array(row("diag", clean(j["@message"]), level, null, null))).otherwise(no_rows)
        return F.when(plain_error, F.array(row("diag", t, F.lit("error"), null, null))).when(
            j.isNull() | ~detected, no_rows).when(kind.isin("planned_change", "resource_drift"), change).when(
                (kind == "diagnostic") & level.isin("", "error", "warn", "warning"), diag).when(
                    (kind == "outputs") & j["outputs"].isNotNull(), outs).when(kind == "log", log).otherwise(no_rows)

    def build(items: Column) -> Column:
        objects = F.array_compact(F.transform(items, lambda x, i: F.when(x["j"].isNotNull(), i + 1)))
        used, cut = items, F.lit(False)
        if limits.objects is not None:
            stop = F.coalesce(F.get(objects, F.lit(limits.objects)) - 1, F.size(items))
            used, cut = F.slice(items, 1, F.greatest(stop, F.lit(0))), F.size(objects) > limits.objects
        first_ui = F.try_element_at(F.array_compact(F.transform(items, lambda x, i: F.when(
            x["j"].isNotNull() & is_ui(x["j"]), i + 1))), F.lit(1))
        return let(F.struct(used.alias("u"), first_ui.alias("ui"), cut.alias("cut")), collect)

    def collect(p: Column) -> Column:
        all_rows = F.flatten(F.transform(p["u"], lambda x, i: rows_of(x, i + 1 >= p["ui"])))
        major = F.exists(p["u"], lambda x: (clean(x["j"]["type"]) == "version") & (
            _int(F.substring_index(x["j"]["ui"], ".", 1)) >= 2))
        totals = F.try_element_at(F.filter(F.transform(p["u"], lambda x, i: F.when(
            (clean(x["j"]["type"]) == "change_summary") & (i + 1 >= p["ui"]), x["j"]["changes"])), lambda c: c.isNotNull()), F.lit(-1))
        return let(F.struct(all_rows.alias("r"), totals.alias("s"), F.coalesce(major, F.lit(False)).alias("v2"), p["ui"].alias("ui"), p["cut"].alias("cut")), cap)

    def cap(p: Column) -> Column:
        diag_at = F.array_compact(F.transform(p["r"], lambda x, i: F.when(x["cls"] == "diag", i + 1)))
        some = p["r"]
        if limits.diagnostics is not None:
            cut = F.get(diag_at, F.lit(limits.diagnostics))
            some = F.filter(some, lambda x, i: (x["cls"] != "diag") | cut.isNull() | (i + 1 < cut))
        return let(some, lambda s: let(s if limits.rows is None else F.filter(s, lambda x, i: (x["cls"] == "diag") | (i < limits.rows)), lambda k: F.when(
            p["ui"].isNotNull() & ~p["v2"] & (p["s"].isNotNull() | (F.size(k) > 0)), F.struct(
                F.transform(k, lambda x: F.struct(x["address"].alias("address"), x["action"].alias("action"), x["reason"].alias("reason"),
                                                  x["type"].alias("type"))).alias("rows"),
                F.struct(_n(p["s"]["add"]).alias("add"), _n(p["s"]["change"]).alias("change"), _n(p["s"]["remove"]).alias("destroy"),
                         F.size(F.filter(p["r"], lambda x: (x["cls"] == "change") & (x["action"] == "replace"))).alias("replace")).alias("summary"),
                (p["cut"] | (F.size(k) < F.size(p["r"]))).alias("capped")))))

    def _n(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))
    return let(parsed(F.split(nn(text), "\n")), build)


def infra_rows_text(rs: Column) -> Column:
    return F.transform(rs, lambda r: F.concat(
        r["address"], F.when(is_blank(nn(r["action"])), "").otherwise(F.concat(F.lit(" "), r["action"])),
        F.when(is_blank(nn(r["reason"])), "").otherwise(F.concat(F.lit(" ("), r["reason"], F.lit(")")))))


def plan_text(text: Column, capped_note: str = "... (plan rows omitted) ...") -> Column:
    """Rendered plan, NULL when the text is not a machine-readable plan."""
    def build(p: Column) -> Column:
        s = p["summary"]
        head = F.format_string("Plan: %d to add, %d to change, %d to destroy", s["add"], s["change"], s["destroy"])
        head = F.concat(head, F.when(s["replace"] > 0, F.format_string(", %d to replace", s["replace"])).otherwise(""))
        note = F.when(p["capped"], F.array(F.lit(capped_note))).otherwise(empty())
        return F.when(p.isNotNull(), join_lines(F.concat(F.array(head), infra_rows_text(p["rows"]), note)))
    return let(plan_events(text), build)


# --- E19 validation result --------------------------------------------------------------------------

VALIDATE_JSON = ("struct<valid:boolean,error_count:int,warning_count:int,diagnostics:array<struct<severity:string,summary:string,"
                 "detail:string,address:string,range:struct<filename:string,start:struct<line:int>>>>>")


def json_depth(text: Column) -> Column:
    """Nesting depth of a JSON text, strings left out."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*+"', ""), r"[^\[\]{}]", "")
    step = F.transform(F.filter(F.split(marks, ""), lambda c: c != ""), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    return F.aggregate(step, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, s: F.struct(
        (a["d"] + s).alias("d"), F.greatest(a["m"], a["d"] + s).alias("m")), lambda a: a["m"])


def validate_result(text: Column) -> Column:
    """struct(valid, errors, warnings, findings), NULL when the text is no single result."""
    t = trim_ctl(nn(text))
    single = F.size(F.filter(lines_of(t), lambda x: x.startswith("{"))) <= 1
    fits = t.startswith("{") & single

    def build(j: Column) -> Column:
        def clean(c: Column) -> Column:
            return F.coalesce(trim_ctl(c), F.lit(""))
        findings = F.transform(F.coalesce(j["diagnostics"], F.array()), lambda d: F.struct(
            F.when(~is_blank(clean(d["range"]["filename"])), clean(d["range"]["filename"])).otherwise(clean(d["address"])).alias("file"),
            d["range"]["start"]["line"].alias("line"),
            F.when(~is_blank(clean(d["summary"])), clean(d["summary"])).otherwise(clean(d["detail"])).alias("message"),
            F.when(is_blank(clean(d["severity"])), "error").otherwise(clean(d["severity"])).alias("severity")))

        def finish(fs: Column) -> Column:
            warn = F.size(F.filter(fs, lambda f: F.lower(f["severity"]).isin("warning", "warn")))
            given = (F.coalesce(j["error_count"], F.lit(-1)) >= 0) & (F.coalesce(j["warning_count"], F.lit(-1)) >= 0)
            errors = F.when(given, j["error_count"]).otherwise(F.size(fs) - warn)
            warnings = F.when(given, j["warning_count"]).otherwise(warn)
            return F.struct(F.coalesce(j["valid"], errors == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"),
                            fs.alias("findings"))
        return F.when(j["valid"].isNotNull() | j["diagnostics"].isNotNull(), let(findings, finish))
    parsed = F.when(fits & (json_depth(t) <= JSON_MAX_DEPTH), F.from_json(t, VALIDATE_JSON))
    return let(parsed, lambda j: F.when(j.isNotNull(), build(j)))


def validate_text(text: Column) -> Column:
    """Rendered validation result, NULL when the text is none."""
    def build(v: Column) -> Column:
        clean = v["valid"] & (v["errors"] == 0) & (v["warnings"] == 0) & (F.size(v["findings"]) == 0)
        head = F.format_string("validate: %d error(s), %d warning(s)", v["errors"], v["warnings"])
        shown = F.transform(F.filter(v["findings"], lambda f: ~is_blank(f["message"])), lambda f: F.concat(
            F.when(is_blank(f["file"]), "").otherwise(F.concat(f["file"], F.coalesce(F.concat(F.lit(":"), f["line"].cast("string")), F.lit("")), F.lit(" "))),
            f["message"]))
        return F.when(v.isNotNull(), F.when(clean, F.lit("validate: ok")).otherwise(
            strip_trailing(join_lines(F.concat(F.array(head), shown)))))
    return let(validate_result(text), build)


# --- E20 resource addresses ------------------------------------------------------------------------

def is_address(line: Column) -> Column:
    shape = ~line.rlike("[ /]") & line.rlike(RESOURCE_ADDRESS)
    return shape & (line.startswith("module.") | line.startswith("data.") | F.substring_index(line, ".", 1).contains("_"))


def resource_type(address: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(address, MODULE_PREFIX, ""), r"^data\.", "")
    return F.substring_index(rest, ".", 1)


def address_lines(text: Column) -> Column:
    """Trimmed non-empty lines when at least two exist and 80 percent are addresses, else NULL."""
    ls = F.filter(F.transform(lines_of(nn(text)), lambda x: trim_ctl(x)), lambda x: x != "")
    return let(ls, lambda l: F.when((F.size(l) >= 2) & (
        F.size(F.filter(l, is_address)) / F.size(l) >= ADDRESS_SHARE), l))


def resource_address_counts(df: DataFrame, top_n: int = RESOURCE_TOP, key: str = "run_id") -> DataFrame:
    """(run_id, type, cnt, rank) of listed resources, most frequent first."""
    src = df.select(key, F.posexplode(address_lines(F.col("text"))).alias("line_no", "line")).where(is_address(F.col("line")))
    counts = src.groupBy(key, resource_type(F.col("line")).alias("type")).agg(F.count("*").alias("cnt"), F.min("line_no").alias("_first"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("cnt"), "_first")))
    return ranked.where(F.col("rank") <= top_n).select(key, "type", "cnt", "rank")


def resource_graph_text(text: Column, header: str, top_n: int = RESOURCE_TOP, max_lines: int = RESOURCE_CAP, fallback: str = "",
                        capped_note: str = "... (plan rows omitted) ...") -> Column:
    """Counts by resource type and the addresses; texts that are no listing are unchanged."""
    def build(l: Column) -> Column:
        return let(F.filter(l, is_address), lambda a: let(
            ranked_counts(F.transform(a, lambda x: resource_type(x))), lambda ranked: render(l, a, ranked)))

    def render(l: Column, a: Column, ranked: Column) -> Column:
        title = F.replace(F.replace(F.lit(header), F.lit("{lines}"), F.size(l).cast("string")), F.lit("{keys}"), F.size(ranked).cast("string"))
        heads = F.array(title) if header.strip() else empty()
        groups = F.transform(F.slice(ranked, 1, top_n), lambda c: F.concat(c["key"], F.lit(": "), (-c["neg"]).cast("string")))
        note = F.when(F.size(a) > max_lines, F.array(F.lit(capped_note))).otherwise(empty())
        return join_lines(F.concat(heads, groups, F.slice(a, 1, max_lines), note))
    blank = is_blank(nn(text)) & F.lit(bool(fallback.strip()))
    return F.when(blank, F.lit(fallback)).otherwise(let(address_lines(text), lambda l: F.when(l.isNotNull(), build(l)).otherwise(nn(text))))


# --- E3 test events as JSON ------------------------------------------------------------------------

GO_JSON = "struct<Action:string,Package:string,Test:string,Output:string>"


def go_events(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """Parsed events of (run_id, line_no, line); lines that are no JSON object fall out."""
    t = trim_ctl(F.col("line"))
    e = lines.where(t.startswith("{")).select(key, "line_no", F.from_json(t, GO_JSON).alias("e"))
    e = e.where(F.col("e").isNotNull())
    return e.select(key, "line_no", *[F.coalesce(F.col("e")[c], F.lit("")).alias(c.lower()) for c in ("Action", "Package", "Test")],
                    F.col("e.Output").alias("output"))


def go_test_counts(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """passed, skipped and failed per run; a test fails once however often it reports it."""
    ev = go_events(lines, key).where((F.col("test") != "") & F.col("action").isin("pass", "skip", "fail"))
    per_test = ev.groupBy(key, "package", "test").agg(
        F.count_if(F.col("action") == "pass").alias("p"), F.count_if(F.col("action") == "skip").alias("s"),
        F.max((F.col("action") == "fail").cast("int")).alias("f"))
    return per_test.groupBy(key).agg(F.sum("p").alias("passed"), F.sum("s").alias("skipped"),
                                     F.sum("f").cast("bigint").alias("failed"))


def _said(state: DataFrame, printed: DataFrame, keys: list[str], live: Column, drop: Callable[[Column], Column], every: bool) -> DataFrame:
    """The state of each key with one row for each line printed that is live, not empty and not dropped (line_no, sub,
    diagnostic); with ``every``, keys that printed nothing too."""
    lines = F.filter(F.transform(lines_of(F.col("output")), lambda x: trim_ctl(x)), lambda x: (x != "") & ~drop(x))
    rows_ = state.join(printed, keys, "left" if every else "inner").withColumn("ls", F.when(live & F.col("output").isNotNull(), lines))
    explode = F.posexplode_outer if every else F.posexplode
    return rows_.select(*state.columns, "line_no", explode("ls").alias("sub", "diagnostic"))


def _texts(said: DataFrame, keys: list[str], rest: list[str], limit: int | None) -> DataFrame:
    """(keys, rest, diagnostics, n): the lines of each key as one text, or the first ``limit``, and their number."""
    n = F.count("diagnostic")
    if limit is not None:
        own = W.partitionBy(*keys)
        said = said.withColumn("n", n.over(own)).withColumn("rk", F.row_number().over(own.orderBy(F.col("diagnostic").isNull(), "line_no", "sub"))).where((F.col("rk") <= limit) | (F.col("rk") == 1))
        n = F.max("n")
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("diagnostic").isNotNull(), F.struct("line_no", "sub", "diagnostic")))), lambda x: x["diagnostic"])
    return said.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest], F.array_join(shown, "\n").alias("diagnostics"), n.alias("n"))


def _test_output(lines: DataFrame, key: str, every: bool) -> DataFrame:
    """Failed tests and what they printed since their last pass or skip, which empties what was printed so far."""
    keys = [key, "package", "test"]
    ev = go_events(lines, key).where(F.col("test") != "")
    state = ev.groupBy(*keys).agg(
        F.max((F.col("action") == "fail").cast("int")).alias("failed"),
        F.max(F.when(F.col("action").isin("pass", "skip"), F.col("line_no"))).alias("reset")).where("failed = 1").drop("failed")
    printed = ev.where(F.col("action") == "output").select(*keys, "line_no", "output")
    drop = lambda x: x.rlike(r"^=== (?:RUN|PAUSE|CONT)\s+.*$") | x.rlike(r"^--- (?:PASS|FAIL|SKIP):\s+.*$")
    return _said(state, printed, keys, F.col("reset").isNull() | (F.col("line_no") > F.col("reset")), drop, every).drop("reset")


def go_failed_test_lines(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """(run_id, package, test, line_no, sub, diagnostic): the diagnostics of failed tests, a row a line.

    The outcome of a test is a small aggregate that joins back on its key, so a test that printed a third of all
    lines is a skewed join, which is split, and never one task's list.
    """
    return _test_output(lines, key, False)


def go_failed_tests(lines: DataFrame, key: str = "run_id", limit: int | None = None) -> DataFrame:
    """Failed tests with their diagnostics, or the first ``limit`` (run_id, package, test, diagnostics, omitted).

    A test's diagnostics are one value here; `go_failed_test_lines` has them as rows.
    """
    keys = [key, "package", "test"]
    omitted = F.lit(0) if limit is None else F.greatest(F.col("n") - limit, F.lit(0))
    return _texts(_test_output(lines, key, True), keys, [], limit).select(*keys, "diagnostics", omitted.cast("bigint").alias("omitted"))


def go_failed_packages(lines: DataFrame, key: str = "run_id", limit: int | None = None) -> DataFrame:
    """Packages that failed on their own: (run_id, package, failure_type, diagnostics, all or the first ``limit``)."""
    keys = [key, "package"]
    ev = go_events(lines, key).where(F.col("package") != "")
    own, fails = F.col("test") == "", F.col("action") == "fail"
    out = own & (F.col("action") == "output")
    o = F.coalesce("output", F.lit(""))
    flag = lambda cond: F.max(cond.cast("int"))
    state = ev.groupBy(*keys).agg(
        flag(own & fails).alias("failed"), flag(out & o.contains("build failed")).alias("b"), flag(out & o.contains("panic:")).alias("p"),
        flag(out & (o.contains("panic") | o.contains("timed out"))).alias("t"), flag(~own & fails).alias("tested")).where("failed = 1").drop("failed")
    said = _said(state, ev.where(out).select(*keys, "line_no", "output"), keys, F.lit(True), lambda x: x.startswith("FAIL\t") | x.startswith("FAIL "), True)
    kind = F.when(F.col("b") == 1, "build failed").when(F.col("p") == 1, "panic").when(F.col("t") == 1, "panic / timeout").otherwise("package failed")
    return _texts(said, keys, ["b", "p", "t", "tested"], limit).where("n > 0 OR tested = 0").select(*keys, kind.alias("failure_type"), "diagnostics")


# --- table forms ---------------------------------------------------------------------------------

CASES = {"pytest": pytest_cases, "cargo": cargo_cases, "jest": jest_cases, "vitest": vitest_cases, "playwright": browser_cases}
COUNTS = {"pytest": pytest_counts, "cargo": cargo_counts, "jest": jest_counts, "vitest": vitest_counts, "playwright": browser_counts}


def test_cases(df: DataFrame, tool: str) -> DataFrame:
    """(run_id, seq, suite, name, status, detail) of failed tests."""
    return rows(df, CASES[tool](F.col("text")))


def test_summary(df: DataFrame, tool: str) -> DataFrame:
    return df.select("run_id", COUNTS[tool](F.col("text")).alias("c")).select("run_id", "c.*")


def findings(df: DataFrame, kind: str) -> DataFrame:
    return rows(df, {"json": lint_json_findings, "text": lint_text_findings}[kind](F.col("text")))
