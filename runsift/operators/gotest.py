"""Go test output as text: interleaved events of a run are told apart inside its row.

The events of a text become an array that is sorted by package, test and position, so that each test's events stand
together; a test's outcome and its diagnostics are read off its piece. Logs without JSON are handled the same way: pieces
between start marks give the owner of a line, and a sort by owner and position gives each failure its lines. Every step is
linear in the text but for the sorts, and nothing leaves the row: a corpus of runs is one narrow scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.text import any_line, is_blank, join_lines, let, lines_of, nn, strip_trailing, trim_ctl

# The fields of an event, the marks of a log, and texts of the summary.
EVENT = "struct<Action:string,Package:string,Test:string,Output:string>"
RUN, PAUSE = r"^===\s+(?:RUN|CONT)\s+(\S+).*$", r"^===\s+PAUSE\s+(\S+).*$"
FAIL, PASS = r"^(?:--- )?FAIL:\s+([^\s(]+).*$", r"^--- (?:PASS|SKIP):\s+([^\s(]+).*$"
START_MARK, STATUS_MARK = r"^=== (?:RUN|PAUSE|CONT)\s+.*$", r"^--- (?:PASS|FAIL|SKIP):\s+.*$"
LOG_NOTE = "... (diagnostics omitted) ..."
SUMMARY_LINES, GENERIC_LINES = 15, 20

_STRINGS = "array<string>"
_FAILURES = "array<struct<name:string,diagnostics:array<string>>>"
_PACKAGES = "array<struct<package:string,kind:string,diagnostics:array<string>>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _pieces(items: Column, starts: Callable[[Column, Column], Column], build: Callable[[Column], Column]) -> Column:
    """``build`` of each piece of an array; ``starts(before, item)`` says whether an item opens a new one."""
    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))),
                     lambda i: (i <= F.size(items)) & ((i == 1) | starts(F.get(items, i - 2), F.get(items, i - 1))))
    return let(first, lambda at: F.transform(at, lambda s, k: let(
        F.slice(items, s, F.coalesce(F.get(at, k + 1), F.size(items) + 1) - s), build)))


def _numbers(items: Column, cond: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(items, cond), lambda x: x["no"])


# --- events as JSON ---------------------------------------------------------------------------

def events_of(text: Column) -> Column:
    """array<struct<package,test,no,action,output>> of the lines that are JSON objects, in text order."""
    lines = F.transform(lines_of(nn(text)), lambda x: trim_ctl(x))
    parsed = F.transform(lines, lambda x, i: F.struct(i.alias("no"), F.when(x.startswith("{"), F.from_json(x, EVENT)).alias("e")))
    return F.transform(F.filter(parsed, lambda x: x["e"].isNotNull()), lambda x: F.struct(
        nn(x["e"]["Package"]).alias("package"), nn(x["e"]["Test"]).alias("test"), x["no"].alias("no"), nn(x["e"]["Action"]).alias("action"),
        x["e"]["Output"].alias("output")))


def _clean(outputs: Column, drop: Callable[[Column], Column]) -> Column:
    lines = F.flatten(F.transform(outputs, lambda x: F.transform(lines_of(x["output"]), lambda y: trim_ctl(y))))
    return F.filter(lines, lambda x: (x != "") & ~drop(x))


def _printed(piece: Column, after: Column) -> Column:
    return F.filter(piece, lambda x: (x["action"] == "output") & x["output"].isNotNull() & (x["no"] > after))


def _tests(events: Column) -> Column:
    """Failed tests by their first failure. A pass or skip empties what a test has printed so far."""
    def of_piece(p: Column) -> Column:
        reset = F.coalesce(F.array_max(_numbers(p, lambda x: x["action"].isin("pass", "skip"))), F.lit(-1))
        failed = F.array_min(_numbers(p, lambda x: x["action"] == "fail"))
        diagnostics = F.when(failed.isNotNull(), _clean(_printed(p, reset), lambda x: x.rlike(START_MARK) | x.rlike(STATUS_MARK)))
        return F.struct(failed.alias("no"), F.get(p, F.lit(0))["package"].alias("package"), F.get(p, F.lit(0))["test"].alias("name"), diagnostics.alias("diagnostics"))
    mine = F.array_sort(F.filter(events, lambda x: ~is_blank(x["test"])))
    pieces = let(mine, lambda m: _pieces(m, lambda a, b: (a["package"] != b["package"]) | (a["test"] != b["test"]), of_piece))
    return F.array_sort(F.filter(pieces, lambda x: x["no"].isNotNull()))


def _packages(events: Column, tests: Column) -> Column:
    """Packages that failed on their own, by their first failure."""
    def of_piece(p: Column) -> Column:
        failed = F.array_min(_numbers(p, lambda x: x["action"] == "fail"))
        said = F.array_join(F.transform(_printed(p, F.lit(-1)), lambda x: x["output"]), " ")
        kind = let(said, lambda s: F.when(s.contains("build failed"), "build failed").when(s.contains("panic:"), "panic").when(
            s.contains("panic") | s.contains("timed out"), "panic / timeout").otherwise("package failed"))
        diagnostics = F.when(failed.isNotNull(), _clean(_printed(p, F.lit(-1)), lambda x: x.startswith("FAIL\t") | x.startswith("FAIL ")))
        return F.struct(failed.alias("no"), F.get(p, F.lit(0))["package"].alias("package"), kind.alias("kind"), diagnostics.alias("diagnostics"))
    mine = F.array_sort(F.filter(events, lambda x: is_blank(x["test"]) & ~is_blank(x["package"])))
    pieces = let(mine, lambda m: _pieces(m, lambda a, b: a["package"] != b["package"], of_piece))
    tested = F.transform(tests, lambda t: t["package"])
    return F.array_sort(F.filter(pieces, lambda x: x["no"].isNotNull() & ((F.size(x["diagnostics"]) > 0) | ~F.array_contains(tested, x["package"]))))


def event_summary(text: Column) -> Column:
    """struct<passed,skipped,tests,packages> of a text of events, whole; no JSON line gives zeros."""
    def build(ev: Column) -> Column:
        count = lambda action: F.size(F.filter(ev, lambda x: (x["action"] == action) & ~is_blank(x["test"])))
        return let(_tests(ev), lambda tests: F.struct(count("pass").alias("passed"), count("skip").alias("skipped"), tests.alias("tests"), _packages(ev, tests).alias("packages")))
    return let(events_of(text), build)


# --- logs without JSON ------------------------------------------------------------------------

def _marks(text: Column) -> Column:
    """array<struct<no,kind,name,t>> of the lines that matter; ``no`` counts from 0."""
    def of_line(x: Column, i: Column) -> Column:
        t = trim_ctl(x)
        return let(t, lambda t: let(
            F.when(t == "", F.lit(None).cast("string")).when(t.rlike(RUN), "run").when(t.rlike(PAUSE), "pause").when(t.rlike(FAIL), "fail").when(t.rlike(PASS), "pass")
            .when(x.rlike(r"^[ \t]") & ~t.rlike(STATUS_MARK), "diag"),
            lambda kind: F.struct(i.alias("no"), kind.alias("kind"), F.when(kind == "run", F.regexp_extract(t, RUN, 1)).when(
                kind == "pause", F.regexp_extract(t, PAUSE, 1)).when(kind == "fail", F.regexp_extract(t, FAIL, 1)).when(
                    kind == "pass", F.regexp_extract(t, PASS, 1)).otherwise("").alias("name"), t.alias("t"))))
    return F.filter(F.transform(lines_of(nn(text)), of_line), lambda x: x["kind"].isNotNull())


def _owned(marks: Column) -> Column:
    """Marks with the name of the test that a line belongs to: the last one started, unless it has paused or ended since."""
    def of_piece(p: Column) -> Column:
        head = F.get(p, F.lit(0))
        current = F.when(head["kind"] == "run", head["name"])
        end = F.coalesce(F.array_min(_numbers(p, lambda x: x["kind"].isin("pause", "fail", "pass") & (x["name"] == current))), F.lit(2 ** 31 - 1))
        return F.transform(p, lambda x: F.struct(
            F.when(x["kind"] == "diag", F.when(current.isNotNull() & (x["no"] < end), current)).otherwise(x["name"]).alias("name"),
            x["no"].alias("no"), x["kind"].alias("kind"), x["t"].alias("t")))
    return F.flatten(_pieces(marks, lambda a, b: b["kind"] == "run", of_piece))


def _between(items: Column, ends: Callable[[Column], Column], build: Callable[[Column, Column], Column]) -> Column:
    """``build(end, items since the end before)`` for the items that are ends."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), lambda i: (i <= F.size(items)) & ends(F.get(items, i - 1)))
    return let(at, lambda a: F.transform(a, lambda e, k: let(F.coalesce(F.get(a, k - 1), F.lit(0)), lambda s: build(
        F.get(items, e - 1), F.slice(items, s + 1, e - s - 1)))))


def log_failures(text: Column, limit: int | None = None) -> Column:
    """array<struct<name,diagnostics>> of a test log without JSON, by position; all diagnostics, or ``limit`` and a note.

    An indented line belongs to the last started test unless that test has paused or ended since; lines without an
    owner go to the next failure that has none of its own.
    """
    def cut(d: Column, note: bool) -> Column:
        if limit is None:
            return d
        more = F.array(F.lit(LOG_NOTE)) if note else _none(_STRINGS)
        return F.when(F.size(d) > limit, F.concat(F.slice(d, 1, limit), more)).otherwise(d)

    def build(m: Column) -> Column:
        # a test's own lines: sorted by owner, those since its last end
        mine = F.array_sort(F.filter(m, lambda x: (x["kind"] == "diag") & x["name"].isNotNull() | x["kind"].isin("fail", "pass")))
        own = let(mine, lambda s: _between(s, lambda x: x["kind"] != "diag", lambda end, before: F.struct(
            end["no"].alias("no"), end["kind"].alias("kind"), end["name"].alias("name"),
            F.transform(F.filter(before, lambda x: x["name"] == end["name"]), lambda x: x["t"]).alias("d"))))
        return let(F.filter(own, lambda x: x["kind"] == "fail"), lambda fails: finish(m, fails))

    def finish(m: Column, fails: Column) -> Column:
        # lines without an owner: those since a start, a pass or a failure that took such lines
        bare = F.filter(fails, lambda x: F.size(x["d"]) == 0)
        row = lambda x, ends, name: F.struct(x["no"].alias("no"), ends.alias("ends"), name.alias("name"), F.lit("").alias("t"))
        null = F.lit(None).cast("string")
        loose = F.transform(F.filter(m, lambda x: (x["kind"] == "diag") & x["name"].isNull()), lambda x: F.struct(
            x["no"].alias("no"), F.lit(False).alias("ends"), null.alias("name"), x["t"].alias("t")))
        clears = F.concat(F.transform(F.filter(m, lambda x: x["kind"].isin("run", "pass")), lambda x: row(x, F.lit(True), null)),
                          F.transform(bare, lambda x: row(x, F.lit(True), x["name"])))
        late = let(F.array_sort(F.concat(loose, clears)), lambda s: _between(s, lambda x: x["ends"], lambda end, before: F.struct(
            end["no"].alias("no"), end["name"].alias("name"), cut(F.transform(before, lambda x: x["t"]), False).alias("diagnostics"))))
        full = F.transform(F.filter(fails, lambda x: F.size(x["d"]) > 0), lambda x: F.struct(x["no"].alias("no"), x["name"].alias("name"), cut(x["d"], True).alias("diagnostics")))
        both = F.array_sort(F.concat(full, F.filter(late, lambda x: x["name"].isNotNull())))
        return F.transform(both, lambda x: F.struct(x["name"].alias("name"), x["diagnostics"].alias("diagnostics")))
    return let(_marks(text), lambda marks: F.when(F.size(marks) == 0, _none(_FAILURES)).otherwise(let(_owned(marks), build)))


# --- as text ----------------------------------------------------------------------------------

def _indented(lines: Column, by: str) -> Column:
    return F.transform(lines, lambda x: F.concat(F.lit(by), x))


def generic_text(text: Column) -> Column:
    """The lines of a log that start with a failure, its first ones; without any the text itself."""
    bad = F.filter(lines_of(text), lambda x: x.startswith("--- FAIL:") | x.startswith("FAIL"))
    return let(F.slice(bad, 1, GENERIC_LINES), lambda b: F.when(F.size(b) == 0, text).otherwise(strip_trailing(
        join_lines(F.concat(F.array(F.format_string("go test: %d failure(s)", F.size(b))), _indented(b, "  "))))))


def log_text(text: Column, limit: int | None = SUMMARY_LINES) -> Column:
    """Summary of a test log without JSON; a log without failures stays as it is."""
    def build(f: Column) -> Column:
        listed = F.flatten(F.transform(f, lambda x: F.concat(F.array(F.concat(F.lit("  FAIL: "), x["name"])), _indented(x["diagnostics"], "    "))))
        return F.when(F.size(f) == 0, generic_text(text)).otherwise(strip_trailing(join_lines(
            F.concat(F.array(F.format_string("go test: %d failure(s)", F.size(f))), listed))))
    return let(log_failures(text, limit), build)


def _capped(lines: Column, limit: int | None, note: bool) -> Column:
    if limit is None:
        return lines
    more = F.array(F.format_string("... (%d lines omitted) ...", F.size(lines) - limit)) if note else _none(_STRINGS)
    return F.when(F.size(lines) <= limit, lines).otherwise(F.concat(F.slice(lines, 1, limit), more))


def go_test_text(text: Column, limit: int | None = SUMMARY_LINES) -> Column:
    """Summary of a go test run, events or log; what is neither stays as it is. ``limit``: diagnostics shown of one failure."""
    raw = nn(text)

    def tail(s: Column, failures: Column) -> Column:
        return F.concat(F.format_string("passed: %d", s["passed"]), F.when(s["skipped"] > 0, F.format_string(" | skipped: %d", s["skipped"])).otherwise(""),
                        F.when(failures > 0, F.format_string(" | failed: %d", failures)).otherwise(""))

    def render(s: Column) -> Column:
        tests, packages = s["tests"], s["packages"]
        ran = (s["passed"] > 0) | (s["skipped"] > 0) | (F.size(tests) > 0)
        alone = F.array_join(F.transform(packages, lambda p: join_lines(F.concat(
            F.array(F.concat(F.lit("go test: "), p["kind"], F.lit(" in "), p["package"])), _indented(_capped(p["diagnostics"], limit, False), "  ")))), "\n\n")
        listed = F.concat(
            F.flatten(F.transform(tests, lambda t: F.concat(F.array(F.concat(F.lit("  FAIL: "), t["name"])), _indented(_capped(t["diagnostics"], limit, True), "    ")))),
            F.flatten(F.transform(packages, lambda p: F.concat(F.array(F.concat(F.lit("  FAIL: ["), p["kind"], F.lit("] "), p["package"])),
                                                               _indented(_capped(p["diagnostics"], limit, False), "    ")))))
        failures = F.size(tests) + F.size(packages)
        head = F.when(failures > 0, F.array(F.format_string("go test: %d failure(s)", failures))).otherwise(_none(_STRINGS))
        whole = join_lines(F.concat(head, listed, F.array(tail(s, failures))))
        return F.when(ran, strip_trailing(whole)).when(F.size(packages) > 0, strip_trailing(alone)).otherwise(log_text(raw, limit))
    events = any_line(lines_of(raw), lambda x: trim_ctl(x).startswith("{") & trim_ctl(x).endswith("}"))
    return F.when(is_blank(raw), raw).when(events, let(event_summary(raw), render)).otherwise(log_text(raw, limit))


def json_lines_text(text: Column) -> Column:
    """Counts and failed tests of lines that are events; a text without results is treated as a log."""
    raw = nn(text)
    parsed = F.transform(F.filter(lines_of(raw), lambda x: x.startswith("{")), lambda x: F.from_json(x, EVENT))
    named = F.filter(parsed, lambda e: e.isNotNull() & ~is_blank(nn(e["Test"])))

    def build(ev: Column) -> Column:
        count = lambda action: F.size(F.filter(ev, lambda e: e["Action"] == action))
        failed = F.transform(F.filter(ev, lambda e: e["Action"] == "fail"), lambda e: F.concat(F.lit("  FAIL: "), e["Test"]))
        return let(failed, lambda f: F.when((count("pass") == 0) & (F.size(f) == 0), generic_text(raw)).otherwise(strip_trailing(join_lines(F.concat(
            F.when(F.size(f) > 0, F.concat(F.array(F.format_string("go test: %d failure(s)", F.size(f))), f)).otherwise(_none(_STRINGS)),
            F.array(F.concat(F.format_string("passed: %d", count("pass")), F.when(count("skip") > 0, F.format_string(" | skipped: %d", count("skip"))).otherwise(""),
                             F.when(F.size(f) > 0, F.format_string(" | failed: %d", F.size(f))).otherwise("")))))))
        )
    return let(named, build)


# --- as tables --------------------------------------------------------------------------------

def go_plain_failures(df: DataFrame, key: str = "run_id", limit: int | None = None) -> DataFrame:
    """(run_id, seq, name, diagnostics) of test logs without JSON (run_id, text), from one scan and without a shuffle."""
    rows = df.select(key, F.posexplode(log_failures(F.col("text"), limit)).alias("seq", "f"))
    return rows.select(key, (F.col("seq") + 1).alias("seq"), "f.name", join_lines(F.col("f.diagnostics")).alias("diagnostics"))


def go_text_failures(df: DataFrame, key: str = "run_id") -> DataFrame:
    """(run_id, seq, package, name, kind, diagnostics) of runs captured as text (run_id, text): failed tests, then packages."""
    def build(s: Column) -> Column:
        tests = F.transform(s["tests"], lambda t: F.struct(t["package"].alias("package"), t["name"].alias("name"), F.lit("test").alias("kind"), t["diagnostics"].alias("d")))
        return F.concat(tests, F.transform(s["packages"], lambda p: F.struct(p["package"].alias("package"), F.lit(None).cast("string").alias("name"), p["kind"].alias("kind"), p["diagnostics"].alias("d"))))
    rows = df.select(key, F.posexplode(let(event_summary(F.col("text")), build)).alias("seq", "f"))
    return rows.select(key, "seq", "f.package", "f.name", "f.kind", join_lines(F.col("f.d")).alias("diagnostics"))
