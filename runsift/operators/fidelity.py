"""Did the reduced text keep the evidence? Row-local checks plus a line diff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.text import (
    any_line, contains_any, is_blank, let, lines_of, lines_raw_of, nn, strip_ws, trim_ctl,
)

# What counts as a failure signal.
COMPILER_ERROR = r"(?i)^\s*(.+?):(\d+)(?::\d+)?:\s*(?:fatal\s+)?error\b.*$"
COMPILED_SOURCE = (r"(?i)^.+\.(?:java|rs|c|h|cc|cpp|cxx|hpp|cs|go|kt|kts|swift|scala|m|mm|dart|zig|ex|exs|erl"
                   r"|hrl|ml|fs|fsx|jl|lua)$")
STACK_FRAME = r"^\s+at\s+[\w.$<>]+\(.*\)\s*$"
TEST_TALLY = r"(?i)(?:Failures|Errors):\s*[1-9]\d*|\b[1-9]\d*\s+(?:tests?\s+)?failed\b"
SQL_ERROR = r"^(?:ERROR|FATAL|PANIC):\s+(\S.*)$"
PLAN_REPLACE = r"\bmust be replaced\b"
PLAN_DESTROY = r"\bPlan:\s+\d+ to add,\s+\d+ to change,\s+[1-9]\d* to destroy\b"
CVE = r"\bCVE-\d{4}-\d{4,7}\b"
STRONG_FAILURE = (r"(?:Exception in thread|Caused by:|Traceback \(most recent call last\)|panicked at|\bpanic:"
                  r"|\bFAILED\b|\bFAIL:|AssertionError|(?:Failures|Errors):\s*[1-9])")
MISLEADING = (r"(?i)^(?:ok|success|passed|all tests passed|0 errors?|no errors?|build successful|build succeeded"
              r"|no changes?)\.?$")
DIFF_HEADER = r"^diff --git a/(\S+) b/(\S+)$"
POINTER = (r"([\w./\\-]+\.(?:java|rs|py|ts|tsx|js|go|cs|cpp|cc|cxx|c|h|hpp|kt|kts|rb|swift|scala|sql|tf)):(\d+)")
STAT_COMMAND = r"(?i)(?:^|\s)--(?:stat|shortstat|numstat)\b"
DIFF_COMMAND = r"(?i)\bgit\s+diff\b"
LENIENT = r"(?i)^\s*(?:git\s+(?:status|log|push|branch|ls)|ls|tree)\b|(?:^|\s)--stat\b"
EXCEPTION_MARKERS = ["Traceback (most recent call last)", "Exception in thread", "Caused by:", "panicked at", "panic:"]
TEST_MARKERS = ["FAILED", "FAIL:", "--- FAIL", "AssertionError", "✗", "✕"]
FAILURE_WORDS = ["failed", "failure", "error"]

UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
TICKET = r"\b[A-Z]{2,10}-\d{2,6}\b"
HEX_ID = r"\b[0-9a-f]{7,40}\b"
NOISE_PREFIXES = ["UTF", "ISO", "SHA", "HTTP", "HTTPS", "RFC", "TLS", "SSL", "AES", "MD", "SHA1", "SHA2", "SHA3",
                  "CVE", "IPV", "UUID"]
MAX_IDS, MAX_SHEET_CHARS, SHEET_MIN_CHARS, SHEET_MAX_PERCENT = 12, 240, 16_384, 15
SHEET_OPEN, SHEET_CLOSE = "[preserved ids: ", "]"


@dataclass(frozen=True)
class Limits:
    """Most items of a kind that checks and signal tables look at, and characters of a message; None: all of them."""
    files: int | None = None
    changes: int | None = None
    sql: int | None = None
    cves: int | None = None
    pointers: int | None = None
    locations: int | None = None
    chars: int | None = None


ALL = Limits()


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def _head(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


# --- D1 ---------------------------------------------------------------------

def line_diff(df: DataFrame, before: str = "before", after: str = "after", key: str = "run_id") -> DataFrame:
    """Occurrence-aware multiset diff: one row per line with its side.

    Equal lines are numbered on each side and matched by number, all inside the row that holds both texts: no shuffle.
    A kept line has its place in the first text.
    """
    def sides(m: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            kept = F.when(x["side"] == 0, _pair(x, F.get(m, i + 1))).otherwise(F.lit(False))
            partner = F.when(x["side"] == 1, _pair(x, F.get(m, i - 1))).otherwise(F.lit(False))
            side = F.when(kept, "kept").when(x["side"] == 0, "dropped").otherwise("added")
            return F.when(~partner, F.struct(x["line"].alias("line"), side.alias("side"), x["idx"].alias("line_no")))
        return F.array_compact(F.transform(m, mark))
    rows = let(_merged(F.col(before), F.col(after)), sides)
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def line_diff_counts(df: DataFrame, before: str = "before", after: str = "after", key: str = "run_id") -> DataFrame:
    """kept / dropped / added per run from one count per distinct line (no numbering)."""
    def side(col: str, sign: int) -> DataFrame:
        return df.select(key, F.explode(lines_raw_of(nn(F.col(col)))).alias("line"), F.lit(sign).alias("s"))
    per_line = side(before, 1).unionByName(side(after, -1)).groupBy(key, "line").agg(
        F.count_if(F.col("s") == 1).alias("b"), F.count_if(F.col("s") == -1).alias("a"))
    return per_line.groupBy(key).agg(
        F.sum(F.least("a", "b")).alias("kept"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("dropped"),
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("added"))


def _pair(a: Column, b: Column) -> Column:
    return F.coalesce((a["line"] == b["line"]) & (a["n"] == b["n"]), F.lit(False))


def _merged(before: Column, after: Column) -> Column:
    """array<struct<line,n,side,idx>> of both texts, sorted: a kept line (side 0) stands in front of its partner (side 1)."""
    def numbered(lines: Column, side: int) -> Column:
        order = F.array_sort(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("idx"))))

        def number(s: Column) -> Column:
            starts = F.array_compact(F.transform(s, lambda x, i: F.when(
                (i == 0) | (F.get(s, i - 1)["line"] != x["line"]), i + 1)))
            return let(starts, lambda st: F.flatten(F.transform(st, lambda p, j: F.transform(
                F.slice(s, p, F.coalesce(F.get(st, j + 1), F.size(s) + 1) - p), lambda x, k: F.struct(
                    x["line"].alias("line"), k.alias("n"), F.lit(side).alias("side"), x["idx"].alias("idx"))))))
        return let(order, number)
    return F.array_sort(F.concat(numbered(lines_raw_of(nn(before)), 0), numbered(lines_raw_of(nn(after)), 1)))


def diff_in_row(before: Column, after: Column, samples: int = 32) -> Column:
    """struct(kept, dropped, added, dropped_sample, added_sample) of two texts of one row.

    Both sides are numbered per equal line and sorted together, so a kept line
    stands next to its partner: two sorts inside the row, no shuffle.
    """
    def compare(m: Column) -> Column:
        lone = F.filter(m, lambda x, i: ~_pair(x, F.get(m, i + 1)) & ~_pair(x, F.get(m, i - 1)))
        return let(F.struct(F.size(m).alias("n"), lone.alias("lone")), lambda p: let(F.struct(
            p["n"].alias("n"), of_side(p["lone"], 0).alias("d"), of_side(p["lone"], 1).alias("a")), finish))

    def of_side(lone: Column, side: int) -> Column:
        own = F.filter(lone, lambda x: x["side"] == side)
        return F.array_sort(F.transform(own, lambda x: F.struct(x["idx"].alias("idx"), x["line"].alias("line"))))

    def finish(p: Column) -> Column:
        d, a = F.size(p["d"]), F.size(p["a"])
        sample = lambda c: F.transform(F.slice(p[c], 1, samples), lambda x: x["line"])
        return F.struct(((p["n"] - d - a) / 2).cast("bigint").alias("kept"), d.cast("bigint").alias("dropped"), a.cast("bigint").alias("added"),
                        sample("d").alias("dropped_sample"), sample("a").alias("added_sample"))
    return let(_merged(before, after), compare)


# --- D2 ---------------------------------------------------------------------

def _signal(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _flag(kind: str, cond: Column, value: str = "") -> Column:
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(cond, F.array(F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value")))).otherwise(none)


def sql_messages(lines: Column, limits: Limits = ALL) -> Column:
    hits = _first(F.filter(lines, lambda x: x.rlike(SQL_ERROR)), limits.sql)
    return F.transform(hits, lambda x: _head(trim_ctl(F.regexp_extract(x, SQL_ERROR, 1)), limits.chars))


def signals_of(command: Column, text: Column, limits: Limits = ALL) -> Column:
    """array<struct<kind,value>> of the failure evidence in a text."""
    def build(s: Column) -> Column:
        wants_diff = nn(command).rlike(DIFF_COMMAND) & ~nn(command).rlike(STAT_COMMAND)
        none = F.array().cast("array<struct<kind:string,value:string>>")
        diff = let(lines_of(s), lambda ls: let(
            F.filter(ls, lambda x: x.rlike(DIFF_HEADER) | x.rlike(r"^\+(?!\+\+)|^-(?!--)")), lambda d: _diff_signals(d, limits)))
        pointers = _first(F.regexp_extract_all(s, F.lit(POINTER), F.lit(0)), limits.pointers)
        cves = _first(F.regexp_extract_all(s, F.lit(CVE), F.lit(0)), limits.cves)
        return F.concat(
            F.when(wants_diff, diff).otherwise(none),
            _signal("sql", sql_messages(lines_of(s), limits)),
            _flag("terraform", s.rlike(PLAN_REPLACE), "replace"),
            _flag("terraform", s.rlike(PLAN_DESTROY), "destroy"),
            _signal("cve", cves),
            *[_flag("exception", s.contains(m), m) for m in EXCEPTION_MARKERS],
            *[_flag("test_failure", s.contains(m), m) for m in TEST_MARKERS],
            _flag("test_tally", s.rlike(TEST_TALLY)),
            _signal("pointer", pointers),
        )
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return let(nn(text), lambda s: F.when(is_blank(s), none).otherwise(build(s)))


def _diff_signals(lines: Column, limits: Limits) -> Column:
    """File headers and change lines in text order; with limits, the first change lines, until the file header that
    fills the list to its size."""
    def item(x: Column) -> Column:
        header = x.rlike(DIFF_HEADER)
        kind = F.when(header, F.lit("diff_file")).when(x.startswith("+"), F.lit("diff_added")).otherwise(
            F.lit("diff_removed"))
        value = F.when(header, F.regexp_extract(x, DIFF_HEADER, 2)).otherwise(
            _head(F.substring(x, F.lit(2), F.length(x)), limits.chars))
        return F.struct(kind.alias("kind"), value.alias("value"))

    def capped(items: Column) -> Column:
        change_pos = F.filter(F.sequence(F.lit(1), F.size(items)),
                              lambda i: F.element_at(items, i)["kind"] != "diff_file")
        last_change = F.coalesce(F.try_element_at(change_pos, F.lit(limits.changes)), F.size(items))
        kept = F.filter(items, lambda x, i: (x["kind"] == "diff_file") | (i + 1 <= last_change))
        return let(kept, lambda k: let(
            F.filter(F.sequence(F.lit(1), F.greatest(F.size(k), F.lit(1))),
                     lambda i: (i >= (limits.files or 1)) & (F.get(k, i - 1)["kind"] == "diff_file")),
            lambda stops: F.slice(k, 1, F.coalesce(F.try_element_at(stops, F.lit(1)), F.greatest(F.size(k), F.lit(1))))))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    if limits.changes is None and limits.files is None:
        return F.transform(lines, item)
    return F.when(F.size(lines) == 0, none).otherwise(let(F.transform(lines, lambda x: item(x)), capped))


def critical_signals(runs: DataFrame, text: str = "before", key: str = "run_id") -> DataFrame:
    """(run_id, kind, value) rows of failure evidence."""
    return runs.select(key, F.explode(signals_of(F.col("command"), F.col(text))).alias("s")).select(
        key, F.col("s.kind").alias("kind"), F.col("s.value").alias("value"))


# --- D3 ---------------------------------------------------------------------

def has_test_failure(lines: Column) -> Column:
    return any_line(lines, lambda x: contains_any(x, TEST_MARKERS) | strip_ws(x).rlike(TEST_TALLY))


def fidelity_failures(command: Column, exit_code: Column, before: Column, after: Column, limits: Limits = ALL) -> Column:
    """Array of reasons why the reduced text must not replace the original.

    The text is scanned once per rule inside the row; nothing is shuffled. Most
    runs are unchanged or signal-free, so the cheap tests come first.
    """
    none = F.array().cast("array<string>")

    def one(cond: Column, message: Column | str) -> Column:
        msg = F.lit(message) if isinstance(message, str) else message
        return F.when(cond, F.array(msg)).otherwise(none)

    def lost(prefix: str, values: Column, out: Column) -> Column:
        return F.transform(F.filter(values, lambda v: ~out.contains(v)), lambda v: F.concat(F.lit(prefix), v))

    def starts(lines: Column, prefix: str) -> Column:
        return any_line(lines, lambda x: x.startswith(prefix))

    def check(p: Column) -> Column:
        raw, out, raw_lines, out_lines = p["b"], p["a"], p["bl"], p["al"]
        cmd = nn(command)
        diff_on = ~cmd.rlike(STAT_COMMAND) & starts(raw_lines, "diff --git ")
        change = r"^\+(?!\+\+)|^-(?!--)"
        diff = F.when(diff_on, F.concat(
            one(~starts(out_lines, "diff --git "), "unified diff file header dropped"),
            one(starts(raw_lines, "--- ") & ~starts(out_lines, "--- "), "unified diff --- header dropped"),
            one(starts(raw_lines, "+++ ") & ~starts(out_lines, "+++ "), "unified diff +++ header dropped"),
            one(starts(raw_lines, "@@") & ~starts(out_lines, "@@"), "unified diff hunk header dropped"),
            one(any_line(raw_lines, lambda x: x.rlike(change)) & ~any_line(out_lines, lambda x: x.rlike(change)),
                "unified diff change lines dropped"))).otherwise(none)
        cves = _first(F.regexp_extract_all(raw, F.lit(CVE), F.lit(0)), limits.cves)
        infra = F.concat(
            lost("sql error message dropped ", sql_messages(raw_lines, limits), out),
            one(raw.rlike(PLAN_REPLACE) & ~out.rlike(PLAN_REPLACE), "terraform replacement signal dropped"),
            one(raw.rlike(PLAN_DESTROY) & ~out.rlike(PLAN_DESTROY), "terraform destructive plan summary dropped"),
            lost("security advisory dropped ", cves, out))
        located = F.filter(raw_lines, lambda x: x.rlike(COMPILER_ERROR) & F.regexp_extract(
            x, COMPILER_ERROR, 1).rlike(COMPILED_SOURCE))
        places = F.transform(_first(located, limits.locations), lambda x: F.concat(
            F.regexp_extract(x, COMPILER_ERROR, 1), F.lit(":"), F.regexp_extract(x, COMPILER_ERROR, 2)))
        strict_on = ((exit_code != 0) | raw.rlike(STRONG_FAILURE)) & ~cmd.rlike(LENIENT)
        frames = any_line(raw_lines, lambda x: x.rlike(STACK_FRAME)) & ~any_line(
            out_lines, lambda x: x.rlike(STACK_FRAME)) & ~contains_any(out, EXCEPTION_MARKERS)
        strict = F.when(strict_on, F.concat(
            *[one(raw.contains(m) & ~out.contains(m), f"exception marker dropped {m}") for m in EXCEPTION_MARKERS],
            one(frames, "stack frames dropped"),
            lost("compiler diagnostic dropped ", places, out),
            one(has_test_failure(raw_lines) & ~has_test_failure(out_lines) & ~contains_any(F.lower(out), FAILURE_WORDS),
                "test failure markers dropped"))).otherwise(none)
        clean = one((exit_code != 0) & strip_ws(out).rlike(MISLEADING), "misleading clean summary on non-zero exit")
        return F.concat(diff, infra, strict, clean)

    pair = F.struct(nn(before).alias("b"), nn(after).alias("a"))
    return let(pair, lambda p: F.when(~is_blank(p["b"]) & is_blank(p["a"]), F.array(F.lit("filtered output is empty")))
               .when(p["b"] == p["a"], none).otherwise(let(F.struct(
                   p["b"].alias("b"), p["a"].alias("a"), lines_of(p["b"]).alias("bl"), lines_of(p["a"]).alias("al")), check)))


def fidelity_check(df: DataFrame, key: str = "run_id") -> DataFrame:
    failures = fidelity_failures(F.col("command"), F.col("exit_code"), F.col("before"), F.col("after"))
    out = df.select(key, failures.alias("failures"))
    return out.select(key, (F.size("failures") == 0).alias("passed"), "failures")


def failure_detail(failures: Column) -> Column:
    """Incident text: the first five reasons."""
    return F.concat(F.lit("fidelity_guard_failures "), F.array_join(F.slice(failures, 1, 5), "; "))


# --- D4, C23 ----------------------------------------------------------------

def dropped_ids(before: Column, after: Column, limit: int | None = None) -> Column:
    """Identifiers of the original that the reduced text lost; with ``limit``, the first so many."""
    kept = nn(after)

    def build(s: Column) -> Column:
        uuid = F.regexp_extract_all(s, F.lit(UUID), F.lit(0))
        cve = F.regexp_extract_all(s, F.lit(CVE), F.lit(0))
        ticket = F.filter(F.regexp_extract_all(s, F.lit(TICKET), F.lit(0)),
                          lambda x: ~F.substring_index(x, "-", 1).isin(NOISE_PREFIXES))
        masked = F.regexp_replace(s, UUID, "-")
        hexes = F.filter(F.regexp_extract_all(masked, F.lit(HEX_ID), F.lit(0)),
                         lambda x: x.rlike(r"[0-9][a-f]*[0-9]") & x.rlike(r"[a-f][0-9]*[a-f]"))
        return _first(F.filter(F.array_distinct(F.concat(uuid, cve, ticket, hexes)), lambda x: ~kept.contains(x)), limit)
    return let(nn(before), build)


def dropped_identifiers(df: DataFrame, key: str = "run_id") -> DataFrame:
    return df.select(key, dropped_ids(F.col("before"), F.col("after")).alias("ids"))


def factsheet(ids: Column) -> Column:
    """One line naming the ids, shortened from the end to its size; '' for none."""
    def line(k: Column) -> Column:
        return F.concat(F.lit(SHEET_OPEN), F.array_join(F.slice(ids, 1, k), ", "), F.lit(SHEET_CLOSE))
    fitting = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))),
                       lambda k: F.char_length(line(k)) <= MAX_SHEET_CHARS)
    best = F.try_element_at(fitting, F.lit(-1))
    return F.when((F.size(ids) == 0) | best.isNull(), F.lit("")).otherwise(line(best))


def append_factsheet(before: Column, after: Column) -> Column:
    """Long texts reduced to 15 percent or less get the ids they lost."""
    due = (F.char_length(before) >= SHEET_MIN_CHARS) & (
        F.char_length(after).cast("bigint") * 100 <= F.char_length(before).cast("bigint") * SHEET_MAX_PERCENT)
    sheet = let(dropped_ids(before, after, MAX_IDS), factsheet)
    return F.when(due, let(sheet, lambda s: F.when(s == "", after).otherwise(F.concat(after, F.lit("\n"), s)))) \
        .otherwise(after)


# --- D5, D7, C22 --------------------------------------------------------------

def fallback_to_raw(df: DataFrame, key: str = "run_id") -> DataFrame:
    """Failing verdict: original text, one recorded incident."""
    failures = fidelity_failures(F.col("command"), F.col("exit_code"), F.col("before"), F.col("after"))
    out = df.withColumn("_f", failures)
    bad = F.size("_f") > 0
    return out.select(key, F.when(bad, F.col("before")).otherwise(F.col("after")).alias("text"),
                      (~bad).alias("was_filtered"), F.when(bad, F.lit("apply_fallback")).alias("incident"),
                      F.when(bad, failure_detail(F.col("_f"))).alias("detail"))


def is_net_loss(before: Column, after: Column, tokens_before: Column, tokens_after: Column,
                ultra_compact: Column | bool = False) -> Column:
    compact = F.lit(ultra_compact) if isinstance(ultra_compact, bool) else ultra_compact
    return (before != "") & ~compact & (F.char_length(after) > F.char_length(before)) & (tokens_after > tokens_before)


def is_intended_growth(command: Column, before: Column, after: Column) -> Column:
    """Summaries that may be longer: package installs, and listings that keep every line."""
    cmd = strip_ws(F.regexp_replace(F.lower(nn(command)), r"\s+", " "))
    keeps_all = ~any_line(lines_of(before), lambda x: ~is_blank(x) & ~after.contains(x))
    listing = cmd.isin("terraform state list", "tofu state list") | cmd.startswith("kubectl get pods")
    return cmd.isin("npm install", "npm ci") | (listing & keeps_all)


def net_win_gate(command: Column, exit_code: Column, before: Column, after: Column,
                 tokens_before: Column, tokens_after: Column, ultra_compact: Column | bool = False) -> Column:
    """The reduced text, or the original when a clean run would grow by it."""
    loss = (exit_code == 0) & is_net_loss(before, after, tokens_before, tokens_after, ultra_compact) \
        & ~is_intended_growth(command, before, after)
    return F.when(loss, before).otherwise(after)


def signal_retention_report(df: DataFrame, group: str = "command", floor: int = 60) -> DataFrame:
    """Per tool: runs, runs that kept every signal, and savings against a floor.

    ``df`` has before, after, raw_tokens and out_tokens.
    """
    from runsift.functions.tokens import savings_pct
    sig = F.filter(signals_of(F.col("command"), F.col("before")),
                   lambda s: ~s["kind"].isin("terraform", "test_tally"))
    kept = F.forall(sig, lambda s: F.col("after").contains(s["value"]))
    out = df.select(group, kept.alias("kept"), savings_pct(F.col("raw_tokens"), F.col("out_tokens")).alias("pct"))
    return out.groupBy(group).agg(
        F.count("*").alias("runs"), F.count_if("kept").alias("kept_runs"), F.min("pct").alias("min_pct"),
        F.sum("pct").alias("sum_pct"), F.count_if(F.col("pct") >= floor).alias("at_floor"))
