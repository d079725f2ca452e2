"""Views of a code-hosting client: metadata, checks, runs and pipelines by section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runsift.functions.text import contains_any, drop_first, is_blank, join_lines, let, lines_of, nn, strip_trailing, trim_ctl
from runsift.operators.extract import blocks_at, empty
from runsift.operators.reduce import head_tail

# Markup to drop, section names and sizes.
WRAPPER_TAG = (r"(?i)^\s*</?(?:details|summary|blockquote|ul|ol|table|tbody|thead|tr)[^>]*>"
               r"(?:.*?</(?:summary|details)>)?\s*$")
PURE_TAG = r"^\s*</?[a-zA-Z0-9_-]+[^>]*>\s*$"
BADGE = r"^\s*(?:\[!\[.*?\]\(.*?\)\]\(.*?\)|<!--.*?-->|\[//\]:.*)\s*$"
INLINE_TAG = r"</?(?:p|em|strong|b|i|code|a)[^>]*>"
BODY_LINES, ENDS = 12, 6
FOOTERS = ["For more information", "To see what failed", "View this run on GitHub"]


def view_text(text: Column) -> Column:
    """Metadata with values, a divider, and at most twelve substantive body lines."""
    def value(x: Column) -> Column:
        tab, colon = F.instr(x, "\t"), F.instr(x, ":")
        at = F.when(tab > 1, tab).when(colon > 1, colon)
        return F.coalesce(trim_ctl(F.substring(x, at + 1, F.length(x))), F.lit(""))

    def body_line(x: Column) -> Column:
        t = trim_ctl(x)
        markup = t.rlike(WRAPPER_TAG) | t.rlike(PURE_TAG) | t.rlike(BADGE)
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\s*<li>", "- "), "</?li>", ""), INLINE_TAG, "")
        clean = trim_ctl(plain)
        # '' marks a paragraph break, NULL a dropped line
        return F.when(t == "", F.lit("")).when(~markup & (clean != ""), clean)

    def build(p: Column) -> Column:
        meta = F.filter(F.slice(p["l"], 1, p["cut"] - 1), lambda x: ~is_blank(x) & (value(x) != ""))
        kept = F.array_compact(F.transform(drop_first(p["l"], p["cut"]), body_line))
        return let(kept, lambda k: let(
            F.filter(k, lambda x, i: (x != "") | (F.coalesce(F.get(k, i - 1), F.lit("")) != "")),
            lambda s: let(_drop_last_blank(s), lambda b: finish(meta, b))))

    def finish(meta: Column, body: Column) -> Column:
        note = F.when(F.size(body) > BODY_LINES, F.array(F.format_string("... (%d lines omitted) ...", F.size(body) - BODY_LINES))).otherwise(empty())
        return strip_trailing(join_lines(F.concat(meta, F.array(F.lit("--")), F.slice(body, 1, BODY_LINES), note)))
    return let(lines_of(nn(text)), lambda ls: let(F.struct(
        ls.alias("l"), F.try_element_at(F.array_compact(F.transform(ls, lambda x, i: F.when(trim_ctl(x) == "--", i + 1))), F.lit(1)).alias("cut")),
        lambda p: F.when(p["cut"].isNull(), nn(text)).otherwise(build(p))))


def _drop_last_blank(s: Column) -> Column:
    return F.when(F.try_element_at(s, F.lit(-1)) == "", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)


def checks_text(text: Column) -> Column:
    """Failing checks by name, and how many passed."""
    def row(x: Column) -> Column:
        c = F.split(F.regexp_replace(x, "\t+\\z", ""), "\t")
        cell = lambda k: F.coalesce(trim_ctl(F.get(c, F.lit(k))), F.lit(""))
        status, low = F.lower(cell(1)), F.lower(x)
        table = F.size(c) >= 2
        passed = F.when(table, status.contains("pass") | status.contains("success")).otherwise(
            ~(low.contains("fail") | low.contains("error")) & low.contains("pass"))
        entry = F.concat(F.lit("✗ "), cell(0), F.lit(" ("), status, F.when(cell(2) == "", "").otherwise(F.concat(F.lit(", "), cell(2))),
                         F.lit(")"), F.when(cell(3) == "", "").otherwise(F.concat(F.lit(" "), cell(3))))
        failed = F.when(table & ~passed, entry).when(~table & (low.contains("fail") | low.contains("error")), F.concat(F.lit("✗ "), trim_ctl(x)))
        return F.struct(passed.alias("ok"), failed.alias("bad"))

    def build(rs: Column) -> Column:
        ok = F.size(F.filter(rs, lambda r: r["ok"]))
        return let(F.array_compact(F.transform(rs, lambda r: r["bad"])), lambda bad: F.when(F.size(rs) == 0, nn(text)).when(
            F.size(bad) == 0, F.format_string("✓ all checks passed (%d checks)", ok)).otherwise(strip_trailing(join_lines(F.concat(
                F.array(F.format_string("✗ %d of %d checks failed:", F.size(bad), F.size(rs))),
                F.transform(bad, lambda b: F.concat(F.lit("  "), b)),
                F.when(ok > 0, F.array(F.format_string("✓ %d checks passed", ok))).otherwise(empty()))))))
    return let(F.transform(F.filter(lines_of(nn(text)), lambda x: ~is_blank(x)), row), build)


def run_view_text(text: Column) -> Column:
    """Header, failed jobs with their failed steps, error annotations, artifacts."""
    mark = "\u0001"

    def is_header(x: Column) -> Column:
        t = trim_ctl(x)
        footer = F.lit(False)
        for f in FOOTERS:
            footer = footer | t.startswith(f)
        return (x == mark) | t.isin("JOBS", "ANNOTATIONS", "ARTIFACTS") | footer

    def section(bs: Column, name: str) -> Column:
        return F.flatten(F.transform(F.filter(bs, lambda b: trim_ctl(F.element_at(b, 1)) == name), lambda b: drop_first(b, 1)))

    def jobs(rows: Column) -> Column:
        top = lambda x: ~x.startswith("  ") & ~x.startswith("\t")
        bad = lambda x: x.startswith("X ") | x.contains("failed")

        def one(b: Column) -> Column:
            steps = F.transform(F.filter(F.transform(drop_first(b, 1), lambda x: trim_ctl(x)), bad), lambda t: F.concat(F.lit("  "), t))
            return F.concat(F.slice(b, 1, 1), F.when(bad(F.element_at(b, 1)), steps).otherwise(empty()))
        return F.flatten(F.transform(blocks_at(F.filter(rows, lambda x: ~is_blank(x)), top), one))

    def build(bs: Column) -> Column:
        head = F.filter(section(bs, mark_name), lambda x: trim_ctl(x) != "")
        notes = F.filter(section(bs, "ANNOTATIONS"), lambda x: trim_ctl(x).startswith("X ") | contains_any(
            F.lower(trim_ctl(x)), ["exit code", "error", "failed"]))
        arts = F.filter(section(bs, "ARTIFACTS"), lambda x: trim_ctl(x) != "")
        job_rows = section(bs, "JOBS")
        blank = F.array(F.lit(""))
        return strip_trailing(join_lines(F.concat(
            head, blank, F.when(F.size(job_rows) > 0, F.concat(F.array(F.lit("JOBS")), jobs(job_rows), blank)).otherwise(empty()),
            F.when(F.size(notes) > 0, F.concat(F.array(F.lit("ANNOTATIONS")), notes, blank)).otherwise(empty()),
            F.when(F.size(arts) > 0, F.concat(F.array(F.lit("ARTIFACTS")), arts)).otherwise(empty()))))
    mark_name = ""  # trim_ctl of the mark, which is a control character
    lines = F.concat(F.array(F.lit(mark)), lines_of(nn(text)))
    return let(blocks_at(lines, is_header), build)


def ci_view_text(text: Column) -> Column:
    """Pipeline header, failing jobs and how many passed."""
    def build(p: Column) -> Column:
        named = F.array_compact(F.transform(p, lambda x, i: F.when(F.lower(trim_ctl(x)).isin("jobs:", "stages:"), i + 1)))
        cut = F.coalesce(F.try_element_at(named, F.lit(1)), F.size(p) + 1)
        head = F.filter(F.slice(p, 1, cut - 1), lambda x: trim_ctl(x) != "")
        rows = F.filter(F.transform(drop_first(p, cut - 1), lambda x: trim_ctl(x)),
                        lambda t: (t != "") & ~F.lower(t).isin("jobs:", "stages:"))
        return let(F.struct(head.alias("h"), rows.alias("r")), finish)

    def finish(p: Column) -> Column:
        def ok(t: Column) -> Column:
            low = F.lower(t)
            bad = contains_any(low, ["fail", "error"]) | t.startswith("✗") | t.startswith("X ")
            return ~bad & (contains_any(low, ["pass", "success"]) | t.startswith("✓"))
        bad = F.filter(p["r"], lambda t: ~ok(t))
        n_ok = F.size(p["r"]) - F.size(bad)
        fails = F.concat(F.array(F.format_string("✗ %d of %d jobs failed:", F.size(bad), F.size(p["r"]))),
                         F.transform(bad, lambda t: F.concat(F.lit("  "), t)),
                         F.when(n_ok > 0, F.array(F.format_string("✓ %d jobs passed", n_ok))).otherwise(empty()))
        tail = F.when(F.size(bad) == 0, F.array(F.format_string("✓ all jobs passed (%d jobs)", n_ok))).otherwise(fails)
        return strip_trailing(join_lines(F.when(F.size(p["r"]) == 0, p["h"]).otherwise(F.concat(p["h"], F.array(F.lit("")), tail))))
    return let(lines_of(nn(text)), build)


def _titled(text: Column) -> Column:
    return (text.startswith("title:\t") | text.startswith("title: ")) & text.contains("\n--")


def section_filter(text: Column, command: Column, exit_code: Column, client: str) -> Column:
    """Pick the view by the command; lists keep both ends, failed runs stay verbatim."""
    t, cmd = nn(text), F.lower(nn(command))
    kind = "pr" if client == "gh" else "mr"
    view = (cmd.contains("view") & (cmd.contains(kind) | cmd.contains("issue"))) | (((cmd == "") | ~cmd.contains("list")) & _titled(t))
    out = F.when(is_blank(t) | (exit_code != 0), t).when(view, view_text(t))
    if client == "gh":
        states = ["pass", "fail", "failure", "pending", "skipping"]
        tabbed = F.exists(F.slice(lines_of(t), 1, 5), lambda x: F.coalesce(F.lower(trim_ctl(F.get(F.split(x, "\t"), F.lit(1)))).isin(states), F.lit(False)))
        out = out.when(cmd.contains("checks") | ((cmd == "") & tabbed), checks_text(t))
        run = (cmd.contains("run") & cmd.contains("view")) | (
            (cmd == "") & (t.startswith("✓ ") | t.startswith("X ")) & t.contains("JOBS"))
        out = out.when(run, run_view_text(t))
    else:
        low = F.lower(t)
        ci = (cmd.contains("ci") & cmd.contains("view")) | (
            (cmd == "") & (low.contains("pipeline #") | (low.contains("pipeline") & low.contains("jobs:"))))
        out = out.when(ci, ci_view_text(t))
    return out.otherwise(head_tail(t, ENDS, ENDS))
