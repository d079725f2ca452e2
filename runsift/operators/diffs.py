"""Unified diffs: hunk sampling, counts and stat summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runsift.functions.text import any_line, is_blank, join_lines, let, lines_of, nn, strip_trailing, trim_ctl

# Budgets per hunk and for a whole diff.
HUNK_HEAD, HUNK_TAIL = 40, 20
HUNK_BUDGET = HUNK_HEAD + HUNK_TAIL
MAX_LINES, MAX_BYTES = 360, 6 * 1024
NO_CHANGES = "no changes"
STAT_SUMMARY, STAT_FILE = r"(\d+) files? changed.*", r"^\s+\S.*\|\s*\d+"
PLUMBING = r"^(?:index |similarity index |dissimilarity index )"
STAT_OPTION = r"(?i)(?:^|\s)--(?:stat|shortstat|numstat)(?:=\S*)?(?:\s|$)"


def is_change(line: Column) -> Column:
    return (line.startswith("+") & ~line.startswith("+++")) | (line.startswith("-") & ~line.startswith("---"))


def kept_positions(body: Column) -> Column:
    """Sorted 0-based positions of the lines an over-long hunk keeps.

    The budget goes to the changes first (all, or both ends of them). What is left
    buys context in a fixed order, so the choice needs no line-by-line search: the
    line above the first change, everything after it from top to bottom, the two
    lines next above, then up to forty lines from the top and the rest upwards.
    """
    none = F.array().cast("array<int>")

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)

    def span(start: Column, n: Column) -> Column:
        return F.transform(upto(n), lambda i: i + start)

    def build(p: Column) -> Column:
        n, ch = p["n"], p["ch"]
        ends = F.concat(F.slice(ch, 1, HUNK_HEAD), F.slice(ch, F.size(ch) - HUNK_TAIL + 1, HUNK_TAIL))
        bare = F.concat(upto(F.lit(HUNK_HEAD)), span(n - HUNK_TAIL, F.lit(HUNK_TAIL)))
        return F.when(F.size(ch) == 0, bare).when(F.size(ch) > HUNK_BUDGET, ends).otherwise(let(F.struct(
            n.alias("n"), ch.alias("ch"), F.element_at(ch, 1).alias("f"), p["ctx"].alias("ctx"),
            (F.lit(HUNK_BUDGET) - F.size(ch)).alias("room")), fill))

    def fill(p: Column) -> Column:
        f, room = p["f"], p["room"]
        after = F.filter(p["ctx"], lambda i: i > f)
        above = F.when((room > 0) & (f >= 1), 1).otherwise(0)
        return let(F.struct(p["ch"].alias("ch"), f.alias("f"), above.alias("above"), F.slice(after, 1, room - above).alias("after"),
                            F.greatest(room - above - F.size(after), F.lit(0)).alias("left")), rest)

    def rest(p: Column) -> Column:
        f, left = p["f"], p["left"]
        near = F.slice(F.filter(F.array(f - 3, f - 2), lambda i: i >= 0), 1, left)
        head_rows = F.greatest(f - 3, F.lit(0))
        spare = left - F.size(near)
        top = F.least(F.lit(HUNK_HEAD), spare, head_rows)
        up = F.least(spare - top, head_rows - top)
        return F.array_sort(F.concat(
            p["ch"], F.when(p["above"] == 1, F.array(f - 1)).otherwise(none), p["after"], near, upto(top), span(head_rows - up, up)))

    changes = F.array_compact(F.transform(body, lambda x, i: F.when(is_change(x), i)))
    context = F.array_compact(F.transform(body, lambda x, i: F.when(~is_change(x), i)))
    return let(F.struct(F.size(body).alias("n"), changes.alias("ch"), context.alias("ctx")), build)


def _blocks(lines: Column) -> Column:
    """array<struct(at, rows)>: lines from a file or hunk header to the next, the
    lines in front of the first header as their own block; ``at`` is 1-based."""
    starts = F.array_compact(F.transform(lines, lambda x, i: F.when(
        (i == 0) | x.startswith("@@ ") | x.startswith("diff --git "), i + 1)))
    return let(F.struct(lines.alias("l"), starts.alias("s")), lambda p: F.transform(p["s"], lambda s, j: F.struct(
        s.alias("at"), F.slice(p["l"], s, F.coalesce(F.get(p["s"], j + 1), F.size(p["l"]) + 1) - s).alias("rows"))))


def _is_hunk(block: Column) -> Column:
    return F.element_at(block["rows"], 1).startswith("@@ ")


def unified_sample(text: Column) -> Column:
    """Diff with every hunk cut to its budget and the whole cut to 360 lines or 6 KiB."""
    blocks = _blocks(lines_of(text))

    def over(b: Column) -> Column:
        return _is_hunk(b) & (F.size(b["rows"]) - 1 > HUNK_BUDGET)

    def candidates(bs: Column) -> Column:
        return F.flatten(F.transform(bs, lambda b: F.when(~_is_hunk(b), plain(b)).when(over(b), sampled(b)).otherwise(whole(b))))

    def item(text_: Column, end: Column) -> Column:
        return F.struct(end.alias("end"), text_.alias("text"))

    def plain(b: Column) -> Column:
        return F.filter(whole(b), lambda c: ~c["text"].rlike(PLUMBING))

    def whole(b: Column) -> Column:
        return F.transform(b["rows"], lambda x, k: item(x, b["at"] + k))

    def sampled(b: Column) -> Column:
        body = F.slice(b["rows"], 2, F.size(b["rows"]))
        return let(F.struct(b["at"].alias("at"), F.element_at(b["rows"], 1).alias("head"), body.alias("body"),
                            kept_positions(body).alias("keep")), lambda p: F.concat(F.array(item(p["head"], p["at"])), with_gaps(p)))

    def with_gaps(p: Column) -> Column:
        rows = F.transform(p["keep"], lambda k: item(F.element_at(p["body"], k + 1), p["at"] + k + 1))
        edges = F.concat(p["keep"], F.array(F.size(p["body"])))
        gaps = F.array_compact(F.transform(edges, lambda k, j: let(F.coalesce(F.get(edges, j - 1), F.lit(-1)), lambda prev: F.when(
            k - prev > 1, item(F.format_string("... (%d hunk lines omitted) ...", k - prev - 1), p["at"] + k)))))
        return F.array_sort(F.concat(rows, gaps))

    def cut(p: Column) -> Column:
        def grow(a: Column, c: Column) -> Column:
            add = F.octet_length(c["text"]) + 1
            stop = a["stop"] | ((a["n"] > 0) & (a["bytes"] + add > MAX_BYTES))
            return F.struct(F.when(stop, a["n"]).otherwise(a["n"] + 1).alias("n"),
                            F.when(stop, a["bytes"]).otherwise(a["bytes"] + add).alias("bytes"), stop.alias("stop"))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes"), F.lit(False).alias("stop"))
        n = F.aggregate(F.slice(p["c"], 1, MAX_LINES), start, grow, lambda a: a["n"])
        return let(n, lambda k: let(F.slice(p["c"], 1, k), lambda s: join_lines(F.concat(
            F.transform(s, lambda c: c["text"]),
            F.when(k < F.size(p["c"]), F.array(F.format_string(
                "... (%d diff lines omitted) ...", F.greatest(F.lit(1), p["total"] - F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(0)))))
            ).otherwise(F.array().cast("array<string>"))))))

    return let(blocks, lambda bs: let(F.struct(
        candidates(bs).alias("c"), F.aggregate(bs, F.lit(0), lambda a, b: a + F.size(b["rows"])).alias("total")), cut))


def has_unified_headers(text: Column) -> Column:
    def has(ls: Column) -> Column:
        hunk = any_line(ls, lambda x: x.startswith("diff --git ") | x.startswith("@@ ") | x.startswith("Binary files "))
        old = any_line(ls, lambda x: x.startswith("--- "))
        new = any_line(ls, lambda x: x.startswith("+++ "))
        return hunk | (old & new)
    return let(lines_of(text), has)


def diff_counts(text: Column) -> Column:
    """struct(additions, deletions)."""
    return let(lines_of(nn(text)), lambda ls: F.struct(
        F.size(F.filter(ls, lambda x: x.startswith("+") & ~x.startswith("+++"))).alias("additions"),
        F.size(F.filter(ls, lambda x: x.startswith("-") & ~x.startswith("---"))).alias("deletions")))


def stat_text(text: Column, verbose: Column) -> Column:
    """The stat summary line, with the file lines when asked for."""
    t = nn(text)
    summary = trim_ctl(F.regexp_extract(t, STAT_SUMMARY, 0))
    files = F.transform(F.filter(lines_of(t), lambda x: x.rlike(STAT_FILE)), lambda x: F.concat(F.lit("  "), trim_ctl(x)))
    detail = strip_trailing(F.concat(summary, F.lit("\n"), join_lines(files)))
    body = strip_trailing(t)
    return F.when(t.rlike(STAT_SUMMARY), F.when(verbose >= 2, detail).otherwise(summary)).when(
        is_blank(body), F.lit(NO_CHANGES)).otherwise(body)


def diff_summary(text: Column, command: Column, ultra_compact: Column, verbose: Column) -> Column:
    """Sampled diff, counts in compact mode, or the stat summary."""
    t = nn(text)
    unified = has_unified_headers(t) & ~(nn(command).rlike(STAT_OPTION) & ~t.contains("diff --git "))
    counts = let(diff_counts(t), lambda c: F.format_string("+%d / -%d lines", c["additions"], c["deletions"]))
    out = F.when(unified & ultra_compact, counts).when(unified, unified_sample(t)).otherwise(stat_text(t, verbose))
    return let(out, lambda o: F.when(is_blank(o), F.lit(NO_CHANGES)).otherwise(o))
