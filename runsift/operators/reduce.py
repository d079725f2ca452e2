"""Line reduction. Each function maps a text column to a reduced text column.

A run's output is one row, so these stay inside the row: no shuffle, no window,
and a corpus scales by splitting files. Forms that produce *tables* of keys
(`group_lines`, `count_keys`, `path_table`) live further down and aggregate with
a map-side partial step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.functions.text import (
    SPACE_WS,
    drop_first,
    drop_overwritten,
    is_blank,
    join_lines,
    let,
    lines_of,
    nn,
    non_blank,
    strip_trailing,
    strip_ws,
    trim_ctl,
)

# Sizes and texts that decide what a reader sees.
DEDUP_WINDOW = 50
TREE_MAX_FILES = 8
SMALL_RESULT = 40
MAX_PER_FILE = 12
MAX_MATCHES = 80
MAX_PATHS = 100
DOC_MAX_LINES, DOC_HEAD, DOC_TAIL = 200, 120, 60
JSON_VERBATIM_BYTES = 32 * 1024
JSON_DEPTH = 6
LOG_TAIL = 20
LOG_TOP = 10
CSI = r"\x1B\[[0-9;]*[mGKHFJABCDsu]"
UNHEALTHY = r"(?i)Error|CrashLoopBackOff|OOMKilled|Pending|Terminating"
REPEAT_SUFFIX = r"\s+\(×\d+\)$"

_FOLD_BLOCK = 512


def ansi_strip(text: Column) -> Column:
    """Drop carriage-return progress text, then terminal escape codes."""
    return F.regexp_replace(drop_overwritten(nn(text)), CSI, "")


def last_meaningful_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(non_blank(lines_of(ansi_strip(text))), F.lit(-1)), F.lit(""))


def head_tail(text: Column, head: int, tail: int) -> Column:
    """First ``head`` and last ``tail`` lines around an omission marker."""
    def cut(lines: Column) -> Column:
        n = F.size(lines)
        marker = F.format_string(
            f"... (%d lines omitted: lines {head + 1}..%d of %d) ...", n - (head + tail), n - tail, n)
        last = F.slice(lines, n - tail + 1, tail) if tail else F.array().cast("array<string>")
        kept = F.concat(F.slice(lines, 1, head), F.array(marker), last)
        return F.when(n <= head + tail, text).otherwise(strip_trailing(join_lines(kept)))
    return let(lines_of(text), cut)


def tail_lines(text: Column, max_lines: int, skip_blank: bool = False,
               header_only_when_truncating: bool = True) -> Column:
    def cut(lines: Column) -> Column:
        n = F.size(lines)
        body = join_lines(lines)
        header = F.format_string("... (%d lines omitted: lines 1..%d of %d) ...\n",
                                 n - max_lines, n - max_lines, n)
        cut_text = F.concat(header, join_lines(F.slice(lines, n - max_lines + 1, max_lines)))
        whole = body if header_only_when_truncating else F.concat(
            F.format_string("... (0 lines omitted: showing all %d lines) ...\n", n), body)
        return F.when(n <= max_lines, whole).otherwise(cut_text)
    lines = lines_of(text)
    return let(non_blank(lines) if skip_blank else lines, cut)


def fold_lines(lines: Column, fields: Mapping[str, Column],
               step: Callable[[Column, Column], tuple[Mapping[str, Column], Column]]) -> Column:
    """Ordered fold over lines with named state and an output array.

    ``step(state, line)`` gives the next field values and an array of lines to
    emit. Output is gathered per block and the blocks are joined, so a run of n
    lines copies about n * block elements instead of n * n.
    """
    names = list(fields)
    empty = F.array().cast("array<string>")

    def start(values: Mapping[str, Column]) -> Column:
        return F.struct(*[values[k].alias(k) for k in names], empty.alias("out"))

    def one(acc: Column, line: Column) -> Column:
        values, emitted = step(acc, line)
        return F.struct(*[values[k].alias(k) for k in names], F.concat(acc["out"], emitted).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        part = F.slice(lines, b * _FOLD_BLOCK + 1, _FOLD_BLOCK)
        inner = F.aggregate(part, start({k: acc[k] for k in names}), one)
        return let(inner, lambda r: F.struct(
            *[r[k].alias(k) for k in names], F.concat(acc["out"], r["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(lines) - 1, F.lit(0)) / _FOLD_BLOCK).cast("int"))
    return F.aggregate(blocks, start(fields), block)


def deduplicate(text: Column, window: int = DEDUP_WINDOW) -> Column:
    """Fold repeats of a trimmed line into its first occurrence as `` (×N)``.

    A repeat counts while its first occurrence is among the last ``window``
    distinct lines inserted; a repeat does not refresh that age. Texts without
    repeats pass through, texts with at most ``window`` distinct lines are a
    per-key count, and only the rest pay for the ordered fold.
    """
    def suffixed(line: Column, cnt: Column) -> Column:
        base = strip_trailing(F.regexp_replace(line, REPEAT_SUFFIX, ""))
        return F.when(cnt == 1, line).otherwise(F.concat(base, F.format_string(" (×%d)", cnt)))

    def counted(p: Column) -> Column:
        return join_lines(F.transform(
            p["distinct"],
            lambda k: suffixed(F.element_at(p["lines"], F.array_position(p["keys"], k).cast("int")),
                               F.size(F.filter(p["keys"], lambda x: x == k)))))

    def render(entry: Column) -> Column:
        return suffixed(entry["line"], entry["cnt"])

    live0 = F.array().cast("array<struct<key:string,line:string,cnt:int>>")

    def step(state: Column, line: Column):
        live = state["live"]
        key = trim_ctl(line)
        hit = F.exists(live, lambda e: e["key"] == key)
        full = F.size(live) >= window
        bumped = F.transform(live, lambda e: F.struct(
            e["key"].alias("key"), e["line"].alias("line"),
            F.when(e["key"] == key, e["cnt"] + 1).otherwise(e["cnt"]).alias("cnt")))
        entry = F.array(F.struct(key.alias("key"), line.alias("line"), F.lit(1).alias("cnt")))
        grown = F.concat(F.when(full, drop_first(live, 1)).otherwise(live), entry)
        evicted = F.when(~hit & full, F.array(render(F.element_at(live, 1)))).otherwise(
            F.array().cast("array<string>"))
        return {"live": F.when(hit, bumped).otherwise(grown)}, evicted

    def folded(p: Column) -> Column:
        return let(fold_lines(p["lines"], {"live": live0}, step),
                   lambda r: join_lines(F.concat(r["out"], F.transform(r["live"], render))))

    packed = let(lines_of(nn(text)), lambda ls: let(
        F.transform(ls, lambda x: trim_ctl(x)),
        lambda ks: F.struct(ls.alias("lines"), ks.alias("keys"), F.array_distinct(ks).alias("distinct"))))
    return let(packed, lambda p: F.when(F.size(p["distinct"]) == F.size(p["lines"]), join_lines(p["lines"]))
               .when(F.size(p["distinct"]) <= window, counted(p))
               .otherwise(folded(p)))


def _run_counts(keys: Column) -> Column:
    """array<struct<neg,key>> of a key array, count descending then key ascending.

    Sorting brings equal keys together, so the boundaries give every count in one
    pass instead of one pass per distinct key.
    """
    def build(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (
            F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return let(starts, lambda st: F.array_sort(F.transform(st, lambda i, j: F.struct(
            (i - F.coalesce(F.get(st, j + 1), n + 1)).alias("neg"), F.element_at(s, i).alias("key")))))
    return F.when(F.size(keys) == 0, F.array().cast("array<struct<neg:int,key:string>>")).otherwise(
        let(F.array_sort(keys), build))


def _first_counts(keys: Column) -> Column:
    """array<struct<key,pos,neg>> of a key array: first position and count of every key, in key order, from one sort."""
    def build(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when(
            (i == 0) | (F.get(s, i - 1)["key"] != x["key"]), i)))
        return let(starts, lambda st: F.transform(st, lambda i, j: F.struct(
            F.get(s, i)["key"].alias("key"), F.get(s, i)["pos"].alias("pos"),
            (i - F.coalesce(F.get(st, j + 1), F.size(s))).alias("neg"))))
    return let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), (i + 1).alias("pos")))), build)


def ranked_counts(keys: Column) -> Column:
    """array<struct<neg,pos,key>>: most frequent first, ties by first appearance."""
    return F.array_sort(F.transform(_first_counts(keys), lambda c: F.struct(
        c["neg"].alias("neg"), c["pos"].alias("pos"), c["key"].alias("key"))))


def _aligned(pairs: Column) -> Column:
    key_w = F.array_max(F.transform(pairs, lambda p: F.char_length(p["key"])))
    cnt_w = F.length(F.array_max(F.transform(pairs, lambda p: -p["neg"])).cast("string"))
    row = F.transform(pairs, lambda p: F.concat(
        F.lit("  "), p["key"], F.repeat(F.lit(" "), key_w - F.char_length(p["key"])), F.lit(" : "),
        F.repeat(F.lit(" "), cnt_w - F.length((-p["neg"]).cast("string"))), (-p["neg"]).cast("string")))
    return F.when(F.size(pairs) == 0, F.lit("")).otherwise(strip_trailing(join_lines(row)))


def grouping(text: Column, pattern: Column | str = "(.*)", include_other: Column | bool = False) -> Column:
    """Counts by trimmed capture 1 of the first find, as an aligned block."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    other_on = F.lit(include_other) if isinstance(include_other, bool) else include_other

    def build(lines: Column) -> Column:
        # a pattern column is matched through regexp_instr, which keeps the compiled
        # pattern while the value repeats
        hits = F.filter(lines, lambda x: x.rlike(pattern) if isinstance(pattern, str) else F.regexp_instr(x, pat) > 0)
        keys = F.transform(hits, lambda x: trim_ctl(F.call_function("regexp_extract", x, pat, F.lit(1))))
        misses = F.size(lines) - F.size(hits)
        others = F.when(other_on & (misses > 0), F.array_repeat(F.lit("(other)"), misses)).otherwise(
            F.array().cast("array<string>"))
        real = F.filter(keys, lambda k: ~(other_on & (misses > 0) & (k == "(other)")))
        return let(_run_counts(F.concat(real, others)), _aligned)
    return let(lines_of(nn(text)), build)


# The two key presets and their labels for lines without a key.
KEY_PREFIX = "prefix_before_colon"
KEY_EXTENSION = "file_extension"


def line_key(line: Column, key: str) -> Column:
    if key == KEY_PREFIX:
        return F.when(F.instr(line, ":") > 1, F.substring_index(line, ":", 1)).otherwise(F.lit("(stdin)"))
    if key == KEY_EXTENSION:
        return F.when(line.contains("."), F.concat(F.lit("."), F.substring_index(line, ".", -1))) \
            .otherwise(F.lit("(no extension)"))
    raise ValueError(f"unknown key preset: {key}")


def aggregate_by_key(text: Column, key: str, header: Column | str, top_n: Column | int) -> Column:
    """Header line plus the ``top_n`` most frequent keys, ties by first appearance."""
    head = F.lit(header) if isinstance(header, str) else header
    top = F.lit(top_n) if isinstance(top_n, int) else top_n

    def build(lines: Column) -> Column:
        return let(ranked_counts(F.transform(lines, lambda x: line_key(x, key))), lambda ranked: render(lines, ranked))

    def render(lines: Column, ranked: Column) -> Column:
        title = F.replace(F.replace(head, F.lit("{lines}"), F.size(lines).cast("string")),
                          F.lit("{keys}"), F.size(ranked).cast("string"))
        rows = F.transform(F.slice(ranked, 1, top), lambda c: F.concat(
            F.lit("  "), c["key"], F.lit(": "), (-c["neg"]).cast("string")))
        sep = F.when(title.endswith("\n"), F.lit("")).otherwise(F.lit("\n"))
        sep = F.when(title == "", F.lit("")).otherwise(sep)
        return strip_trailing(F.concat(title, sep, join_lines(rows)))
    return let(non_blank(lines_of(nn(text))), build)


def regex_capture(text: Column, pattern: str, fmt: str | None = None, fallback: str = "",
                  groups: int | None = None) -> Column:
    """First match in the whole text, put into a ``$0..$n`` template."""
    n = groups if groups is not None else _group_count(pattern)
    out = F.lit("$0" if fmt is None else fmt)
    for i in range(n, -1, -1):
        out = F.replace(out, F.lit(f"${i}"), F.coalesce(F.regexp_extract(text, pattern, i), F.lit("")))
    return F.when(text.rlike(pattern), out).otherwise(F.lit(fallback or ""))


def _group_count(pattern: str) -> int:
    """Capturing groups: opening brackets that are neither escaped, classed nor marked ``(?``."""
    depth_class, count, i = False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            depth_class = True
        elif c == "]":
            depth_class = False
        elif c == "(" and not depth_class and pattern[i + 1:i + 2] != "?":
            count += 1
        i += 1
    return count


def state_machine(text: Column, initial: str, transitions: Sequence[Mapping[str, str]],
                  defaults: Mapping[str, str] | None = None) -> Column:
    """Per line, the first transition of the current state whose pattern finds
    decides whether the line stays and which state follows; otherwise the state's
    default action decides, and without a default the line goes."""
    defaults = defaults or {}

    def pick(state: Column, line: Column, value: Callable[[Mapping[str, str]], Column], rest: Column) -> Column:
        out = None
        for t in transitions:
            cond = (state == t["from_state"]) & line.rlike(t["pattern"])
            out = F.when(cond, value(t)) if out is None else out.when(cond, value(t))
        return rest if out is None else out.otherwise(rest)

    def step(acc: Column, line: Column):
        state = acc["state"]
        default_emit = state.isin([s for s, a in defaults.items() if (a or "EMIT").upper() == "EMIT"]) \
            if defaults else F.lit(False)
        emit = pick(state, line, lambda t: F.lit((t.get("action") or "EMIT").upper() == "EMIT"), default_emit)
        nxt = pick(state, line, lambda t: F.lit(t["next_state"]), state)
        return {"state": nxt}, F.when(emit, F.array(line)).otherwise(F.array().cast("array<string>"))

    return let(lines_of(nn(text)), lambda ls: let(
        fold_lines(ls, {"state": F.lit(initial)}, step), lambda r: join_lines(r["out"])))


def _paths(text: Column) -> Column:
    """Trimmed, slash-normalised, non-blank paths of a listing."""
    return F.filter(F.transform(lines_of(nn(text)),
                                lambda x: F.replace(trim_ctl(x), F.lit("\\"), F.lit("/"))),
                    lambda x: ~is_blank(x))


def dir_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)).otherwise(F.lit("."))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def tree_compression(text: Column) -> Column:
    """Directory outline; a directory with more than eight files shows its count.

    One entry per file and one per directory are sorted by path components, so
    depth needs no recursion: a directory's own entry sorts in front of its files
    and starts its block. Directories that only appear as parents are listed too,
    so every file stays visible.
    """
    def entry(parts: Column, pos: Column, name: Column) -> Column:
        return F.struct(parts.alias("dir"), pos.alias("pos"), name.alias("name"))

    def build(paths: Column) -> Column:
        files = F.transform(paths, lambda p, i: entry(F.split(dir_of(p), "/"), i + 1, name_of(p)))
        own = F.array_distinct(F.transform(paths, lambda p: dir_of(p)))
        # distinct on joined paths: arrays would be compared pairwise
        parents = F.array_distinct(F.flatten(F.transform(own, lambda d: let(F.split(d, "/"), lambda ps: F.transform(
            F.sequence(F.lit(1), F.size(ps)), lambda k: F.array_join(F.slice(ps, 1, k), "/"))))))
        heads = F.transform(parents, lambda d: entry(F.split(d, "/"), F.lit(0), F.lit("")))
        return let(F.array_sort(F.concat(heads, files)), blocks)

    def blocks(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(e)), lambda i: F.element_at(e, i)["pos"] == 0)
        return let(starts, lambda st: strip_trailing(join_lines(F.flatten(F.transform(st, lambda i, j: block(
            F.slice(e, i, F.coalesce(F.get(st, j + 1), F.size(e) + 1) - i)))))))

    def block(rows: Column) -> Column:
        def render(r: Column) -> Column:
            parts = F.element_at(r, 1)["dir"]
            pad = F.repeat(F.lit("  "), F.size(parts) - 1)
            n = F.size(r) - 1
            listed = F.transform(drop_first(r, 1), lambda x: F.concat(pad, F.lit("  "), x["name"]))
            body = F.when(n > TREE_MAX_FILES, F.array(F.concat(pad, F.format_string("  (%d files)", n)))).otherwise(listed)
            return F.concat(F.array(F.concat(pad, F.element_at(parts, -1), F.lit("/"))), body)
        return let(rows, render)
    return let(_paths(text), lambda p: F.when(F.size(p) == 0, F.lit("")).otherwise(build(p)))


def empty_tree_fallback(tree: Column, stdout: Column) -> Column:
    return F.when(is_blank(tree), F.concat(F.size(non_blank(lines_of(nn(stdout)))).cast("string"),
                                           F.lit(" items"))).otherwise(tree)


@F.pandas_udf(T.StringType())
def _json_skeleton(texts: pd.Series) -> pd.Series:
    import json

    def shape(v, depth):
        if depth >= JSON_DEPTH:
            return "..."
        if isinstance(v, dict):
            return {k: shape(x, depth + 1) for k, x in v.items()}
        if isinstance(v, list):
            rest = [f"... +{len(v) - 1} more"] if len(v) > 1 else []
            return [shape(x, depth + 1) for x in v[:1]] + rest
        if isinstance(v, bool):
            return False
        if isinstance(v, str):
            return "<string>"
        return None if v is None else 0

    def show(v, pad=""):
        if isinstance(v, dict):
            inner = ",\n".join(f"{pad}  {json.dumps(k, ensure_ascii=False)} : {show(x, pad + '  ')}"
                               for k, x in v.items())
            return "{\n" + inner + f"\n{pad}}}" if v else "{ }"
        if isinstance(v, list):
            return "[ " + ", ".join(show(x, pad) for x in v) + " ]" if v else "[ ]"
        return json.dumps(v, ensure_ascii=False)

    def one(t):
        try:
            return None if t is None else show(shape(json.loads(t), 0))
        except (ValueError, RecursionError):
            return t
    return texts.map(one)


def json_structure(text: Column, active: Column | bool = True) -> Column:
    """JSON value to a type skeleton; text that is not JSON is unchanged.

    JSON nests freely, so the reshaping runs in Arrow batches; only rows that
    start like JSON are handed over, the others travel as NULL.
    """
    live = F.lit(active) if isinstance(active, bool) else active
    looks = live & text.rlike(r"^\s*[\{\[\"0-9tfn-]")
    return F.coalesce(_json_skeleton(F.when(looks, text)), text)


def large_document(text: Column, ultra_compact: Column | bool = False, active: Column | bool = True) -> Column:
    """Long text to head and tail, large JSON to its skeleton, the rest verbatim."""
    compact = F.lit(ultra_compact) if isinstance(ultra_compact, bool) else ultra_compact
    first = trim_ctl(F.coalesce(F.try_element_at(lines_of(text), F.lit(1)), F.lit("")))
    is_json = first.startswith("{") | first.startswith("[")
    oversize = compact | (F.octet_length(text) > JSON_VERBATIM_BYTES)
    body = trim_ctl(text)
    live = F.lit(active) if isinstance(active, bool) else active
    skeleton = _json_skeleton(F.when(live & is_json & oversize, body))
    omitted = F.greatest(F.lit(0), F.octet_length(text) - F.octet_length(skeleton))
    shown = F.when(skeleton == body, text).otherwise(
        F.concat(F.format_string("... (JSON skeleton, %d bytes omitted) ...\n", omitted), skeleton))
    return F.when(is_json & ~oversize, text).when(is_json, shown).when(
        F.size(lines_of(text)) > DOC_MAX_LINES, head_tail(text, DOC_HEAD, DOC_TAIL)).otherwise(text)


def hit_file(line: Column) -> Column:
    """File part of a ``file:line: text`` hit; a drive letter's colon is not the separator."""
    drive = line.rlike(r"^\p{L}:[\\/]")
    return F.when(drive, F.regexp_extract(line, r"(?s)^(..[^:]*)", 1)).otherwise(F.substring_index(line, ":", 1))


def search_result_sample(text: Column) -> Column:
    """Up to 40 hits verbatim; beyond that at most 12 per file and 80 in all."""
    def build(lines: Column) -> Column:
        tagged = F.transform(lines, lambda x: F.struct(hit_file(x).alias("f"), strip_ws(x).alias("l")))
        return let(tagged, lambda t: let(F.array_distinct(F.transform(t, lambda x: x["f"])),
                                         lambda fs: render(t, fs)))

    def render(t: Column, files: Column) -> Column:
        picked = F.flatten(F.transform(
            F.slice(files, 1, MAX_MATCHES),
            lambda f: F.transform(F.slice(F.filter(t, lambda x: x["f"] == f), 1, MAX_PER_FILE), lambda x: x["l"])))
        shown = F.slice(picked, 1, MAX_MATCHES)
        head = F.format_string("%d match(es) in %d file(s)\n", F.size(t), F.size(files))
        omitted = F.size(t) - F.size(shown)
        note = F.when(omitted > 0, F.format_string("\n... (%d matches omitted) ...", omitted)).otherwise(F.lit(""))
        return strip_trailing(F.concat(head, join_lines(shown), note))
    return let(non_blank(lines_of(nn(text))), lambda ls: F.when(
        F.size(ls) <= SMALL_RESULT, nn(text)).otherwise(build(ls)))


def path_listing_sample(text: Column) -> Column:
    """Up to 40 paths verbatim; beyond that the first 100 by directory and an extension count."""
    def folder(p: Column) -> Column:
        return F.regexp_extract(p, r"(?s)^(.*)[/\\][^/\\]*\z", 1)

    def leaf(p: Column) -> Column:
        return F.regexp_extract(p, r"([^/\\]*)\z", 1)

    def build(paths: Column) -> Column:
        exts = F.filter(F.transform(paths, lambda p: F.regexp_extract(leaf(p), r"(?s)^.+(\.[^.]+)\z", 1)),
                        lambda e: e != "")
        return let(F.struct(paths.alias("p"), F.slice(paths, 1, MAX_PATHS).alias("v"), exts.alias("e")), render)

    def render(s: Column) -> Column:
        n = F.size(s["p"])
        dirs = F.array_distinct(F.transform(s["v"], lambda p: folder(p)))
        rows = F.transform(dirs, lambda d: let(
            F.transform(F.filter(s["v"], lambda p: folder(p) == d), lambda p: leaf(p)),
            lambda ns: F.when(d == "", join_lines(ns)).otherwise(F.concat(d, F.lit("/: "), F.array_join(ns, ", ")))))
        more = F.when(n > MAX_PATHS, F.format_string("... (%d paths omitted) ...\n", n - MAX_PATHS)).otherwise(F.lit(""))
        hist = F.array_join(F.transform(F.array_distinct(s["e"]), lambda e: F.concat(
            e, F.lit(": "), F.size(F.filter(s["e"], lambda x: x == e)).cast("string"))), ", ")
        tail = F.when(F.size(s["e"]) > 0, F.concat(F.lit(" — "), hist)).otherwise(F.lit(""))
        return F.concat(join_lines(rows), F.lit("\n"), more, n.cast("string"), F.lit(" result(s)"), tail)
    paths = F.filter(F.transform(lines_of(nn(text)), lambda x: strip_ws(x)), lambda x: x != "")
    return let(paths, lambda p: F.when(F.size(p) <= SMALL_RESULT, nn(text)).otherwise(build(p)))


def unhealthy_first(text: Column, command: Column) -> Column:
    """Cluster tables with failing rows first; logs to their last 20 lines."""
    def table(lines: Column) -> Column:
        rest = drop_first(lines, 1)
        bad = F.filter(rest, lambda x: x.rlike(UNHEALTHY))
        good = F.concat(F.slice(lines, 1, 1), F.filter(rest, lambda x: ~x.rlike(UNHEALTHY)))
        flagged = F.transform(bad, lambda x: F.concat(F.lit("  ⚠ "), trim_ctl(x)))
        block = F.when(F.size(bad) > 0, F.concat(F.lit("UNHEALTHY PODS:\n"), join_lines(flagged), F.lit("\n\n"))) \
            .otherwise(F.lit(""))
        return strip_trailing(F.concat(block, join_lines(good)))
    cmd = nn(command)
    return F.when(cmd.contains("get") | cmd.contains("describe"), let(lines_of(nn(text)), table)) \
        .when(cmd.contains("logs"), tail_lines(nn(text), LOG_TAIL)).otherwise(nn(text))


def git_log_top(text: Column, verbose: Column | int = 0, ultra_compact: Column | bool = False) -> Column:
    """Short hash and subject of the first ten commits."""
    verb = F.lit(verbose) if isinstance(verbose, int) else verbose
    compact = F.lit(ultra_compact) if isinstance(ultra_compact, bool) else ultra_compact
    # A commit's block runs to the next commit line; its subject is the first line
    # that is neither blank nor a header.
    marked = F.regexp_replace(nn(text), r"(?m)^(commit [0-9a-f]{8})", "\u0000$1")
    blocks = drop_first(F.split(marked, "\u0000"), 1)

    def subject(block: Column) -> Column:
        body = F.filter(drop_first(lines_of(block), 1), lambda x: ~is_blank(x) & ~x.rlike(r"^(?:Author:|Date:|Merge:)"))
        return F.concat(F.substring(block, 8, 8), F.lit(" "), trim_ctl(F.try_element_at(body, F.lit(1))))

    def render(commits: Column) -> Column:
        n = F.size(commits)
        limit = F.when(verb >= 2, n).otherwise(F.least(F.lit(LOG_TOP), n))
        more = F.when(~compact & (n > limit), F.format_string("\n(+%d more)", n - limit)).otherwise(F.lit(""))
        return F.when(n == 0, F.lit("(no commits)")).otherwise(
            F.concat(join_lines(F.slice(commits, 1, limit)), more))
    return let(F.filter(F.transform(blocks, lambda b: subject(b)), lambda c: c.isNotNull()), render)


# --- table forms ------------------------------------------------------------------
# One row per key. Counting combines on the map side, and the per-run top-k keeps
# at most k rows per run and task in front of its shuffle.

def exploded(df: DataFrame, text: str = "text", key: str = "run_id") -> DataFrame:
    return df.select(key, F.posexplode(lines_of(nn(F.col(text)))).alias("line_no", "line"))


def group_lines(df: DataFrame, pattern: str, include_other: bool = False, key: str = "run_id") -> DataFrame:
    """(run_id, key, cnt, rank) of the trimmed capture 1, count descending then key."""
    lines = exploded(df, key=key)
    hit = F.col("line").rlike(pattern)
    name = trim_ctl(F.regexp_extract("line", pattern, 1))
    rows = lines.select(key, F.when(hit, name).otherwise(F.lit("(other)")).alias("key")) if include_other \
        else lines.where(hit).select(key, name.alias("key"))
    counts = rows.groupBy(key, "key").agg(F.count("*").alias("cnt"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("cnt"), "key")))


def count_keys(df: DataFrame, preset: str, top_n: int, key: str = "run_id") -> DataFrame:
    """(run_id, key, cnt, rank) of a key preset, top ``top_n``, ties by first appearance."""
    lines = exploded(df, key=key).where(~is_blank(F.col("line")))
    counts = lines.groupBy(key, line_key(F.col("line"), preset).alias("key")).agg(
        F.count("*").alias("cnt"), F.min("line_no").alias("_first"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("cnt"), "_first")))
    return ranked.where(F.col("rank") <= top_n).select(key, "key", "cnt", "rank")


def _path_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode(_paths(F.col("text"))).alias("line_no", "path"))


def directory_counts(df: DataFrame, key: str = "run_id") -> DataFrame:
    """Files per directory and whether an outline would show only the count."""
    return _path_rows(df, key).groupBy(key, dir_of(F.col("path")).alias("dir")).agg(
        F.count("*").alias("files"), (F.count("*") > TREE_MAX_FILES).alias("collapsed"))


def extension_counts(df: DataFrame, key: str = "run_id") -> DataFrame:
    ext = F.regexp_extract(name_of(F.col("path")), r"(?s)^.+(\.[^.]+)\z", 1)
    counts = _path_rows(df, key).withColumn("key", ext).where("key <> ''").groupBy(key, "key").agg(
        F.count("*").alias("cnt"), F.min("line_no").alias("_first"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("cnt"), "_first")))
    return ranked.select(key, "key", "cnt", "rank")


def json_profile(df: DataFrame, by: str = "command") -> DataFrame:
    """Documents and their top-level fields with types, per command.

    The merged variant schema gives one line per command however many documents
    it read; texts that are not JSON count as documents without fields.
    """
    v = F.try_parse_json("text")
    merged = df.select(by, v.alias("v")).groupBy(by).agg(
        F.count("*").alias("documents"), F.schema_of_variant_agg("v").alias("_s"))
    names = F.regexp_replace(F.regexp_replace("_s", r"^OBJECT<|>$", ""), r"\b(?:BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE)", "number")
    return merged.select(by, "documents", F.lower(F.replace(names, F.lit(": "), F.lit(":"))).alias("fields"))
