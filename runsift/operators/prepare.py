"""Run preparation: input choice, rule lookup, gates, command splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions import commands as C
from runsift.functions.text import is_blank, lines_of, nn, non_blank

# Input modes, gate thresholds and the notices of the file tools.
SELECT_DEFAULT = "stdout_or_stderr"
GREP_SMALL, FIND_SMALL, LS_SMALL = 40, 40, 10
NO_MATCHES, NO_RESULTS, EMPTY_DIR = "(no matches)", "(no results)", "(empty directory)"

# A dimension above this many rows is joined by a shuffle instead of a broadcast.
MAX_BROADCAST_ROWS = 100_000


def with_bound(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a dimension counted to be within the bound."""
    small = dim.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(dim) if small else dim


def select_input(stdout: Column, stderr: Column, exit_code: Column, mode: Column | str | None = None) -> Column:
    """Text a rule reads; the default takes both streams only for a failed run."""
    out, err = nn(stdout), nn(stderr)
    no_out, no_err = is_blank(out), is_blank(err)
    both = F.concat(out, F.lit("\n"), err)
    default = F.when((exit_code != 0) & ~no_err & ~no_out, both).when(no_out, err).otherwise(out)
    if mode is None:
        return default
    m = F.lower(F.trim(F.coalesce(F.lit(mode) if isinstance(mode, str) else mode, F.lit(""))))
    return (
        F.when(m == "stderr_then_stdout",
               F.when(no_err, out).when(no_out, err).otherwise(F.concat(err, F.lit("\n"), out)))
        .when(m == "stdout_then_stderr", F.when(no_out, err).when(no_err, out).otherwise(both))
        .when(m == "stdout", out)
        .when(m == "stderr", err)
        .otherwise(default)
    )


def combined_text(stdout: Column, stderr: Column) -> Column:
    out, err = nn(stdout), nn(stderr)
    return F.when(err == "", out).when(out == "", err).otherwise(F.concat(out, F.lit("\n"), err))


def project_fingerprint(path: Column) -> Column:
    blank = is_blank(nn(path))
    return F.when(blank, F.lit("0" * 12)).otherwise(F.substring(F.sha2(path, 256), 1, 12))


def lookup_prefixes(runs: DataFrame, dim: DataFrame, command: str, values: list[str],
                    max_words: int, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Longest-prefix lookup as one equi-join per prefix length.

    ``dim(prefix, *values)`` holds unique prefixes. Each join is on equality, so a
    bounded dimension is broadcast and the runs are never shuffled; there is no
    nested loop and no regrouping of runs.
    """
    norm = C.normalized(F.col(command))
    out = runs.withColumn("_norm", norm)
    for n in range(1, max_words + 1):
        side = dim.select(*[F.col(k) for k in extra_keys], F.col("prefix").alias(f"_p{n}"),
                          F.struct(*[F.col(v) for v in values]).alias(f"_v{n}"))
        out = out.withColumn(f"_p{n}", C.word_prefix(F.col("_norm"), n)).join(
            side, [*extra_keys, f"_p{n}"], "left")
    best = F.coalesce(*[F.col(f"_v{n}") for n in range(max_words, 0, -1)])
    out = out.withColumn("_best", best)
    for v in values:
        out = out.withColumn(v, F.col("_best")[v])
    drop = ["_norm", "_best"] + [f"_p{n}" for n in range(1, max_words + 1)] + [
        f"_v{n}" for n in range(1, max_words + 1)]
    return out.drop(*drop)


def prefix_words(rules: DataFrame) -> int:
    """Longest prefix of a rule table in words (one small aggregate)."""
    return rules.agg(F.max(F.size(F.split("prefix", " ")))).first()[0] or 1


def match_rule(runs: DataFrame, rules: DataFrame, max_words: int | None = None) -> DataFrame:
    """Add ``rule``: the owner of the longest matching command prefix, or NULL."""
    words = max_words or prefix_words(rules)
    return lookup_prefixes(runs, with_bound(rules.select("prefix", "rule")), "command", ["rule"], words)


def route_interpreter(rule: Column, command: Column) -> Column:
    """``python -m pytest`` reads like pytest; ``python -c`` stays verbatim."""
    norm = C.normalized(command)
    module = norm.rlike(r"^python3? -m pytest(?: |$)")
    inline = norm.rlike(r"^python3? -c(?: |$)")
    return F.when((module | inline) & command.contains("pytest"), F.lit("pytest")) \
        .when(inline, F.lit(None).cast("string")).otherwise(rule)


def resolve_tier(runs: DataFrame, project_rules: DataFrame, global_rules: DataFrame, rules: DataFrame) -> DataFrame:
    """Winning rule by tier: project, then global, then built-in.

    Override tables are ``(project,) key, file_order, rule``. Inside an override
    tier the exact command wins, then the first entry in file order that prefixes
    the command; the built-in tier takes the longest prefix. Adds ``rule``,
    ``tier`` and ``skipped`` (tiers passed over and why).
    """
    out = runs.withColumn("_cmd", F.lower(F.trim(F.coalesce("command", F.lit("")))))
    for tier, table, keys in (("project", project_rules, ("project",)), ("global", global_rules, ())):
        dim = table.withColumn("key", F.lower(F.trim("key")))
        # one entry per key: the first in file order
        dim = dim.groupBy(*keys, "key").agg(F.min(F.struct("file_order", "rule")).alias("e"))
        words = dim.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1
        dim = with_bound(dim)
        for n in range(1, words + 1):
            side = dim.select(*keys, F.col("key").alias(f"_k{n}"), F.col("e").alias(f"_e{n}"))
            out = out.withColumn(f"_k{n}", C.word_prefix(F.col("_cmd"), n)).join(side, [*keys, f"_k{n}"], "left")
        entries = F.array_compact(F.array(*[
            F.when(F.col(f"_e{n}").isNotNull(), F.struct(
                (F.col(f"_k{n}") != F.col("_cmd")).alias("inexact"), F.col(f"_e{n}")["file_order"].alias("file_order"),
                F.col(f"_e{n}")["rule"].alias("rule"))) for n in range(1, words + 1)]))
        out = out.withColumn(f"_{tier}", F.array_min(entries)["rule"])
        out = out.drop(*[f"_k{n}" for n in range(1, words + 1)], *[f"_e{n}" for n in range(1, words + 1)])
    out = match_rule(out, rules).withColumnRenamed("rule", "_builtin")
    tier = F.when(F.col("_project").isNotNull(), F.lit("project")).when(
        F.col("_global").isNotNull(), F.lit("global")).otherwise(F.lit("builtin"))
    skipped = F.array_compact(F.array(
        F.when(F.col("_project").isNull(), F.lit("project:no match")),
        F.when(F.col("_project").isNull() & F.col("_global").isNull(), F.lit("global:no match"))))
    return out.select(*runs.columns, F.coalesce("_project", "_global", "_builtin").alias("rule"),
                      tier.alias("tier"), skipped.alias("skipped"))


def gate_text(rule: Column, stdout: Column, text: Column, exit_code: Column, verbose: Column,
              nonzero_exit: Column, gate_verbose: Column, gate_max_lines: Column) -> Column:
    """Gate outcome: ``passthrough``, a fixed notice of a file tool, or NULL to go on."""
    n_text = F.size(non_blank(lines_of(nn(text))))
    n_out = F.size(non_blank(lines_of(nn(stdout))))
    raw = F.lit("passthrough")
    loud = verbose >= 2
    return (
        F.when((rule == "grep") & (exit_code == 1), F.lit(NO_MATCHES))
        .when(rule.isin("grep", "find", "ls") & (exit_code != 0), raw)
        .when((rule == "grep") & (n_out == 0), F.lit(NO_MATCHES))
        .when((rule == "find") & (n_out == 0), F.lit(NO_RESULTS))
        .when((rule == "ls") & (n_out == 0), F.lit(EMPTY_DIR))
        .when((rule == "grep") & ((n_out <= GREP_SMALL) | loud), raw)
        .when((rule == "find") & ((n_out <= FIND_SMALL) | loud), raw)
        .when((rule == "ls") & ((n_out <= LS_SMALL) | loud), raw)
        .when(nonzero_exit & (exit_code != 0), raw)
        .when(gate_verbose.isNotNull() & (verbose >= gate_verbose), raw)
        .when(gate_max_lines.isNotNull() & (n_text <= gate_max_lines), raw)
    )


def split_compound(runs: DataFrame, key: str = "run_id", command: str = "command") -> DataFrame:
    """One row per command segment: raw text, executable, ambiguity and its reason.

    A command that cannot be split (here-document, open quote, dangling escape)
    stays whole as one ambiguous row.
    """
    base = runs.select(key, C.plain_spaces(F.coalesce(F.col(command), F.lit(""))).alias("_cmd"))
    base = base.where(~is_blank(F.col("_cmd"))).withColumn("_err", C.split_error(F.col("_cmd")))
    parts = F.when(F.col("_err").isNull(), C.raw_segments(F.col("_cmd"))).otherwise(F.array("_cmd"))
    out = base.select(key, "_err", F.posexplode(parts).alias("seg_no", "raw"))
    out = out.withColumn("_head", F.when(F.col("_err").isNull(), C.segment_head(F.col("raw"))))
    reason = F.coalesce("_err", F.col("_head.reason"))
    return out.select(key, "seg_no", "raw", F.col("_head.executable").alias("executable"),
                      reason.isNotNull().alias("ambiguous"), reason.alias("reason"))
