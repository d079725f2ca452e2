"""Session mining: call pairing, corrections, uncovered commands, failure classes.

Input ``session_events``: session_id, seq (file order, a dense-ish integer), ts,
command, exit_code, duration_ms, output_bytes, output, filtered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions import commands as C
from runsift.functions.redact import redact
from runsift.functions.text import contains_any, is_blank, let, lines_of, nn, strip_ws, trim_ctl
from runsift.operators.ordered import carry_forward
from runsift.operators.plan_shape import settled

# Tool names, time window, weights and the failure word lists.
SHELL_TOOLS = ["bash", "sh", "terminal", "exec"]
CORRECTION_WINDOW_MS = 30 * 60 * 1000
SAVED_SHARE, PROPOSAL_SHARE = 0.75, 0.70
FAILURE_CLASSES = [
    ("COMPILATION_ERROR",
     ["cannot find symbol", "compilation failed", "syntax error", "build failed", "javac"]),
    ("TEST_FAILURE", ["assertionerror", "failures:", "test failed", "tests failed", "junit", "pytest"]),
    ("LINT_ERROR", ["eslint", "prettier", "spotless", "checkstyle", "rubocop", "linter error"]),
    ("GIT_CONFLICT", ["conflict", "merge conflict", "fatal: not a git", "rejected"]),
    ("PERMISSION_DENIED", ["permission denied", "eacces", "operation not permitted", "access is denied"]),
]
GENERAL_FAILURE = "GENERAL_FAILURE"
TS_CODE = r"^.*\bts\d{4}\b.*\z"
NO_OUTPUT_SAMPLE = "Command exited with non-zero status"
PROXY_PREFIX, REDUCED_MARKER = "runsift ", "[reduced]"


def millis_between(a: Column, b: Column) -> Column:
    return F.expr("0L") + F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1000)


# --- G1, G2, G3 -----------------------------------------------------------------

def pair_tool_calls(calls: DataFrame, results: DataFrame, proxy: str = PROXY_PREFIX,
                    marker: str = REDUCED_MARKER) -> DataFrame:
    """Join each shell call with the first result of its id that follows it.

    calls: session_id, call_id, seq, ts, tool, command; results: session_id,
    call_id, seq, ts, content, exit_code, is_error. A later call with the same id
    replaces a waiting one, and a call answers once. Every result looks up the
    latest call before it, then one aggregate keeps the first result per call, so
    an id shared by very many rows never lands in a single task.
    """
    null_s, null_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    shell = calls.where(F.lower("tool").isin(SHELL_TOOLS) & ~is_blank(nn(F.col("call_id"))) & ~is_blank(nn(F.col("command"))))
    both = shell.select("session_id", "call_id", "seq", "ts", "command", null_s.alias("content"),
                        null_i.alias("exit_code"), F.lit(None).cast("boolean").alias("is_error"), F.lit(True).alias("is_call"))
    both = both.unionByName(results.where(F.col("call_id").isNotNull()).select(
        "session_id", "call_id", "seq", "ts", null_s.alias("command"), "content",
        F.col("exit_code").cast("int").alias("exit_code"), "is_error", F.lit(False).alias("is_call")))
    call = F.when(F.col("is_call"), F.struct(F.col("seq").alias("seq"), F.col("ts").alias("ts"),
                                             F.col("command").alias("command")))
    seen = carry_forward(both, ["session_id", "call_id"], "seq", call, "call")
    answered = seen.where(~F.col("is_call") & F.col("call").isNotNull())
    first = answered.groupBy("session_id", "call_id", F.col("call.seq").alias("call_seq")).agg(
        F.min_by(F.struct("call", "seq", "ts", "content", "exit_code", "is_error"), "seq").alias("r"))
    delta = millis_between(F.col("r.call.ts"), F.col("r.ts"))
    command, output = redact(F.col("r.call.command")), nn(F.col("r.content"))
    return first.select(
        "session_id", F.col("r.seq").alias("seq"), F.col("call_id").alias("event_id"),
        F.coalesce("r.call.ts", "r.ts").alias("ts"), command.alias("command"),
        F.coalesce("r.exit_code", F.when(F.coalesce("r.is_error", F.lit(False)), 1).otherwise(0)).alias("exit_code"),
        F.greatest(F.coalesce(delta, F.lit(0).cast("bigint")), F.lit(0).cast("bigint")).alias("duration_ms"),
        F.length(output).cast("bigint").alias("output_bytes"), redact(output).alias("output"),
        already_reduced(command, output, proxy, marker).alias("filtered"))


def already_reduced(command: Column, output: Column, proxy: str = PROXY_PREFIX, marker: str = REDUCED_MARKER) -> Column:
    return command.startswith(proxy) | nn(output).contains(marker)


def session_bounds(events: DataFrame) -> DataFrame:
    """Start, end and workspace (first one seen) per session."""
    return events.groupBy("session_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("seq"))).alias("workspace"),
        F.count("*").alias("events"))


# --- G4, G5 -----------------------------------------------------------------------

def correction_pairs(events: DataFrame) -> DataFrame:
    """Failed command and the later related success that fixed it.

    Each success looks at the latest failure of its session. Inside that
    segment the first related success within 30 minutes wins, unless a success
    outside the window came first and ended the wait. Both are minima, so a
    segment of any size is a partial aggregate, not one task's list.
    """
    ev = events.where(F.col("command").isNotNull())
    failed = F.col("exit_code") != 0
    failure = F.when(failed, F.struct(
        F.col("seq").alias("seq"), F.col("ts").alias("ts"), F.col("command").alias("command"),
        F.col("exit_code").alias("exit_code"), F.col("output").alias("output")))
    seen = carry_forward(ev.select("session_id", "seq", "ts", "command", "exit_code", "output"),
                         ["session_id"], "seq", failure, "f")
    ok = seen.where(~failed & F.col("f").isNotNull()).withColumn("delta_ms", millis_between(F.col("f.ts"), F.col("ts")))
    inside = F.col("delta_ms").between(0, CORRECTION_WINDOW_MS)
    hit = inside & C.related(F.col("f.command"), F.col("command"))
    seg = ok.groupBy("session_id", F.col("f.seq").alias("failed_seq")).agg(
        F.min(F.when(~inside, F.col("seq"))).alias("_expired"),
        F.min_by(F.struct("seq", "command", "delta_ms", "f"), F.when(hit, F.col("seq"))).alias("_fix"))
    won = seg.where(F.col("_fix").isNotNull() & (F.col("_expired").isNull() | (F.col("_fix.seq") < F.col("_expired"))))
    return won.select(
        "session_id", F.col("_fix.f.command").alias("failed_command"), F.col("_fix.f.exit_code").alias("failed_exit"),
        F.col("_fix.f.output").alias("snippet"), F.col("_fix.command").alias("corrected_command"),
        F.col("_fix.delta_ms").alias("delta_ms"), "failed_seq", F.col("_fix.seq").alias("corrected_seq"))


# --- G6, G7 -------------------------------------------------------------------------

def event_tokens(output_bytes: Column, output: Column) -> Column:
    size = F.when(F.coalesce(output_bytes, F.lit(0)) > 0, output_bytes).otherwise(F.length(nn(output)))
    return F.greatest(F.lit(1).cast("bigint"), F.floor(size / 4).cast("bigint"))


def saved_tokens(tokens: Column, share: float = SAVED_SHARE) -> Column:
    return F.floor(tokens * F.lit(share) + F.lit(0.5)).cast("bigint")


def known_words(prefixes: Sequence[str]) -> list[str]:
    """Every rule prefix and its first word: the executables a rule speaks for."""
    return sorted({p.lower() for p in prefixes} | {p.split()[0].lower() for p in prefixes})


def covered(command: Column, prefixes: Sequence[str]) -> Column:
    """Does a rule own some word prefix of the command?"""
    words = max((len(p.split()) for p in prefixes), default=1)

    def owned(norm: Column) -> Column:
        out = F.lit(False)
        for n in range(1, words + 1):
            own = [p for p in prefixes if len(p.split()) == n]
            if own:
                out = out | F.coalesce(C.word_prefix(norm, n).isin(own), F.lit(False))
        return out
    return let(C.normalized(command), owned)


def annotate(events: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Redacted command and output, token estimate, segments and coverage per event.

    Rule prefixes are configuration of fixed size and become literals, so a
    transcript table of any size is annotated without a join or a shuffle.
    """
    ev = events.where(F.col("command").isNotNull() & ~is_blank(F.col("command")))
    ev = ev.withColumn("cmd", redact(trim_ctl(F.col("command")))).withColumn("out", redact(nn(F.col("output"))))
    ev = settled(ev, "cmd", "out")
    ev = ev.withColumn("chars", F.length("out").cast("bigint"))
    ev = ev.withColumn("tokens", event_tokens(F.col("output_bytes"), F.col("out")))
    clean = C.plain_spaces(F.col("cmd"))
    parts = F.when(C.split_error(clean).isNull(), C.raw_segments(clean)).otherwise(F.array().cast("array<string>"))
    ev = settled(ev.withColumn("segments", parts), "segments")
    known = known_words(prefixes)
    hit = F.exists("segments", lambda s: covered(s, prefixes) | F.coalesce(
        C.segment_head(s)["executable"].isin(known), F.lit(False)))
    whole = (F.size("segments") == 0) & covered(F.col("cmd"), prefixes)
    return settled(ev.withColumn("supported", hit | whole | F.coalesce("filtered", F.lit(False))), "supported")


def unsupported_segments(annotated: DataFrame) -> DataFrame:
    """One row per segment of an uncovered event, its share of chars and tokens."""
    parts = F.when(F.size("segments") == 0, F.array("cmd")).otherwise(F.col("segments"))
    rows = annotated.where(~F.col("supported")).select(
        "session_id", "seq", "chars", "tokens", F.greatest(F.size("segments"), F.lit(1)).alias("n"),
        F.posexplode(parts).alias("seg_no", "raw"))
    return rows.select("session_id", "seq", "seg_no", C.tool_prefix(F.col("raw")).alias("prefix"), "raw",
                       F.expr("chars div n").alias("chars"), F.expr("tokens div n").alias("tokens"))


def unsupported_commands(events: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    return unsupported_segments(annotate(events, prefixes)).groupBy("prefix").agg(
        F.count("*").alias("runs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


# --- G8 -------------------------------------------------------------------------------

def failure_class(output: Column) -> Column:
    low = F.lower(nn(output))
    out = None
    for name, words in FAILURE_CLASSES:
        cond = contains_any(low, words)
        if name == "COMPILATION_ERROR":
            cond = cond | low.rlike(TS_CODE)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(GENERAL_FAILURE))


def failure_sample(output: Column) -> Column:
    first = trim_ctl(F.coalesce(F.try_element_at(lines_of(strip_ws(nn(output))), F.lit(1)), F.lit("")))
    short = F.when(F.length(first) > 100, F.concat(F.substring(first, 1, 97), F.lit("..."))).otherwise(first)
    return F.when(is_blank(nn(output)), F.lit(NO_OUTPUT_SAMPLE)).otherwise(short)


def classify_failures(events: DataFrame) -> DataFrame:
    """Failures per class with the sample of the first one."""
    failed = events.where((F.col("exit_code") != 0) & F.col("command").isNotNull() & ~is_blank(F.col("command")))
    out = redact(nn(F.col("output")))
    return failed.select("session_id", "seq", failure_class(out).alias("category"), failure_sample(out).alias("sample")) \
        .groupBy("category").agg(F.count("*").alias("cnt"), F.min_by("sample", F.struct("session_id", "seq")).alias("sample"))


# --- G9, G10 --------------------------------------------------------------------------

def session_report(events: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """One row of totals. Partial totals are unioned and added, so nothing is crossed."""
    zero = F.lit(0).cast("bigint")
    cols = ["sessions", "commands", "failed", "pairs", "raw_tokens", "saved_tokens"]
    ann = annotate(events, prefixes)
    per = ann.agg(
        F.count("*").alias("commands"), F.count_if(F.col("exit_code") != 0).alias("failed"),
        F.coalesce(F.sum("tokens"), zero).alias("raw_tokens"),
        F.coalesce(F.sum(F.when(F.col("supported"), saved_tokens(F.col("tokens")))), zero).alias("saved_tokens"))
    ses = events.select("session_id").distinct().agg(F.count("*").alias("sessions"))
    pairs = correction_pairs(events).agg(F.count("*").alias("pairs"))
    parts = [df.select(*[F.col(c) if c in df.columns else zero.alias(c) for c in cols]) for df in (per, ses, pairs)]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.sum(c).alias(c) for c in cols])
    ratio = F.when(F.col("raw_tokens") > 0, F.col("saved_tokens") / F.col("raw_tokens")).otherwise(F.lit(0.0))
    return total.select(*cols, F.round(ratio, 6).alias("ratio"))


def slug_of(prefix: Column) -> Column:
    dashed = F.lower(F.regexp_replace(prefix, "[^a-zA-Z0-9]+", "-"))
    return F.regexp_replace(F.regexp_replace(dashed, r"^-", ""), r"-\z", "")


def propose_from_sessions(events: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Prefixes run at least twice or corrected at least once.

    Corrections are matched by leading characters. The pairs are reduced to
    distinct command pairs with a count first, then joined on equality of their
    leading substrings with the (far smaller) prefix table.
    """
    seg = unsupported_segments(annotate(events, prefixes))
    usage = seg.groupBy("prefix").agg(
        F.count("*").alias("runs"), F.sum("tokens").alias("tokens"),
        F.min_by("raw", F.struct("session_id", "seq", "seg_no")).alias("sample"))
    pairs = correction_pairs(events).groupBy("failed_command", "corrected_command").agg(F.count("*").alias("n"))

    def leads(c: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda k: F.substring(F.col(c), F.lit(1), k))
    lead = pairs.select("n", F.explode(F.array_distinct(F.concat(leads("failed_command"), leads("corrected_command")))).alias("prefix"))
    hits = lead.groupBy("prefix").agg(F.sum("n").alias("corrections"))
    out = usage.join(hits, "prefix", "left").withColumn("corrections", F.coalesce("corrections", F.lit(0).cast("bigint")))
    out = out.where((F.col("runs") >= 2) | (F.col("corrections") > 0)).withColumn("slug", slug_of(F.col("prefix")))
    return out.select(
        F.substring(F.sha2(F.concat("slug", F.lit(":"), "prefix"), 256), 1, 12).alias("id"), "slug", "prefix", "runs",
        "tokens", "corrections", "sample", saved_tokens(F.col("tokens"), PROPOSAL_SHARE).alias("est_savings"))


# --- G11, G12 -------------------------------------------------------------------------

def duration_bucket(ms: Column) -> Column:
    return F.when(ms < 100, "<100ms").when(ms < 1000, "100ms-1s").when(ms < 5000, "1s-5s").otherwise(">5s")


def size_bucket(size: Column) -> Column:
    return F.when(size < 1024, "<1KB").when(size < 10240, "1KB-10KB").when(size < 102400, "10KB-100KB").otherwise(">100KB")


def failure_breakdown(reports: DataFrame) -> DataFrame:
    """Counts by six dimensions in one scan; a report needs a category."""
    dims = {"stage": F.coalesce("failure_stage", F.lit("UNKNOWN")), "category": F.col("error_category"),
            "exit_code": F.coalesce(F.col("exit_code"), F.lit(0)).cast("string"),
            "version": F.coalesce("version", F.lit("unknown")),
            "duration": F.coalesce("duration_bucket", F.lit("unknown")),
            "size": F.coalesce("output_length_bucket", F.lit("unknown"))}
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in dims.items()])
    return reports.where(F.col("error_category").isNotNull()).select(F.explode(pairs).alias("p")) \
        .groupBy("p.dimension", "p.value").agg(F.count("*").alias("cnt"))
