"""Frames derived from the star-schema tables, shaped like the engine's inputs.

Each has a plain SQL twin in `oracle_frames`; both are projections, so the size
of a frame follows the size of its table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.session import checkpoint_dir

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name inside the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def doc_runs(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return table(spark, sf, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("command"), F.col("lang").alias("project"),
        F.col("text").alias("stdout"), F.coalesce("toxic", F.lit(0)).alias("exit_code"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Document runs without the label join, for operators that only read text."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("command"), F.col("text").alias("text"))


def noisy_runs(spark: SparkSession, sf: str) -> DataFrame:
    esc = "\x1b"
    noisy = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.when(i % 5 == 0, F.lit("progress 10%\r")).otherwise(F.lit("")),
        F.when(i % 3 == 0, F.concat(F.lit(f"{esc}[31m"), x, F.lit(f"{esc}[0m"))).otherwise(x)))
    return docs(spark, sf).withColumn("text", F.array_join(noisy, "\n"))


def doc_lines_text(spark: SparkSession, sf: str, line) -> DataFrame:
    """Tool-like text per document: ``line(x, i)`` rewrites each line in place."""
    return docs(spark, sf).withColumn(
        "text", F.array_join(F.transform(F.split("text", "\n"), line), "\n"))


def rewrite(spark: SparkSession, sf: str, body: str) -> DataFrame:
    """Tool-like text per document from one SQL expression per line: ``x`` is the
    line and ``{i}`` its position from 0 (the DuckDB twin is `sql.rewritten`)."""
    body = body.replace("{i}", "k").replace("run_id", "doc_id")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("run_id"), F.col("source").alias("command"),
        F.expr(f"array_join(transform(split(text, chr(10)), (x, k) -> {body}), chr(10))").alias("text"))


def hit_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Search hits: seven files, numbered lines."""
    return doc_lines_text(spark, sf, lambda x, i: F.concat(
        F.lit("src/f"), (i % 7).cast("string"), F.lit(".py:"), i.cast("string"), F.lit(": "), x))


def path_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Path listings: nested folders, three extensions and none."""
    ext = lambda i: F.when(i % 4 == 0, ".py").when(i % 4 == 1, ".txt").when(i % 4 == 2, ".rs").otherwise("")
    return doc_lines_text(spark, sf, lambda x, i: F.concat(
        F.lit("d"), (i % 3).cast("string"),
        F.when(i % 2 == 0, F.concat(F.lit("/s"), (i % 5).cast("string"))).otherwise(F.lit("")),
        F.lit("/n"), F.length(x).cast("string"), F.lit("_"), i.cast("string"), ext(i)))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    first = F.when(F.col("event_type") == "signup", "git").when(F.col("event_type") == "error", "mvn").when(
        F.col("event_type") == "click", "npm").when(F.col("event_type") == "view", "cargo").otherwise("ls")
    second = F.when(u % 3 == 0, "status").when(u % 3 == 1, "test --quiet").otherwise("build")
    raw = F.floor(F.col("value") * 10).cast("bigint")
    out = F.when(u % 5 == 0, F.floor(raw * 0.95)).otherwise(F.floor(raw * (u % 12) / 12.0)).cast("bigint")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.concat_ws(" ", first, second).alias("command"),
        (u % 10).cast("string").alias("project"), F.concat(F.lit("/work/p"), (u % 10).cast("string")).alias("cwd"),
        raw.alias("raw_tokens"), out.alias("out_tokens"), (F.col("event_id") % 1000).alias("exec_ms"),
        F.when(F.col("event_id") % 97 == 0, "legacy").otherwise("utf8_weighted_v1").alias("estimator"),
        "event_type", u.alias("user_id"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id") % 3
    kind = F.when(k == 0, "apply_fallback").when(k == 1, "stage_exception").otherwise("short_circuit")
    return ledger(spark, sf).where(F.col("event_type") == "error").select(
        "id", "ts", "command", "project", F.col("command").alias("filter_name"), kind.alias("kind"))


def session_events(spark: SparkSession, sf: str) -> DataFrame:
    return session_events_of(table(spark, sf, "events"))


def session_events_of(events: DataFrame) -> DataFrame:
    """Session = user and day; words chosen so that fixes follow failures."""
    e, u = F.col("event_id"), F.col("user_id")
    tool = F.when(e % 4 == 0, "mvn").when(e % 4 == 1, "npm").when(e % 4 == 2, "./mvnw").otherwise("rustup")
    rest = F.when(F.col("event_type") == "error", " test").when(F.col("event_type") == "click", " run build && make all") \
        .when(F.col("event_type") == "view", " check; zig build | tee 'a;b'").when(
            F.col("event_type") == "signup", " install --token=abc123").otherwise(" verify")
    output = F.when(F.col("event_type") == "error", F.when(e % 7 == 0, "BUILD FAILED: cannot find symbol x").when(
        e % 7 == 1, "2 tests failed").when(e % 7 == 2, "eslint found 3 problems").when(
            e % 7 == 3, "merge conflict in a.txt").when(e % 7 == 4, "EACCES: permission denied").when(
                e % 7 == 5, "").otherwise("exit status 2\nsecond line")).otherwise(F.concat(F.lit("ok "), F.col("props")))
    return events.select(
        F.concat(u.cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        e.alias("seq"), "ts", F.concat(tool, rest).alias("command"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
        F.floor(F.col("value") * 20).cast("bigint").alias("duration_ms"),
        F.when(e % 3 == 0, F.floor(F.col("value") * 7)).otherwise(F.lit(0)).cast("bigint").alias("output_bytes"),
        output.alias("output"), (e % 50 == 0).alias("filtered"),
        F.when(e % 2 == 0, F.concat(F.lit("/w/"), (u % 9).cast("string"))).alias("cwd"))


def tool_calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """User turn n of a conversation calls, the assistant turn n+1 answers."""
    conv = table(spark, sf, "conversations")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn") * 7).cast("timestamp_ntz")
    sid = (F.col("conv_id") % 97).cast("string")
    key = F.col("conv_id") * 1000 + F.col("turn")
    calls = conv.where(F.col("role") == "user").select(
        sid.alias("session_id"), F.concat_ws("-", "conv_id", F.col("turn")).alias("call_id"), key.alias("seq"),
        at.alias("ts"), F.when(F.col("turn") % 3 == 2, "editor").otherwise("Bash").alias("tool"),
        F.concat(F.lit("run "), F.substring("text", 1, 40)).alias("command"))
    results = conv.where(F.col("role") == "assistant").select(
        sid.alias("session_id"), F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("call_id"), key.alias("seq"),
        at.alias("ts"), F.col("text").alias("content"),
        F.when(F.col("conv_id") % 5 == 0, F.col("turn") % 3).cast("int").alias("exit_code"),
        (F.col("conv_id") % 4 == 0).alias("is_error"))
    return calls, results


def failure_reports(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    from runsift.operators.sessions import duration_bucket, size_bucket
    return table(spark, sf, "events").select(
        F.when(e % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("failure_stage"),
        F.when(e % 13 == 0, F.lit(None)).when(e % 3 == 0, "TIMEOUT").otherwise("PARSE").alias("error_category"),
        (e % 4).cast("int").alias("exit_code"),
        F.when(e % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("1."), (e % 3).cast("string"))).alias("version"),
        duration_bucket(F.floor(F.col("value") * 40)).alias("duration_bucket"),
        size_bucket(F.floor(F.col("value") * 700)).alias("output_length_bucket"))


# Evidence put on some lines, so that the fidelity operators meet every signal.
SIGNAL_LINES = ["ERROR:  relation missing ", "see CVE-2024-1234 and CVE-2021-44228 ", "Traceback (most recent call last)",
                "FAILED tests/test_a.py:12 ", "src/main.rs:7:3: error: bad ", "    at a.b.C.run(C.java:5)", "module must be replaced ",
                "Plan: 1 to add, 2 to change, 3 to destroy.", "diff --git a/x.py b/x.py", "+added ", "-removed ", "3 tests failed ",
                "id 123e4567-e89b-12d3-a456-426614174000 ABC-123 UTF-8 ", "panic: oh "]


def signal_runs(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, command, exit_code, before, after): every (run_id mod 9 + 2)-th line
    becomes evidence; ``after`` is the head/tail reduction."""
    from runsift.operators.reduce import head_tail
    marks = F.array(*map(F.lit, SIGNAL_LINES))
    step = (F.col("run_id") % 9 + 2).cast("int")
    seed = F.col("run_id").cast("int")
    text = F.transform(F.split("text", "\n"), lambda x, i: F.when(
        i % step == 1, F.concat(F.get(marks, (F.floor(i / step).cast("int") + seed) % len(SIGNAL_LINES)), F.substring(x, 1, 9))).otherwise(x))
    k = F.col("run_id") % 5
    command = F.when(k == 0, "git diff HEAD").when(k == 1, "git diff --stat").when(k == 2, "ls -la").when(
        k == 3, "mvn test").otherwise("psql")
    d = docs(spark, sf).select("run_id", command.alias("command"), (F.col("run_id") % 3).cast("int").alias("exit_code"),
                               F.array_join(text, "\n").alias("before"))
    return d.withColumn("after", head_tail(F.col("before"), 2, 3))
