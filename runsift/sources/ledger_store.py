"""Ledger and outcome tables: read with old schemas, append, retain, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from runsift.functions.text import any_line, lines_of, nn, trim_ctl
from runsift.functions.tokens import ESTIMATOR
from runsift.operators.ledger import days_before
from runsift.operators.prepare import with_bound

# Schema version, retention, and what makes a raw output worth keeping.
SCHEMA_VERSION, RETENTION_DAYS = 1, 90
MIN_CHARS = 200
FALLBACK_KINDS = ["fidelity_guard_fallback", "apply_fallback", "ir_fallback", "stage_exception"]
EXPAND_DEFAULT, EXPAND_LINES, EXPAND_BYTES = 100, 500, 32 * 1024
OUTPUT_CAP = "OUTPUT_CAP"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows; files of older schemas get the estimator and version defaults."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return with_defaults(df.drop("batch"))


def with_defaults(df: DataFrame) -> DataFrame:
    for name, default in (("estimator", F.lit(ESTIMATOR)), ("schema_version", F.lit(SCHEMA_VERSION))):
        have = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(have.cast("string") if name == "estimator" else have.cast("int"), default))
    return df


def merge_ledgers(*parts: DataFrame) -> DataFrame:
    """Union of ledgers with different column sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return with_defaults(out)


def by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("ts"))


def append_ledger(df: DataFrame, path: str, batch: str | None = None, rows_per_file: int = 1_000_000) -> None:
    """Append in partitions of day and batch; appending a batch again replaces its own files, so a retry changes nothing.

    Without a name a batch is named by its rows, so the same rows are the same batch. One aggregate counts a day's rows,
    which gives its writers: about ``rows_per_file`` rows a file, and a busy day is not one task's file.
    """
    out = by_day(df)
    own = F.xxhash64(*[F.col(c) if not dict(out.dtypes)[c].startswith("map") else F.map_entries(c) for c in out.columns])
    days = out.groupBy("day").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows_per_file)).alias("_writers"), F.count("*").alias("n"), F.sum(own.cast("decimal(38,0)")).alias("h"))
    total = days.agg(F.sum("n"), F.sum("h"), F.max("_writers")).first()
    name = batch if batch is not None else f"rows-{total[0] or 0}-{total[1] or 0}"
    writer = F.lit(0).cast("bigint")
    if (total[2] or 1) > 1:
        busy = days.where("_writers > 1").select(F.col("day").alias("_busy"), "_writers")
        out = out.join(with_bound(busy), F.col("day") == F.col("_busy"), "left")
        writer = F.pmod(own, F.coalesce("_writers", F.lit(1)))
    spread = out.withColumn("_writer", writer).repartition("day", "_writer").drop("_writer", "_writers", "_busy")
    spread.withColumn("batch", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def outcome_rows(results: DataFrame, chars: int | None = None) -> DataFrame:
    """Incidents of pipeline results as rows (needs ts and project on the runs); ``chars`` cuts their details."""
    detail = nn(F.col("o.detail"))
    # exploding zero or one row keeps the checks from running once per filter and once per column
    row = F.struct(F.col("rule").alias("filter_name"), F.col("incident").alias("kind"), F.col("detail"))
    ex = results.select("ts", "command", "project", F.explode(F.array_compact(F.array(F.when(F.col("incident").isNotNull(), row)))).alias("o"))
    return ex.select("ts", "command", "project", "o.filter_name", "o.kind", F.lit(None).cast("string").alias("stage_name"),
                     F.lit(True).alias("fallback_succeeded"), (detail if chars is None else F.substring(detail, 1, chars)).alias("detail"))


def append_outcomes(results: DataFrame, path: str, batch: str | None = None) -> None:
    append_ledger(outcome_rows(results), path, batch)


# --- A15, A16, A17 ------------------------------------------------------------------

def has_omission_marker(text: Column) -> Column:
    return any_line(lines_of(nn(text)), lambda x: trim_ctl(x).startswith("... (") & x.contains("omitted") & trim_ctl(x).endswith("..."))


def keep_raw(mode: str, exit_code: Column, termination: Column, raw_chars: Column, out_text: Column, was_filtered: Column,
             raw_tokens: Column, out_tokens: Column, incident: Column) -> Column:
    """Should the raw output of a run be kept? An unknown mode keeps failures."""
    name = (mode or "").strip().lower() or "omissions"
    failed = exit_code != 0
    if name == "always":
        return F.lit(True)
    if name == "never":
        return F.lit(False)
    if name != "omissions":
        return failed
    shrunk = was_filtered & (has_omission_marker(out_text) | ((raw_tokens > 0) & (out_tokens * 2 <= raw_tokens))
                             | ((raw_chars >= MIN_CHARS) & (F.char_length(nn(out_text)) * 2 <= raw_chars)))
    return F.coalesce(failed | (termination == OUTPUT_CAP) | shrunk | incident.isin(FALLBACK_KINDS), F.lit(False)) | failed


def retain_raw(results: DataFrame, mode: str = "omissions") -> DataFrame:
    """Results whose raw text is worth keeping.

    Needs stdout, stderr, exit_code, termination, text_out, was_filtered, raw_tokens,
    out_tokens and incident.
    """
    chars = F.char_length(nn(F.col("stdout"))) + F.char_length(nn(F.col("stderr")))
    return results.where(keep_raw(mode, F.col("exit_code"), nn(F.col("termination")), chars, F.col("text_out"), F.col("was_filtered"),
                                  F.col("raw_tokens"), F.col("out_tokens"), nn(F.col("incident"))))


def expand_raw(runs: DataFrame, start: int | None = None, end: int | None = None, text: str = "text") -> DataFrame:
    """(run_id, content, start_line, end_line, total_lines, returned, truncated): a line
    range of each raw text, at most 500 lines and 32 KiB."""
    first = max(1, start or 1)
    last = first + EXPAND_DEFAULT - 1 if end is None else max(first, end)
    last = min(last, first + EXPAND_LINES - 1)
    ls = lines_of(nn(F.col(text)))
    df = runs.select("run_id", ls.alias("l"), F.slice(ls, first, last - first + 1).alias("w"))

    def grow(a: Column, x: Column) -> Column:
        add = F.octet_length(x) + 1
        stop = a["stop"] | (a["bytes"] + add > EXPAND_BYTES)
        return F.struct(F.when(stop, a["n"]).otherwise(a["n"] + 1).alias("n"), F.when(stop, a["bytes"]).otherwise(a["bytes"] + add).alias("bytes"),
                        stop.alias("stop"))
    start_state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes"), F.lit(False).alias("stop"))
    df = df.withColumn("c", F.aggregate("w", start_state, grow))
    n = F.col("c.n")
    kept = F.slice("w", F.lit(1), n)
    return df.select("run_id", F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), "").alias("content"),
                     F.lit(first).alias("start_line"), (n + F.lit(first - 1)).alias("end_line"), F.size("l").alias("total_lines"),
                     n.alias("returned"), F.col("c.stop").alias("truncated"))


def apply_retention(df: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows young enough to stay; on a day-partitioned table the filter prunes partitions."""
    cut = days_before(as_of, days)
    out = df.where(F.col("ts") >= cut)
    return out.where(F.col("day") >= F.to_date(cut)) if "day" in df.columns else out


def drop_expired(spark: SparkSession, table: str, as_of: str, days: int = RETENTION_DAYS) -> list[str]:
    """Drop whole day partitions of a catalog table that lie before the cut."""
    cut = spark.range(1).select(F.to_date(days_before(as_of, days)).cast("string")).first()[0]
    parts = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = [p for p in parts if p < cut]
    for p in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = '{p}')")
    return old


# --- A13, A14 -----------------------------------------------------------------------------

def report_columns(df: DataFrame) -> DataFrame:
    """USD with six decimals, everything else as it is."""
    return df.select(*[F.format_string("%.6f", F.col(c)).alias(c) if c.startswith("usd_") else F.col(c) for c in df.columns])


CSV_STYLE = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report as ordered CSV text with quoted quotes: one header, at the top of the first part, and the rows sorted.

    The parts in the order of their names are one CSV file; a report of usual size is one part.
    """
    rows = report_columns(df)
    head = df.sparkSession.range(1).select(F.lit(0).alias("_part"), *[F.lit(c).alias(c) for c in rows.columns])
    body = rows.select(F.lit(1).alias("_part"), *[F.col(c).cast("string").alias(c) for c in rows.columns])
    head.unionByName(body).orderBy("_part", *rows.columns).drop("_part").write.mode("overwrite").options(**CSV_STYLE).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a written report; the header is the row that has the column names."""
    types = {f.name: f.dataType for f in StructType.fromDDL(schema)}
    text = spark.read.schema(StructType([StructField(c, StringType()) for c in types])).options(multiLine="true", **CSV_STYLE).csv(path)
    header = F.struct(*text.columns).eqNullSafe(F.struct(*[F.lit(c).alias(c) for c in types]))
    return text.where(~header).select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


DOCUMENT_KEYS = ["schema_version", "kind", "command", "filter", "exit_code", "was_filtered", "document"]
DOCUMENT_SCHEMA = ("schema_version int, kind string, command string, filter string, exit_code int, was_filtered boolean, "
                   "document string")


def documents_json(results: DataFrame, kind: Column, document: Column) -> DataFrame:
    """One schema-1 envelope per run; ``document`` is a struct or a string column."""
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), kind.alias("kind"), F.col("command"), F.col("rule").alias("filter"),
                    F.col("exit_code"), F.col("was_filtered"), document.alias("document"))
    return results.select("run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_documents_json(results: DataFrame, kind: Column, document: Column, path: str) -> None:
    documents_json(results, kind, document).select("value").write.mode("overwrite").text(path)


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Strict re-read: unknown keys and other versions are errors, not NULLs."""
    raw = spark.read.text(path)
    j = F.from_json("value", DOCUMENT_SCHEMA, {"mode": "FAILFAST"})
    extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, DOCUMENT_KEYS)))
    ok = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(extra, ",")))).otherwise(j)
    out = raw.select(ok.alias("d")).select("d.*")
    bad = F.raise_error(F.concat(F.lit("unsupported schema_version: "), nn(F.col("schema_version").cast("string"))))
    return out.withColumn("schema_version", F.when(F.col("schema_version") == SCHEMA_VERSION, F.col("schema_version")).otherwise(bad.cast("int")))
