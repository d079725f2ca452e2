"""Savings reports over the ledger. Every time-relative report takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.commands import gap_prefix
from runsift.functions.tokens import ratio_1dp, savings_pct

# What a gap is.
GAP_MIN_TOKENS, GAP_MIN_TENTHS = 100, 10


def _ts(value: Column | str) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else value


def scoped(ledger: DataFrame, since: Column | str | None = None, project: str | None = None) -> DataFrame:
    """Time and project filter; both reach the scan."""
    if since is not None:
        ledger = ledger.where(F.col("ts") >= _ts(since))
    if project is not None:
        ledger = ledger.where(F.col("project") == project)
    return ledger


def days_before(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")


def _sums() -> list[Column]:
    return [F.count("*").alias("commands"), F.sum("raw_tokens").alias("raw"), F.sum("out_tokens").alias("out")]


def savings_summary(ledger: DataFrame, since=None, project: str | None = None) -> DataFrame:
    agg = scoped(ledger, since, project).agg(
        F.count("*").alias("commands"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("out"), F.coalesce(F.sum("exec_ms"), F.lit(0)).alias("exec_ms"))
    avg = F.when(F.col("commands") > 0, F.expr("exec_ms div commands")).otherwise(F.lit(0).cast("bigint"))
    return agg.select("commands", "raw", "out", (F.col("raw") - F.col("out")).alias("saved"),
                      savings_pct(F.col("raw"), F.col("out")).alias("pct"), "exec_ms", avg.alias("avg_ms"))


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week_label(ts: Column) -> Column:
    """``2024-W05``: Monday weeks, W00 before the first Monday of the year."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def _bucketed(ledger: DataFrame, label: Column) -> DataFrame:
    return ledger.groupBy(label.alias("bucket")).agg(*_sums()).withColumn("saved", F.col("raw") - F.col("out"))


def savings_daily(ledger: DataFrame, as_of: str, days: int, project: str | None = None) -> DataFrame:
    return _bucketed(scoped(ledger, days_before(as_of, days), project), day_label(F.col("ts")))


def savings_weekly(ledger: DataFrame, as_of: str, weeks: int, project: str | None = None) -> DataFrame:
    return _bucketed(scoped(ledger, days_before(as_of, 7 * weeks), project), week_label(F.col("ts")))


def _trend_columns(df: DataFrame) -> DataFrame:
    saved = F.greatest(F.lit(0).cast("bigint"), F.col("raw") - F.col("out"))
    pct = F.when(F.col("raw") > 0, F.round(F.lit(100.0) * saved / F.col("raw"), 1)).otherwise(F.lit(0.0))
    return df.select("bucket", "commands", "raw", "out", saved.alias("saved"), pct.alias("pct"),
                     ratio_1dp(F.col("raw"), F.col("out")).alias("ratio"))


def savings_trend(ledger: DataFrame, as_of: str, weeks: int, project: str | None = None) -> DataFrame:
    """One row per week of the spine, zero where nothing ran."""
    weeks = max(1, weeks)
    spine = ledger.sparkSession.range(weeks).select(week_label(
        F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval((F.col("id") * 7).cast("int"))).alias("bucket"))
    by_week = savings_weekly(ledger, as_of, weeks, project).drop("saved")
    zero = F.lit(0).cast("bigint")
    filled = spine.join(by_week, "bucket", "left").select(
        "bucket", *[F.coalesce(c, zero).alias(c) for c in ("commands", "raw", "out")])
    return _trend_columns(filled)


def trend_totals(ledger: DataFrame, as_of: str, weeks: int, project: str | None = None) -> DataFrame:
    """Totals over the weeks of the spine."""
    t = savings_trend(ledger, as_of, weeks, project).agg(
        *[F.sum(c).alias(c) for c in ("commands", "raw", "out", "saved")])
    pct = F.when(F.col("raw") > 0, F.round(F.lit(100.0) * F.col("saved") / F.col("raw"), 1)).otherwise(F.lit(0.0))
    return t.select("commands", "raw", "out", "saved", pct.alias("pct"),
                    ratio_1dp(F.col("raw"), F.col("out")).alias("ratio"))


def _by_command(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("command").agg(
        F.count("*").alias("uses"), F.sum("raw_tokens").alias("raw"), F.sum("out_tokens").alias("out")).select(
        "command", "uses", "raw", "out", (F.col("raw") - F.col("out")).alias("saved"),
        savings_pct(F.col("raw"), F.col("out")).alias("pct"))


def top_commands(ledger: DataFrame, n: int, since=None, project: str | None = None) -> DataFrame:
    return _by_command(scoped(ledger, since, project)).orderBy(F.desc("saved"), "command").limit(n)


def recent_commands(ledger: DataFrame, n: int, since=None, project: str | None = None) -> DataFrame:
    rows = scoped(ledger, since, project).orderBy(F.desc("ts"), F.desc("id")).limit(n)
    return rows.select("id", "ts", "command", "raw_tokens", "out_tokens",
                       savings_pct(F.col("raw_tokens"), F.col("out_tokens")).alias("pct"), "exec_ms")


def savings_gaps(ledger: DataFrame, n: int = 10, since=None, project: str | None = None) -> DataFrame:
    """Command prefixes that print much and save little."""
    raw, out = F.col("raw_tokens"), F.col("out_tokens")
    low = scoped(ledger, since, project).where((raw > GAP_MIN_TOKENS) & ((raw - out) * GAP_MIN_TENTHS < raw))
    grouped = low.groupBy(gap_prefix(F.col("command")).alias("prefix")).agg(
        F.count("*").alias("runs"), F.sum("raw_tokens").alias("raw"), F.sum("out_tokens").alias("out"))
    pct = F.floor((F.col("raw") - F.col("out")) * 1000.0 / F.col("raw") + F.lit(0.5)) / 10.0
    return grouped.where("prefix <> ''").select(
        "prefix", "runs", "raw", "out", F.col("out").alias("wasted"),
        F.when(F.col("raw") == 0, F.lit(0.0)).otherwise(pct).alias("pct"),
    ).orderBy(F.desc("wasted"), F.desc("runs"), "prefix").limit(n if n > 0 else 10)


def mixed_estimators(ledger: DataFrame, since=None) -> DataFrame:
    return scoped(ledger, since).agg(
        F.count_distinct("estimator").alias("estimators"), (F.count_distinct("estimator") > 1).alias("mixed"))


def outcome_counts(outcomes: DataFrame, since=None) -> DataFrame:
    return scoped(outcomes, since).groupBy("kind").agg(F.count("*").alias("cnt"))


def ledger_health(ledger: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Row counts, oldest and newest entry, and a warning for future timestamps."""
    tomorrow = F.lit(as_of).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    one = ledger.select("ts", F.lit(0).alias("src")).unionByName(outcomes.select("ts", F.lit(1).alias("src")))
    led = F.col("src") == 0
    return one.agg(
        F.count_if(led).alias("ledger_rows"), F.min(F.when(led, F.col("ts"))).alias("oldest"),
        F.max(F.when(led, F.col("ts"))).alias("newest"), F.count_if(~led).alias("outcome_rows"),
        F.coalesce(F.max(F.when(led, F.col("ts"))) > tomorrow, F.lit(False)).alias("future"))


# --- cost ---------------------------------------------------------------------

def usd(tokens: Column, rate: Column) -> Column:
    """Rounded to six places, negative token counts count as none."""
    clamped = F.greatest(F.lit(0).cast("bigint"), tokens)
    return F.floor(clamped * (rate / F.lit(1000000.0)) * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0)


def find_model(queries: DataFrame, models: DataFrame, default: str | None = None) -> DataFrame:
    """Resolve ``queries.query`` to a model by id, name or alias, ignoring case.

    ``models`` is the price list (a dimension of known size). Unknown queries take
    the default model when there is one.
    """
    names = models.select(F.col("id").alias("model"), F.explode(F.array_distinct(F.transform(
        F.concat(F.array("id", "name"), F.coalesce("aliases", F.array().cast("array<string>"))),
        lambda x: F.lower(F.trim(x))))).alias("_n")).groupBy("_n").agg(F.min("model").alias("model"))
    out = queries.withColumn("_n", F.lower(F.trim("query"))).join(names, "_n", "left").drop("_n")
    return out.withColumn("model", F.coalesce("model", F.lit(default)))


def with_cost(sums: DataFrame, models: DataFrame, model: str) -> DataFrame:
    """Add model and USD columns to a frame with raw and out.

    The rate of the one model is a scalar subquery, so nothing is joined.
    """
    rate = models.where(F.col("id") == model).agg(F.max("input_cost_per_million")).scalar()
    out = sums.withColumns({"model": F.lit(model), "_rate": rate})
    return out.select(
        *[c for c in sums.columns], "model", usd(F.col("raw"), F.col("_rate")).alias("usd_raw"),
        usd(F.col("out"), F.col("_rate")).alias("usd_filtered"),
        usd(F.greatest(F.lit(0).cast("bigint"), F.col("raw")) - F.greatest(F.lit(0).cast("bigint"), F.col("out")),
            F.col("_rate")).alias("usd_saved"))


def cost_estimate(ledger: DataFrame, models: DataFrame, model: str, since=None, project: str | None = None) -> DataFrame:
    sums = savings_summary(ledger, since, project).select("raw", "out")
    return with_cost(sums, models, model).drop("raw", "out")


def cost_by(ledger: DataFrame, models: DataFrame, model: str, by: str) -> DataFrame:
    """USD per ``day``, ``week`` or ``command``."""
    if by == "day":
        sums = _bucketed(ledger, day_label(F.col("ts")))
    elif by == "week":
        sums = _bucketed(ledger, week_label(F.col("ts")))
    elif by == "command":
        sums = ledger.groupBy(F.col("command").alias("bucket")).agg(*_sums()).withColumn(
            "saved", F.col("raw") - F.col("out"))
    else:
        raise ValueError("by must be day, week or command")
    return with_cost(sums, models, model)


def cube_savings(ledger: DataFrame) -> DataFrame:
    """Global, per project, per day, per week and per command totals in one scan.

    Grouping sets multiply the rows in front of the shuffle; the partial sums
    shrink them again before anything moves.
    """
    base = ledger.select("project", day_label(F.col("ts")).alias("day"), week_label(F.col("ts")).alias("week"),
                         "command", "raw_tokens", "out_tokens")
    cols = ["project", "day", "week", "command"]
    sets = [[], *[[F.col(c)] for c in cols]]
    agg = base.groupingSets(sets, *[F.col(c) for c in cols]).agg(F.grouping_id().alias("gid"), *_sums())
    scope = F.when(F.col("gid") == 15, "global").when(F.col("gid") == 7, "project").when(
        F.col("gid") == 11, "day").when(F.col("gid") == 13, "week").otherwise("command")
    value = F.coalesce("project", "day", "week", "command", F.lit("all"))
    return agg.select(scope.alias("scope"), value.alias("value"), "commands", "raw", "out",
                      (F.col("raw") - F.col("out")).alias("saved"))
