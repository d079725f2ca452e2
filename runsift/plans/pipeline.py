"""Rule-driven reduction of a run table, from command to ledger row."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.functions.text import let, lines_raw_of, nn
from runsift.functions.tokens import ESTIMATOR, estimate_tokens
from runsift.operators import fidelity as D
from runsift.operators import prepare as P
from runsift.operators.plan_shape import settled
from runsift.plans.stages import RunColumns, apply_stages, stage
from runsift.sources.rules import definitions, rules_frame

# Stage parameters that may differ between rules sharing one stage list.
_COLUMN_PARAMS = {"grouping": ("pattern",), "aggregate_by_key": ("header",)}


def _shape(stages: list[Mapping]) -> str:
    """Stage list with the parameters that stay literal; rules with one shape share a branch."""
    return json.dumps([{k: v for k, v in sorted(p.items()) if k not in _COLUMN_PARAMS.get(p["strategy"], ())
                        and not (k == "include_other" and not v)} for p in stages])


def reduce_text(text: Column, rule: Column, defs: Mapping[str, Mapping], run: RunColumns) -> Column:
    """One CASE over the distinct stage lists; a rule's own pattern arrives by a literal map."""
    groups: dict[str, list[Mapping]] = {}
    for d in defs.values():
        groups.setdefault(_shape(d["stages"]), []).append(d)
    out = None
    for members in groups.values():
        names = [d["name"] for d in members]
        here = rule.isin(names)
        stages = []
        for i, p in enumerate(members[0]["stages"]):
            p = dict(p)
            for name in _COLUMN_PARAMS.get(p["strategy"], ()):
                values = {d["name"]: d["stages"][i].get(name) for d in members}
                if len(set(values.values())) > 1:
                    pairs = [F.lit(x) for kv in values.items() for x in kv]
                    p[name] = F.try_element_at(F.create_map(*pairs), rule)
            stages.append(p)
        local = RunColumns(run.command, run.exit_code, run.stdout, run.verbose, run.ultra_compact, here)
        value = apply_stages(text, stages, local)
        out = F.when(here, value) if out is None else out.when(here, value)
    return text if out is None else out.otherwise(text)


def prepare_runs(runs: DataFrame, defs: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Add rule, selected text, gate outcome and raw token count to a run table.

    ``runs``: run_id, command, exit_code, stdout, stderr and optionally verbose and
    ultra_compact. The rule table is bounded by its definitions and joins without
    moving the runs.
    """
    spark = runs.sparkSession
    defs = defs or definitions()
    if "verbose" not in runs.columns:
        runs = runs.withColumn("verbose", F.lit(0))
    if "ultra_compact" not in runs.columns:
        runs = runs.withColumn("ultra_compact", F.lit(False))
    rules = rules_frame(spark, defs)
    words = max(len(c.split()) for d in defs.values() for c in d["commands"])
    values = ["rule", "select_input", "passthrough_nonzero_exit", "passthrough_verbose", "passthrough_max_lines"]
    out = P.lookup_prefixes(runs, P.with_bound(rules), "command", values, words)
    out = out.withColumn("rule", P.route_interpreter(F.col("rule"), F.col("command")))
    o, e, x = nn(F.col("stdout")), nn(F.col("stderr")), F.col("exit_code")
    out = out.withColumn("combined", P.combined_text(o, e))
    out = out.withColumn("text", F.when(F.col("rule").isNull(), F.col("combined")).otherwise(
        P.select_input(o, e, x, F.col("select_input"))))
    gate = P.gate_text(F.col("rule"), o, F.col("text"), x, F.col("verbose"),
                       F.coalesce("passthrough_nonzero_exit", F.lit(False)), F.col("passthrough_verbose"), F.col("passthrough_max_lines"))
    out = out.withColumn("gate", F.when(F.col("rule").isNull(), F.lit("passthrough")).otherwise(gate))
    out = out.withColumn("raw_tokens", estimate_tokens(o) + estimate_tokens(e))
    return out.drop("select_input", "passthrough_nonzero_exit", "passthrough_verbose", "passthrough_max_lines")


def run_pipeline(runs: DataFrame, defs: Mapping[str, Mapping] | None = None, prune: bool = True) -> DataFrame:
    """Reduced text per run with the checks applied.

    Adds rule, text_out, was_filtered, incident, detail, gate_kind, raw_tokens and
    out_tokens. A lost signal or an inflated clean run falls back to the whole
    original; every step is row-local behind the rule lookup. ``prune`` leaves out
    the branches of rules that no command matches, which keeps the plan small.
    """
    defs = defs or definitions()
    prep = prepare_runs(runs, defs)
    if prune:
        # one pass over the command column; at most one row per rule comes back
        present = {r["rule"] for r in prep.select("rule").where("rule IS NOT NULL").distinct().collect()}
        defs = {k: d for k, d in defs.items() if k in present}
    run = RunColumns(nn(F.col("command")), F.col("exit_code"), nn(F.col("stdout")), F.col("verbose"), F.col("ultra_compact"), F.lit(True))
    open_rule = F.when(F.col("gate").isNull(), F.col("rule"))
    prep = settled(prep, "text", "gate", "combined", "raw_tokens")
    out = settled(prep.withColumn("reduced", reduce_text(F.col("text"), open_rule, defs, run)), "reduced")
    b, a, x, cmd = F.col("text"), F.col("reduced"), F.col("exit_code"), F.col("command")
    went_on = F.col("gate").isNull()
    out = out.withColumn("failures", F.when(went_on, D.fidelity_failures(cmd, x, b, a)).otherwise(F.array().cast("array<string>")))
    out = settled(out, "failures")
    lost = F.size("failures") > 0
    loss = went_on & ~lost & (x == 0) & D.is_net_loss(b, a, estimate_tokens(b), estimate_tokens(a), F.col("ultra_compact")) \
        & ~D.is_intended_growth(cmd, b, a)
    out = settled(out.withColumn("_lost", lost).withColumn("_loss", loss), "_lost", "_loss")
    final = (F.when(F.col("gate") == "passthrough", F.col("combined")).when(~went_on, F.col("gate"))
             .when(F.col("_lost") | F.col("_loss"), F.col("combined")).otherwise(D.append_factsheet(b, a)))
    out = settled(out.withColumn("text_out", final), "text_out")
    kind = (F.when(F.col("rule").isNull(), F.lit(None).cast("string")).when(~went_on, "gate").when(F.col("_lost"), "fidelity_guard")
            .when(F.col("_loss"), "net_win_gate"))
    raw = (F.col("gate") == "passthrough") | F.col("_lost") | F.col("_loss")
    filtered = ~F.coalesce(raw, F.lit(False))
    return out.select(
        *runs.columns, "rule", "text_out", filtered.alias("was_filtered"),
        F.when(F.col("_lost"), F.lit("apply_fallback")).alias("incident"),
        F.when(F.col("_lost"), D.failure_detail(F.col("failures"))).alias("detail"), kind.alias("gate_kind"), "raw_tokens",
        F.when(filtered, estimate_tokens(F.col("text_out"))).otherwise(F.col("raw_tokens")).alias("out_tokens"))


def ledger_rows(results: DataFrame) -> DataFrame:
    """Pipeline results as ledger rows (needs ts, project, cwd and exec_ms on the runs)."""
    return results.select("ts", "command", "project", "cwd", "raw_tokens", "out_tokens", "exec_ms",
                          F.lit(ESTIMATOR).alias("estimator"), F.lit(1).alias("schema_version"))


# --- D6 explain ------------------------------------------------------------------------------

SAMPLES = 32


def explain(runs: DataFrame, stages: list[Mapping], text: str = "text") -> DataFrame:
    """One row per run and stage: lines and tokens in and out, and what changed.

    Each stage output is bound once and handed to the next stage, and the line
    diff of a stage is computed inside the row: a corpus is explained in one scan.
    """
    run = RunColumns(nn(F.col("command")), F.col("exit_code") if "exit_code" in runs.columns else F.lit(0), nn(F.col(text)),
                     F.lit(0), F.lit(False), F.lit(True))

    def chain(i: int, current: Column, stopped: Column) -> Column:
        p = stages[i]
        st = stage(p["strategy"])
        out = st.fn(current, run, p)
        nxt, stop = out if isinstance(out, tuple) else (out, F.lit(False))
        row = F.struct(F.lit(i).alias("stage_no"), F.lit(st.name).alias("stage"), F.lit(st.streamability).alias("streamability"),
                       F.when(stopped, "skipped").when(stop, "short_circuited").otherwise("ran").alias("status"),
                       current.alias("before"), F.when(stopped, current).otherwise(nxt).alias("after"))
        if i + 1 == len(stages):
            return F.array(row)
        return let(row, lambda r: F.concat(F.array(r), chain(i + 1, r["after"], r["status"] != "ran")))

    per = runs.select("run_id", F.explode(chain(0, nn(F.col(text)), F.lit(False))).alias("s")).select("run_id", "s.*")
    skipped = F.col("status") == "skipped"
    b, a = F.col("before"), F.col("after")
    per = per.withColumn("d", D.diff_in_row(b, a, SAMPLES))
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    count = lambda c: F.when(skipped, zero).otherwise(F.col(f"d.{c}"))
    return per.select(
        "run_id", "stage_no", "stage", "status", "streamability",
        *[F.when(skipped, 0).otherwise(c).alias(n) for n, c in (
            ("input_lines", F.size(lines_raw_of(b))), ("output_lines", F.size(lines_raw_of(a))),
            ("input_tokens", estimate_tokens(b)), ("output_tokens", estimate_tokens(a)))],
        count("dropped").alias("dropped_lines"), count("added").alias("added_lines"), count("kept").alias("kept_lines"),
        (F.col("status") == "short_circuited").alias("short_circuit"),
        *[F.when(skipped, none).otherwise(F.col(f"d.{s}_sample")).alias(f"{s}_sample") for s in ("dropped", "added")],
        (count("dropped") > SAMPLES).alias("dropped_truncated"), (count("added") > SAMPLES).alias("added_truncated"))
