"""Structured Streaming forms: per-line stages, windowed stages, documents, savings, corrections.

Line streams have (run_id, line_no, ts, line, is_end, exit_code). Line numbers of a
run never decrease from one micro-batch to the next; inside a micro-batch rows may
come in any order and from any partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runsift.functions import commands as C
from runsift.functions.text import nn
from runsift.operators import reduce as R
from runsift.operators.extract import IMAGE_DONE, IMAGE_DONE_CAP, IMAGE_ERROR, NPM_CAP, NPM_KEEP
from runsift.operators.sessions import CORRECTION_WINDOW_MS

@dataclass(frozen=True)
class Batches:
    """A keyed stream whose micro-batches are ordinary jobs, so that no run has a Python call of its own: `drain` runs it.

    ``reduce`` makes a bounded table of a batch; from it and the ``state`` left by the batch before, ``emit`` makes the rows to
    append (``schema``) and ``keep`` the state that goes on.
    """

    lines: DataFrame
    schema: str
    state: str
    reduce: Callable[[DataFrame], DataFrame]
    emit: Callable[[DataFrame, DataFrame], DataFrame]
    keep: Callable[[DataFrame, DataFrame], DataFrame]


WEEK_OFFSET = "4 days"  # epoch day 0 is a Thursday, so Monday weeks start four days later


# --- J1 -----------------------------------------------------------------------------

def stream_lines(lines: DataFrame, fn: Callable[[Column], Column] = R.ansi_strip) -> DataFrame:
    """Stateless per-line stage: every row is answered in the batch it arrives in."""
    return lines.withColumn("line", fn(nn(F.col("line"))))


#: Lines of a run's tail in its state.
LAST = "array<struct<no:bigint,line:string>>"

#: Lines of a run that one task folds at a time.
PART = 4096


def machine_parts(lines: DataFrame, transitions: Sequence[Mapping[str, str]], states: Sequence[str], defaults: Mapping[str, str], part: int = PART) -> DataFrame:
    """(run_id, part, line_nos, lines, ends, keeps): a state machine over the parts of runs, for every start state.

    ``ends``: the state behind a part by the state in front of it; ``keeps``: the lines it then keeps. The patterns are
    matched in the JVM as a bit per transition; a part has ``part`` line numbers at most, however long its run is.
    """
    at = {s: i for i, s in enumerate(states)}
    table = [(at[t["from_state"]], (t.get("action") or "EMIT").upper() == "EMIT", at[t["next_state"]]) for t in transitions]
    emits = [(defaults[s] or "EMIT").upper() == "EMIT" if s in defaults else False for s in states]
    hits = F.concat(F.lit(""), *[F.when(nn(F.col("line")).rlike(t["pattern"]), "1").otherwise("0") for t in transitions])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves: dict[str, tuple[list[int], list[bool]]] = {}

        def move(flags: str) -> tuple[list[int], list[bool]]:
            to, keep = list(range(len(states))), list(emits)
            for (start, emit, end), hit in reversed(list(zip(table, flags, strict=True))):  # the first that matches decides
                if hit == "1":
                    to[start], keep[start] = end, emit
            return to, keep

        def folded(codes: list[str]) -> tuple[list[int], list[list[bool]]]:
            now, keeps = list(range(len(states))), [[] for _ in states]
            for code in codes:
                if code not in moves:
                    moves[code] = move(code)
                to, keep = moves[code]
                for kept, state in zip(keeps, now, strict=True):
                    kept.append(keep[state])
                now = [to[state] for state in now]
            return now, keeps

        def answer(rows: pa.Table, starts: list[int]) -> pa.RecordBatch:
            """Parts that begin at ``starts``; the last start is the end."""
            first = pa.array(starts[:-1], pa.int64())
            codes = rows.column("hits").to_pylist()
            done = [folded(codes[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            offsets = pa.array(starts, pa.int32())
            body = rows.slice(0, starts[-1])
            lists = [pa.ListArray.from_arrays(offsets, body.column(c).combine_chunks()) for c in ("line_no", "line")]
            return pa.RecordBatch.from_arrays([*[rows.column(c).take(first).combine_chunks() for c in ("run_id", "part")], *lists, pa.array([x[0] for x in done], pa.list_(pa.int32())),
                                               pa.array([x[1] for x in done], pa.list_(pa.list_(pa.bool_())))], names=["run_id", "part", "line_nos", "lines", "ends", "keeps"])

        open_ = None  # rows of the part that may go on in the next Arrow batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if open_ is None else pa.concat_tables([open_, rows])
            rows = rows.combine_chunks()
            keys = list(zip(rows.column("run_id").to_pylist(), rows.column("part").to_pylist(), strict=True))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            if len(starts) > 1:
                yield answer(rows, starts)
            open_ = rows.slice(starts[-1]) if starts else None
        if open_ is not None:
            rows = open_.combine_chunks()
            yield answer(rows, [0, rows.num_rows])

    rows = lines.where("run_id IS NOT NULL").select("run_id", F.floor(F.col("line_no") / part).alias("part"), "line_no", "line", hits.alias("hits"))
    rows = rows.repartition("run_id", "part").sortWithinPartitions("run_id", "part", "line_no")
    return rows.mapInArrow(fold, "run_id bigint, part bigint, line_nos array<bigint>, lines array<string>, ends array<int>, keeps array<array<boolean>>")


def machine_starts(parts: DataFrame, before: DataFrame, initial: int) -> DataFrame:
    """(run_id, part, start, end): the state in front of each part and behind it, by joining the parts' maps end to end.

    ``before``: (run_id, state) of the runs that began earlier. Only the maps of a run come together, a few numbers a part.
    """
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, now = None, 0
        for batch in batches:
            starts, behind = [], []
            for key, ends, state in zip(*[batch.column(c).to_pylist() for c in ("run_id", "ends", "state")], strict=True):
                if key != run:
                    run, now = key, state
                starts.append(now)
                now = ends[now]
                behind.append(now)
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("part"), pa.array(starts, pa.int32()), pa.array(behind, pa.int32())], names=["run_id", "part", "start", "end"])

    rows = parts.select("run_id", "part", "ends").join(before, "run_id", "left").withColumn("state", F.coalesce("state", F.lit(initial)))
    return rows.repartition("run_id").sortWithinPartitions("run_id", "part").mapInArrow(chain, "run_id bigint, part bigint, start int, end int")


def run_state_machine(lines: DataFrame, folder: str, initial: str, transitions: Sequence[Mapping[str, str]],
                      defaults: Mapping[str, str] | None = None, part: int = PART) -> DataFrame:
    """Kept lines (run_id, line_no, line) of a line stream by a state machine, over everything available.

    Each micro-batch is an ordinary job: parts of runs are folded apart for every start state, their maps are joined
    end to end, and the start states found go back to the parts, so that a run that fills a batch is many tasks. The state
    of runs that go on is a table of one row a run in ``folder`` (on storage all executors share); it is written beside the one
    it is made from, and a batch replaces its own output, so a batch that is repeated after a failure changes nothing.
    """
    defaults = dict(defaults or {})
    states = list(dict.fromkeys([initial, *[t[k] for t in transitions for k in ("from_state", "next_state")], *defaults]))

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        table = "run_id bigint, state int"
        before = spark.read.schema(table).parquet(f"{folder}/states/{(number - 1) % 2}") if number else spark.createDataFrame([], table)
        body = df.where("NOT is_end") if "is_end" in df.columns else df
        machine_parts(body, transitions, states, defaults, part).write.mode("overwrite").parquet(f"{folder}/parts")
        parts = spark.read.parquet(f"{folder}/parts")
        machine_starts(parts, before, 0).write.mode("overwrite").parquet(f"{folder}/starts")
        starts = spark.read.parquet(f"{folder}/starts")
        kept = parts.join(starts, ["run_id", "part"]).select("run_id", F.explode(F.arrays_zip("line_nos", "lines", F.get("keeps", F.col("start")).alias("kept"))).alias("x"))
        kept.where("x.kept").select("run_id", F.col("x.line_nos").alias("line_no"), F.col("x.lines").alias("line")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        now = starts.groupBy("run_id").agg(F.max_by("end", "part").alias("now"))
        after = before.join(now, "run_id", "full").select("run_id", F.coalesce("now", "state").alias("state"))
        if "is_end" in df.columns:
            after = after.join(df.where("is_end").select("run_id").distinct(), "run_id", "left_anti")
        after.write.mode("overwrite").parquet(f"{folder}/states/{number % 2}")

    schema = "run_id bigint, line_no bigint, line string"
    lines.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")  # a stream may have nothing
    query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return lines.sparkSession.read.schema(schema).parquet(f"{folder}/out").drop("batch")


def stream_capped_lines(lines: DataFrame, tool: str) -> Batches:
    """Lines an image build or a package install shows at once, with their caps.

    Lines without a cap pass. Of the others each Arrow batch keeps a run's first ones up to the cap, since no later one
    can be shown, so the ranking gets a bounded number of rows from a task however much a run prints; the state of a run is how many it has shown.
    """
    line = nn(F.col("line"))
    counted = {"image": line.rlike(IMAGE_DONE), "npm": line.rlike(NPM_KEEP)}[tool]
    free = line.rlike(IMAGE_ERROR) if tool == "image" else F.lit(False)
    cap = IMAGE_DONE_CAP if tool == "image" else NPM_CAP
    schema = "run_id bigint, line_no bigint, line string"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = pdf[pdf["counted"]].groupby("run_id")["line_no"].rank(method="first")
            pdf["counted"] = rank.le(cap).reindex(pdf.index, fill_value=False)
            yield pdf[pdf["counted"] | pdf["free"]]

    def reduce(df: DataFrame) -> DataFrame:
        rows = df.select("run_id", "line_no", "line", counted.alias("counted"), free.alias("free")).where("counted OR free")
        return rows.mapInPandas(first, f"{schema}, counted boolean, free boolean")

    def emit(rows: DataFrame, before: DataFrame) -> DataFrame:
        ranked = rows.where("counted").withColumn("k", F.row_number().over(W.partitionBy("run_id").orderBy("line_no"))).where(F.col("k") <= cap)
        shown = ranked.join(before, "run_id", "left").where((F.col("k") + F.coalesce("seen", F.lit(0)) <= cap) & ~F.col("free"))
        return shown.select("run_id", "line_no", "line").unionByName(rows.where("free").select("run_id", "line_no", "line"))

    def keep(rows: DataFrame, before: DataFrame) -> DataFrame:
        more = rows.where("counted").groupBy("run_id").agg(F.count("*").alias("n"))
        seen = F.coalesce("seen", F.lit(0)) + F.coalesce("n", F.lit(0))
        return before.join(more, "run_id", "full").select("run_id", F.least(seen, F.lit(cap)).cast("int").alias("seen"))

    return Batches(lines, schema, "run_id bigint, seen int", reduce, emit, keep)


# --- J2, J3 ---------------------------------------------------------------------------

def stream_head_tail(lines: DataFrame, head: int, tail: int, timeout: bool = False) -> Batches | DataFrame:
    """First lines at once, the rest at the end of the run around a marker.

    A run ends with its end-marker row or, with ``timeout``, when the watermark
    passes its last event. Each partition first reduces a run to its count and its
    outermost lines, so a run that fills a batch reaches the keyed step as a few rows.
    Only ``timeout`` needs Spark's keyed state, which calls Python once a run.
    """
    return _timed_head_tail(lines, head, tail) if timeout else _ended_head_tail(lines, head, tail)


def _ended_head_tail(lines: DataFrame, head: int, tail: int) -> Batches:
    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["run_id", "line_no"], kind="stable")
            body = pdf[~pdf["is_end"]]
            runs = body.groupby("run_id", sort=False)["line_no"]
            at, size = runs.cumcount(), runs.transform("size")
            edge = body[(at < head) | (at >= size - tail)].drop_duplicates(["run_id", "line_no"])
            yield edge[["run_id", "line_no", "line"]].assign(n=0, is_end=False, edge=True)
            ends = pdf.groupby("run_id", sort=False)["is_end"].agg(["size", "sum", "max"]).reset_index()
            yield pd.DataFrame({"run_id": ends["run_id"], "line_no": 0, "line": None, "n": ends["size"] - ends["sum"], "is_end": ends["max"].astype(bool), "edge": False})

    def reduce(df: DataFrame) -> DataFrame:
        rows = df.where("run_id IS NOT NULL").select("run_id", "line_no", "line", "is_end").mapInPandas(
            outer, "run_id bigint, line_no bigint, line string, n bigint, is_end boolean, edge boolean")
        edge = F.collect_set(F.when(F.col("edge"), F.struct(F.col("line_no").alias("no"), "line")))
        return rows.groupBy("run_id").agg(F.sum("n").alias("n"), F.bool_or("is_end").alias("ended"), F.array_sort(edge).alias("edge"))

    def joined(runs: DataFrame, before: DataFrame) -> DataFrame:
        """seen (lines before this batch), count, first (lines of the head that are new), last (the tail so far)."""
        rows = runs.join(before, "run_id", "left").withColumns({"seen": F.coalesce("count", F.lit(0).cast("bigint")), "last": F.coalesce("last", F.array().cast(LAST))})
        new = F.greatest(F.lit(0), F.lit(head) - F.col("seen")).cast("int")
        # a line that is already shown as head must not come again as tail
        rest = F.concat("last", F.slice("edge", new + 1, F.size("edge")))
        rows = rows.select("run_id", "ended", "seen", (F.col("seen") + F.col("n")).alias("count"), F.slice("edge", F.lit(1), new).alias("first"), rest.alias("rest"))
        return rows.withColumn("last", F.slice("rest", F.greatest(F.lit(1), F.size("rest") - tail + 1), F.lit(tail)))

    def emit(runs: DataFrame, before: DataFrame) -> DataFrame:
        row = lambda no, line: F.struct(no.cast("bigint").alias("out_no"), line.alias("line"))
        omitted = F.col("count") - head - tail
        marker = F.format_string(f"... (%d lines omitted: lines {head + 1}..%d of %d) ...", omitted, F.col("count") - tail, F.col("count"))
        none = F.array().cast("array<struct<out_no:bigint,line:string>>")
        shown = F.transform("first", lambda x, i: row(F.col("seen") + i + 1, x["line"]))
        middle = F.when(F.col("ended") & (omitted > 0), F.array(row(F.lit(head + 1), marker))).otherwise(none)
        close = F.when(F.col("ended"), F.transform("last", lambda x: row(x["no"] + 1, x["line"]))).otherwise(none)
        return joined(runs, before).select("run_id", F.explode(F.concat(shown, middle, close)).alias("x")).select("run_id", "x.*")

    def keep(runs: DataFrame, before: DataFrame) -> DataFrame:
        going = joined(runs, before).where("NOT ended").select("run_id", "count", "last")
        return going.unionByName(before.join(runs, "run_id", "left_anti"))

    return Batches(lines, "run_id bigint, out_no bigint, line string", f"run_id bigint, count bigint, last {LAST}", reduce, emit, keep)


def _timed_head_tail(lines: DataFrame, head: int, tail: int) -> DataFrame:
    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for run, g in pdf.sort_values("line_no").groupby("run_id", sort=False):
                body = g[~g["is_end"]]
                edge = pd.concat([body.head(head), body.tail(tail)]).drop_duplicates("line_no")
                rows.append((run, len(body), g["is_end"].any(), list(edge["line_no"]), list(edge["line"]), g["ts"].max()))
            if rows:
                yield pd.DataFrame(rows, columns=["run_id", "n", "is_end", "nos", "texts", "ts"])

    def finish(run, count, last):
        omitted = count - head - tail
        out = []
        if omitted > 0:
            out.append((run, head + 1, f"... ({omitted} lines omitted: lines {head + 1}..{count - tail} of {count}) ..."))
        out += [(run, no + 1, text) for no, text in last]
        return pd.DataFrame(out, columns=["run_id", "out_no", "line"])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, nos, texts = state.get if state.exists else (0, [], [])
        last = list(zip(nos, texts, strict=True))
        if state.hasTimedOut:
            state.remove()
            yield finish(key[0], count, last)
            return
        parts = pd.concat(list(batches))
        lines_ = sorted(set((no, t) for ns, ts in zip(parts["nos"], parts["texts"], strict=True) for no, t in zip(ns, ts, strict=True)))
        first = [(key[0], count + i + 1, t) for i, (_, t) in enumerate(lines_[:max(0, head - count)])]
        rest = lines_[len(first):]
        count += int(parts["n"].sum())
        # a line that is already shown as head must not come again as tail
        last = (last + rest)[-tail:] if tail else []
        if parts["is_end"].any():
            if state.exists:
                state.remove()
            yield pd.concat([pd.DataFrame(first, columns=["run_id", "out_no", "line"]), finish(key[0], count, last)])
            return
        state.update((count, [no for no, _ in last], [t for _, t in last]))
        state.setTimeoutTimestamp(max(int(parts["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs() + 1) + 1)
        yield pd.DataFrame(first, columns=["run_id", "out_no", "line"])

    partial = lines.select("run_id", "line_no", "line", "is_end", "ts").mapInPandas(
        outer, "run_id bigint, n bigint, is_end boolean, nos array<bigint>, texts array<string>, ts timestamp")
    return partial.withWatermark("ts", "10 minutes").groupBy("run_id").applyInPandasWithState(
        step, "run_id bigint, out_no bigint, line string", "n bigint, nos array<bigint>, texts array<string>", "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_install_summary(lines: DataFrame) -> Batches:
    """End-of-run summary of a package install, once its end marker (with the exit
    code) has come: (run_id, line). State is two captures."""
    added, audit = F.regexp_extract(nn(F.col("line")), r"added (\d+) packages?", 1), F.regexp_extract(nn(F.col("line")), r"found (\d+) vulnerabilit", 0)

    def reduce(df: DataFrame) -> DataFrame:
        rows = df.select("run_id", "line_no", "is_end", F.coalesce("exit_code", F.lit(0)).alias("exit_code"), added.alias("added"), audit.alias("audit"))
        last = lambda c, when: F.max(F.when(when, F.struct("line_no", c)))[c].alias(c)
        return rows.where("is_end or added <> '' or audit <> ''").groupBy("run_id").agg(
            last("added", F.col("added") != ""), last("audit", F.col("audit") != ""), last("exit_code", F.col("is_end")), F.bool_or("is_end").alias("ended"))

    def joined(runs: DataFrame, before: DataFrame) -> DataFrame:
        """Captures with those of earlier batches; a run without an id is one run too."""
        old = before.select(F.col("run_id").alias("id"), F.col("added").alias("a"), F.col("audit").alias("u"))
        rows = runs.join(old, F.col("run_id").eqNullSafe(F.col("id")), "left")
        return rows.withColumns({"added": F.coalesce("added", "a", F.lit("")), "audit": F.coalesce("audit", "u", F.lit(""))})

    def emit(runs: DataFrame, before: DataFrame) -> DataFrame:
        packages = F.when(F.col("added") != "", F.concat(F.lit(": "), "added", F.lit(" packages"))).otherwise("")
        found = F.when(F.col("audit") != "", F.concat(F.lit(" | "), "audit")).otherwise("")
        return joined(runs, before).where("ended AND exit_code = 0").select("run_id", F.concat(F.lit("✓ npm install"), packages, found).alias("line"))

    def keep(runs: DataFrame, before: DataFrame) -> DataFrame:
        met = runs.select(F.col("run_id").alias("id"))
        return joined(runs, before).where("NOT ended").select("run_id", "added", "audit").unionByName(before.join(met, F.col("run_id").eqNullSafe(F.col("id")), "left_anti"))

    return Batches(lines, "run_id bigint, line string", "run_id bigint, added string, audit string", reduce, emit, keep)


# --- J4 -----------------------------------------------------------------------------------

def stream_documents(lines: DataFrame, stage: Callable[[Column], Column], gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Whole-text stages: a run's lines are gathered until it has been silent for
    ``gap``, then reduced. Capture bounds a run, so a gathered text is bounded too."""
    texts = lines.where("NOT is_end").withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(
        F.collect_list(F.struct("line_no", "line")).alias("ls"))
    text = F.array_join(F.transform(F.array_sort("ls"), lambda x: x["line"]), "\n")
    return texts.select("run_id", text.alias("text")).select("run_id", stage(F.col("text")).alias("text"))


# --- J5 -----------------------------------------------------------------------------------

def stream_savings(ledger: DataFrame, window: str = "1 day", slide: str | None = None, start: str | None = None,
                   delay: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """Savings per event-time window; partial sums combine before the shuffle."""
    w = F.window("ts", window, slide or window, start) if start else F.window("ts", window, slide or window)
    sums = ledger.withWatermark("ts", delay).groupBy(w.alias("w"), *by).agg(
        F.count("*").alias("commands"), F.sum("raw_tokens").alias("raw"), F.sum("out_tokens").alias("out"))
    return sums.select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), *by, "commands", "raw", "out",
                       (F.col("raw") - F.col("out")).alias("saved"))


def stream_weekly_savings(ledger: DataFrame, delay: str = "1 hour") -> DataFrame:
    return stream_savings(ledger, "7 days", "7 days", WEEK_OFFSET, delay)


# --- J6 -----------------------------------------------------------------------------------

def stream_correction_pairs(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Correction pairs as sessions go on; a session's state is its one waiting failure.

    The wait ends after 30 minutes of event time, also without another event.
    """
    window = CORRECTION_WINDOW_MS
    word = C.first_word(nn(F.col("command")))

    def related(a: str, b: str) -> bool:
        return a.lower() == b.lower() or any(t in a and t in b for t in C.RELATED_TOOLS)

    columns = ["session_id", "failed_command", "failed_exit", "corrected_command", "delta_ms"]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        wait = state.get if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.exit_code != 0:
                wait = (r.command, int(r.exit_code), r.word, int(r.us))
            elif wait is not None:
                delta = (int(r.us) - wait[3]) // 1000
                if not 0 <= delta <= window:
                    wait = None
                elif related(wait[2], r.word):
                    out.append((key[0], wait[0], wait[1], r.command, delta))
                    wait = None
        if wait is None:
            if state.exists:
                state.remove()
        else:
            state.update(wait)
            state.setTimeoutTimestamp(max(wait[3] // 1000 + window + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=columns)

    rows = events.where(F.col("command").isNotNull()).select(
        "session_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "command", "exit_code", word.alias("word"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.withWatermark("ts", delay).groupBy("session_id").applyInPandasWithState(
        step, "session_id string, failed_command string, failed_exit int, corrected_command string, delta_ms bigint",
        "command string, exit_code int, word string, us bigint", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame | Batches, folder: str) -> DataFrame:
    """Run a stream over everything available and read its output table back.

    ``folder`` must be on storage all executors share.
    """
    if isinstance(stream, Batches):
        return _drain_batches(stream, folder)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _drain_batches(stream: Batches, folder: str) -> DataFrame:
    """A batch writes its state beside the one it is made from and replaces its own output, so one that is repeated changes nothing."""
    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = spark.read.schema(stream.state).parquet(f"{folder}/states/{(number - 1) % 2}") if number else spark.createDataFrame([], stream.state)
        reduced = stream.reduce(df)
        reduced.write.mode("overwrite").parquet(f"{folder}/reduced")
        rows = spark.read.schema(reduced.schema).parquet(f"{folder}/reduced")
        stream.emit(rows, before).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        stream.keep(rows, before).write.mode("overwrite").parquet(f"{folder}/states/{number % 2}")

    spark = stream.lines.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")  # a stream may have nothing
    query = stream.lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").drop("batch")
