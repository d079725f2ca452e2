"""Streaming jobs in many micro-batches against their batch forms."""

import random

from pyspark.sql import functions as F

from runsift.operators import reduce as R
from runsift.streaming import jobs

MACHINE = {"initial": "START", "transitions": [
    {"from_state": "START", "pattern": "^begin", "next_state": "IN", "action": "EMIT"},
    {"from_state": "IN", "pattern": "skip", "next_state": "IN", "action": "DISCARD"},
    {"from_state": "IN", "pattern": "^end", "next_state": "START", "action": "DISCARD"},
    {"from_state": "IN", "pattern": "odd", "next_state": "ODD"},
    {"from_state": "ODD", "pattern": "^end|skip", "next_state": "START"}], "defaults": {"IN": "EMIT", "ODD": "DISCARD"}}
LINES = "run_id bigint, line_no bigint, line string, is_end boolean"


def rows_of(seed, runs=12, hot=1500):
    rng = random.Random(seed)
    words = ["begin x", "skip it", "end", "odd one", "plain", "begin odd", ""]
    return {r: [rng.choice(words) for _ in range(hot if r == 3 else rng.randint(0, 60))] for r in range(runs)}


def written(spark, path, runs, cuts=5):
    """Lines in ``cuts`` files, each with a later stretch of every run, its rows in any order."""
    rng = random.Random(1)
    for k in range(cuts):
        rows = [(r, i, line, False) for r, ls in runs.items() for i, line in enumerate(ls) if i * cuts // max(1, len(ls)) == k]
        rows += [(r, len(runs[r]), "", True) for r in runs if k == cuts - 1 and r % 2]
        rng.shuffle(rows)
        spark.createDataFrame(rows, LINES).repartition(1).write.mode("append").parquet(f"{path}/in-{k}")
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_state_machine_over_parts(spark, tmp_path):
    """Parts of 7 lines, five micro-batches, one run far longer than the rest: the lines of the batch operator."""
    runs = rows_of(2)
    stream = written(spark, str(tmp_path / "in"), runs)
    got = jobs.run_state_machine(stream, str(tmp_path / "job"), **MACHINE, part=7)
    texts = spark.createDataFrame([(r, "".join(x + "\n" for x in ls)) for r, ls in runs.items()], "run_id bigint, text string")
    want = {r.run_id: r.v for r in texts.select("run_id", R.state_machine(F.col("text"), **MACHINE).alias("v")).collect()}
    out = {r: [] for r in runs}
    for row in got.orderBy("run_id", "line_no").collect():
        assert runs[row.run_id][row.line_no] == row.line
        out[row.run_id].append(row.line)
    assert {r: "\n".join(ls) for r, ls in out.items()} == want
    left = spark.read.parquet(str(tmp_path / "job" / "states" / "0"))
    assert all(r.run_id % 2 == 0 for r in left.collect())  # a run that has ended leaves no state


def test_parts_of_a_hot_run_are_many_groups(spark):
    lines = spark.createDataFrame([(1, i, "plain") for i in range(1000)], "run_id bigint, line_no bigint, line string")
    parts = jobs.machine_parts(lines, MACHINE["transitions"], ["START", "IN", "ODD"], MACHINE["defaults"], 64)
    got = parts.select("part", F.size("lines").alias("n")).collect()
    assert len(got) == 16 and max(r.n for r in got) == 64


def test_capped_lines(spark, tmp_path):
    runs = {r: [f"#{i} DONE" if i % 3 else ("ERROR odd" if i % 2 else "noise") for i in range(200 if r else 20)] for r in range(4)}
    runs[2] = [f"#{i} DONE ERROR" for i in range(100)]
    out = jobs.drain(jobs.stream_capped_lines(written(spark, str(tmp_path / "in"), runs).where("NOT is_end"), "image"), str(tmp_path / "job"))
    got = {}
    for row in out.collect():
        got.setdefault(row.run_id, set()).add(row.line_no)
    for r, ls in runs.items():
        done = [i for i, x in enumerate(ls) if "DONE" in x][:30]
        assert got[r] == set(done) | {i for i, x in enumerate(ls) if "ERROR" in x}
    assert out.count() == sum(map(len, got.values()))


def test_stream_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
    assert jobs.run_state_machine(stream, str(tmp_path / "job"), **MACHINE).count() == 0


EVENTS = "run_id bigint, line_no bigint, ts timestamp, line string, is_end boolean, exit_code int"


def events_of(spark, path, runs, cuts=5):
    """`written` with the time and exit code columns."""
    lines = written(spark, path, runs, cuts)
    return lines.select("run_id", "line_no", F.timestamp_seconds(F.col("line_no")).alias("ts"), "line", "is_end", (F.col("run_id") % 4 - 1).cast("int").alias("exit_code"))


def test_head_tail_of_runs_in_many_batches(spark, tmp_path):
    """Heads come at once, also of runs that never end; tails and markers only at the end marker; the job calls no Python per run."""
    runs = rows_of(4, runs=14, hot=900)
    stream = jobs.stream_head_tail(events_of(spark, str(tmp_path / "in"), runs), 4, 6)
    assert isinstance(stream, jobs.Batches)
    got = {}
    for row in jobs.drain(stream, str(tmp_path / "job")).collect():
        got.setdefault(row.run_id, []).append((row.out_no, row.line))
    for r, ls in runs.items():
        want = [(i + 1, x) for i, x in enumerate(ls[:4])]
        if r % 2:
            n = len(ls)
            want += [(5, f"... ({n - 10} lines omitted: lines 5..{n - 6} of {n}) ...")] if n > 10 else []
            want += [(i + 1, ls[i]) for i in range(max(4, n - 6), n)]
        assert sorted(got.get(r, [])) == sorted(want), r
    assert not spark.read.schema(stream.state).parquet(str(tmp_path / "job" / "states" / "0")).where("run_id % 2 = 1").count()


def test_install_summary_of_runs_in_many_batches(spark, tmp_path):
    runs = {r: [f"added {i} packages" if i % 3 == 1 else "found 2 vulnerabilities" if i == r else "x" for i in range(r * 4)] for r in range(9)}
    stream = jobs.stream_install_summary(events_of(spark, str(tmp_path / "in"), runs))
    assert isinstance(stream, jobs.Batches)
    got = {row.run_id: row.line for row in jobs.drain(stream, str(tmp_path / "job")).collect()}
    # odd runs end; those of exit code 0 are summed up
    want = {r: "✓ npm install: %d packages%s" % (max(i for i in range(r * 4) if i % 3 == 1), " | found 2 vulnerabilit" if r % 3 != 1 else "") for r in (1, 5)}
    assert got == want


def test_a_part_goes_on_over_arrow_batches(spark):
    """Parts are folded from sorted rows, however the rows are cut into Arrow batches."""
    rows = [(r, i, "begin" if i % 5 == 0 else "end" if i % 7 == 0 else "plain") for r in range(7) for i in range(50)]
    lines = spark.createDataFrame(rows, "run_id bigint, line_no bigint, line string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        found = []
        for size in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            parts = jobs.machine_parts(lines, MACHINE["transitions"], ["START", "IN", "ODD"], MACHINE["defaults"], 20)
            assert "FlatMapGroupsInPandas" not in parts._jdf.queryExecution().toString()
            found.append(sorted(map(tuple, parts.collect())))
        assert found[0] == found[1] and len(found[0]) == 21
        assert all(len(r[2]) == len(r[3]) == len(r[5][0]) for r in found[0])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
