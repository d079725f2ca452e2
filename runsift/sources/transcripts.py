"""Agent transcripts to session events: JSON lines, command lists and step lists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsift.functions.redact import redact
from runsift.functions.text import is_blank, lines_of, nn, trim_ctl
from runsift.operators.plan_shape import settled
from runsift.operators.prepare import with_bound
from runsift.operators.sessions import PROXY_PREFIX, REDUCED_MARKER, pair_tool_calls
from runsift.session import checkpoint_dir

# The usual choice of a report, for callers that want it (nothing is cut unless asked for).
MAX_FILE_BYTES, MAX_FILES, MAX_AGE_DAYS = 10 * 1024 * 1024, 100, 30
_ITEM_SPACE = 65_536

_TOOL = "struct<type:string,id:string,name:string,input:struct<command:string>,tool_use_id:string,is_error:string,exit_code:string,content:string>"
_LINE = ("struct<timestamp:string,cwd:string,command:string,exitCode:string,exit_code:string,output:string,durationMillis:string,"
         "outputBytes:string,filtered:string,type:string,id:string,name:string,input:struct<command:string>,tool_use_id:string,"
         f"is_error:string,content:string,message:struct<content:array<{_TOOL}>>>")
_ITEM = ("struct<command:string,cmd:string,terminalCommand:string,exitCode:string,exit_code:string,output:string,result:string,"
         "durationMillis:string,outputBytes:string,filtered:string,timestamp:string,id:string,stepId:string>")
_OBJECT = f"struct<sessionId:string,cascadeId:string,workspace:string,directory:string,commands:array<{_ITEM}>,steps:array<{_ITEM}>>"
EVENT_COLUMNS = ["session_id", "seq", "event_id", "ts", "command", "exit_code", "duration_ms", "output_bytes", "output", "filtered"]


def _cut(as_of: str | None, max_age_days: int | None) -> Column | None:
    if max_age_days is None:
        return None
    return (F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")) - F.make_dt_interval(F.lit(max(1, max_age_days)))


def transcript_files(spark: SparkSession, path: str, pattern: str, as_of: str | None = None, max_age_days: int | None = None,
                     max_files: int | None = None) -> DataFrame:
    """(path, session_id, modified, bytes) of the matching files, of the newest ``max_files`` if given.

    Only the listing is read: the file source gives names, times and sizes without opening a file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    cut = _cut(as_of, max_age_days)
    rows = rows if cut is None else rows.where(F.col("modified") > cut)
    rows = rows if max_files is None else rows.orderBy(F.desc("modified"), "path").limit(max(1, max_files))
    return rows.select("path", session_of(F.col("path")).alias("session_id"), "modified", "bytes")


def _chosen(files: DataFrame, as_of: str | None, max_age_days: int | None, max_files: int | None, pattern: str, path: str) -> DataFrame:
    """Rows of a file source from the chosen files. The conditions are on file metadata alone, so the scan drops the other
    files while it is planned; the names that come to the driver are ``max_files`` at most."""
    if max_files is not None:
        names = [r["path"] for r in transcript_files(files.sparkSession, path, pattern, as_of, max_age_days, max_files).select("path").collect()]
        return files.where(F.col("_metadata.file_path").isin(names)) if names else files.where(F.lit(False))
    cut = _cut(as_of, max_age_days)
    return files if cut is None else files.where(F.col("_metadata.file_modification_time") > cut)


def transcript_lines(spark: SparkSession, path: str, pattern: str, as_of: str | None = None, max_age_days: int | None = None,
                     max_files: int | None = None, session: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, session_id, line_no, line) of the chosen files, line numbers from 0; ``session`` names a session by its path.

    A file is cut into blocks by the scan, so a large one is read by many tasks and no task holds a file. A row is placed by
    its file, the start of its block and its position in the block; a table with one row a block, made by a pass that
    only counts, says how many lines stand before a block.
    """
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    rows = _chosen(files, as_of, max_age_days, max_files, pattern, path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value"))
    counted = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    table = f"{checkpoint_dir(spark).rstrip('/')}/transcript-blocks-{uuid.uuid4().hex}"
    counted.withColumn("before", before).write.parquet(table)
    blocks = with_bound(spark.read.parquet(table))
    place = F.col("at") - F.col("first")
    number = F.when(place.between(0, F.col("n") - 1), F.col("before") + place).otherwise(F.raise_error(F.lit("a file has changed since its lines were counted")).cast("bigint"))
    return rows.join(blocks, ["path", "block"]).select("path", (session or session_of)(F.col("path")).alias("session_id"), number.alias("line_no"),
                                                       F.make_valid_utf8("value").alias("line"))


def transcript_scope(spark: SparkSession, path: str, pattern: str, as_of: str | None = None, max_age_days: int | None = None,
                     max_files: int | None = None, max_bytes: int | None = None, session: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, session_id, text) of the chosen files, for transcripts that are one JSON value; whole unless ``max_bytes`` is given.

    `transcript_lines` reads line-by-line transcripts of any size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = _chosen(files, as_of, max_age_days, max_files, pattern, path)
    content = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    name = F.col("_metadata.file_path")
    return rows.select(name.alias("path"), (session or session_of)(name).alias("session_id"), F.make_valid_utf8(content.cast("string")).alias("text"))


def session_of(path: Column) -> Column:
    """File name without its extension."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*\z"), F.regexp_extract(name, r"^(.+)\.[^.]*\z", 1)).otherwise(name)


def instant(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def _int(c: Column, default: Column) -> Column:
    return F.coalesce(c.try_cast("int"), default)


def read_transcripts_jsonl(files: DataFrame, proxy: str = PROXY_PREFIX, marker: str = REDUCED_MARKER) -> DataFrame:
    """Events of one-object-per-line transcripts: flat commands plus paired tool calls.

    ``files``: (session_id, line_no, line) as `transcript_lines` gives them, or (session_id, text). Lines that are no
    JSON fall out; the line number orders a session.
    """
    lines = files.select("session_id", "line_no", "line") if "line" in files.columns else files.select(
        "session_id", F.posexplode(lines_of(nn(F.col("text")))).alias("line_no", "line"))
    j = F.from_json(trim_ctl(F.col("line")), _LINE)

    def parsed(rows: DataFrame) -> DataFrame:
        rows = rows.select("session_id", (F.col("line_no").cast("bigint") * _ITEM_SPACE).alias("seq"), (F.col("line_no") + 1).alias("n"), j.alias("j"))
        return settled(rows, "j").where("j IS NOT NULL").withColumn("ts", instant(F.col("j.timestamp")))

    def naming(word: str) -> DataFrame:
        """Lines that may hold the string: as it stands between quotes, or with an escape in it."""
        line = F.col("line")
        return parsed(lines.where(line.contains(f'"{word}"') | line.contains(f"'{word}'") | line.contains("\\")))

    flat = ~is_blank(nn(F.col("j.command")))
    out = nn(F.col("j.output"))
    flat_events = naming("command").where(flat).select(
        "session_id", "seq", F.concat(F.lit("evt-"), F.col("n")).alias("event_id"), "ts", redact(F.col("j.command")).alias("command"),
        _int(F.coalesce("j.exitCode", "j.exit_code"), F.lit(0)).alias("exit_code"),
        F.coalesce(F.col("j.durationMillis").try_cast("bigint"), F.lit(0).cast("bigint")).alias("duration_ms"),
        F.coalesce(F.col("j.outputBytes").try_cast("bigint"), F.length(out).cast("bigint")).alias("output_bytes"),
        redact(out).alias("output"), F.coalesce(F.col("j.filtered").try_cast("boolean"), F.lit(False)).alias("filtered"))
    top = F.struct("j.type", "j.id", "j.name", "j.input", "j.tool_use_id", "j.is_error", "j.exit_code", "j.content").cast(_TOOL)
    items = F.when(F.col("j.type").isin("tool_use", "tool_result"), F.array(top)).otherwise(
        F.coalesce("j.message.content", F.array().cast(f"array<{_TOOL}>")))

    def tools(kind: str) -> DataFrame:
        return naming(kind).where(~flat).select("session_id", "seq", "ts", F.posexplode(items).alias("k", "t")).where(F.col("t.type") == kind).select(
            "session_id", (F.col("seq") + F.col("k")).alias("seq"), "ts", "t")
    calls = tools("tool_use").select("session_id", F.col("t.id").alias("call_id"), "seq", "ts", F.col("t.name").alias("tool"),
                                     F.col("t.input.command").alias("command"))
    results = tools("tool_result").select(
        "session_id", F.col("t.tool_use_id").alias("call_id"), "seq", "ts", nn(F.col("t.content")).alias("content"),
        F.col("t.exit_code").try_cast("int").alias("exit_code"), F.col("t.is_error").try_cast("boolean").alias("is_error"))
    return flat_events.select(*EVENT_COLUMNS).unionByName(pair_tool_calls(calls, results, proxy, marker).select(*EVENT_COLUMNS))


def _item_events(files: DataFrame, lists: Column, label: str, session: Column, ids: list[str], proxy: str) -> DataFrame:
    """Events of a whole-file transcript; a file that is no single JSON value is read line by line."""
    text = trim_ctl(nn(F.col("text")))
    by_line = F.filter(F.transform(lines_of(text), lambda x: F.from_json(trim_ctl(x), _ITEM)), lambda x: x.isNotNull())
    obj = F.when(text.startswith("{"), F.from_json(text, _OBJECT))
    many = F.size(F.filter(lines_of(text), lambda x: x.startswith("{"))) > 1
    valid = F.try_parse_json(text).isNotNull() & ~many
    df = files.withColumn("_o", obj)
    items = F.when(valid & text.startswith("["), F.from_json(text, f"array<{_ITEM}>")).when(valid, F.coalesce(lists, F.array().cast(f"array<{_ITEM}>"))).otherwise(by_line)
    rows = df.select(session.alias("session_id"), F.coalesce("_o.directory", "_o.workspace").alias("workspace"), F.posexplode(items).alias("seq", "i"))
    command = F.coalesce("i.command", "i.cmd", "i.terminalCommand")
    rows = rows.where(~is_blank(nn(command)))
    out = nn(F.coalesce("i.output", "i.result"))
    clean = redact(command)
    return rows.select(
        "session_id", F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(*[F.col(f"i.{x}") for x in ids], F.concat(F.lit(label), F.col("seq") + 1)).alias("event_id"),
        instant(F.col("i.timestamp")).alias("ts"), clean.alias("command"), _int(F.coalesce("i.exitCode", "i.exit_code"), F.lit(0)).alias("exit_code"),
        F.coalesce(F.col("i.durationMillis").try_cast("bigint"), F.lit(0).cast("bigint")).alias("duration_ms"),
        F.coalesce(F.col("i.outputBytes").try_cast("bigint"), F.length(out).cast("bigint")).alias("output_bytes"), redact(out).alias("output"),
        (F.coalesce(F.col("i.filtered").try_cast("boolean"), F.lit(False)) | clean.startswith(proxy)).alias("filtered"), "workspace")


def read_transcripts_json(files: DataFrame, proxy: str = PROXY_PREFIX) -> DataFrame:
    """Command-list transcripts: an object with ``commands`` or a plain array."""
    return _item_events(files, F.col("_o.commands"), "evt-", F.coalesce("_o.sessionId", "session_id"), ["id"], proxy)


def read_transcripts_steps(files: DataFrame, proxy: str = PROXY_PREFIX) -> DataFrame:
    """Step-list transcripts: an object with ``steps`` (or ``commands``) or a plain array."""
    return _item_events(files, F.coalesce("_o.steps", "_o.commands"), "step-", F.coalesce("_o.cascadeId", "_o.sessionId", "session_id"),
                        ["stepId"], proxy)
