"""Report files of tools: failure reports, XML test results, format findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsift.functions.text import is_blank, let, nn, strip_ws, trim_ctl
from runsift.operators.extract import json_depth
from runsift.operators.plan_shape import settled

# Fixed value: nesting of a format report.
FORMAT_DEPTH = 8


@dataclass(frozen=True)
class Limits:
    """Optional reading limits of report files; None reads everything."""

    files: int | None = None
    file_bytes: int | None = None
    results: int | None = None
    failures: int | None = None
    stack: int | None = None
    format_chars: int | None = None
    format_findings: int | None = None


EVERYTHING = Limits()

_REPORT = ("schema_version int, report_id string, timestamp string, version string, os_family string, os_arch string, failure_stage string, "
           "error_category string, exit_code int, duration_bucket string, output_length_bucket string, _corrupt string")


# --- A8 -----------------------------------------------------------------------------

def read_failure_reports(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """The report of each JSON file, or each one of its list, with a ``valid`` flag: unreadable files and reports
    without a category are counted, not lost."""
    df = spark.read.schema(_REPORT).option("multiLine", "true").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(path)
    return df.withColumn("valid", F.col("_corrupt").isNull() & F.col("error_category").isNotNull()).drop("_corrupt")


def report_totals(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count_if("valid").alias("reports"), F.count_if(~F.col("valid")).alias("unparseable"))


# --- A9 -----------------------------------------------------------------------------

_SUMMARY = "ResultSummary:struct<Counters:struct<_total:int,_passed:int,_failed:int,_error:int,_notExecuted:int,_inconclusive:int>>"
_RESULTS = ("Results:struct<UnitTestResult:array<struct<_testName:string,_outcome:string,_duration:string,"
            "Output:struct<ErrorInfo:struct<Message:string,StackTrace:string>>>>>")
_TRX = f"struct<{_SUMMARY},{_RESULTS}>"


def _prolog(text: Column) -> Column:
    """All before the root element, in lower case, without comments and processing instructions."""
    def before_root(bare: Column) -> Column:
        return let(F.regexp_instr(bare, F.lit("<[^!?]")), lambda at: F.lower(F.when(at > 0, F.left(bare, at - 1)).otherwise(bare)))
    return let(F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>", ""), before_root)


def _refused(text: Column) -> Column:
    """Whether the prolog declares a document type or an entity. A text that begins with an element has no prolog to take apart."""
    def declared(head: Column) -> Column:
        return head.contains("<!doctype") | head.contains("<!entity")
    return F.when(text.rlike("^[^<]*<[^!?<]"), False).when(text.isNotNull(), let(_prolog(text), declared))


def parse_trx(files: DataFrame, limits: Limits = EVERYTHING, parts: str = _TRX) -> DataFrame:
    """Parsed XML reports per run: ``files`` is (run_id, file_no, text). The parser passes over what is not in ``parts``.

    Files with a document type or entity are refused before the parser sees them.
    """
    df = files
    if limits.files is not None:
        df = df.withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy("file_no"))).where(F.col("_n") <= limits.files)
    if limits.file_bytes is not None:
        df = df.where(F.octet_length(nn(F.col("text"))) <= limits.file_bytes)
    df = settled(df.select("run_id", "file_no", "text", _refused(F.col("text")).alias("refused")), "text", "refused")
    # the namespace prefix of a default namespace does not reach the element names
    return settled(df.select("run_id", "file_no", "refused", F.when(~F.col("refused"), F.from_xml("text", parts, {"mode": "PERMISSIVE"})).alias("x")), "x")


def _milliseconds(duration: Column) -> Column:
    p = F.split(duration, ":")
    whole = (F.get(p, F.lit(0)).try_cast("int") * 60 + F.get(p, F.lit(1)).try_cast("int")) * 60
    return F.when(F.size(p) == 3, F.floor((whole + F.get(p, F.lit(2)).try_cast("double")) * 1000 + 0.5).cast("int"))


def read_test_report_xml(files: DataFrame, limits: Limits = EVERYTHING) -> DataFrame:
    """Failed results: (run_id, seq, name, status, detail, duration_ms, stack)."""
    every = F.col("x.Results.UnitTestResult")
    results = parse_trx(files, limits, f"struct<{_RESULTS}>").where("x IS NOT NULL").select("run_id", "file_no", F.posexplode(
        every if limits.results is None else F.slice(every, 1, limits.results)).alias("pos", "r"))
    status = F.lower(nn(F.col("r._outcome")))
    bad = results.where(status.isin("failed", "error"))
    ranked = bad.withColumn("_k", F.row_number().over(W.partitionBy("run_id").orderBy("file_no", "pos")))
    if limits.failures is not None:
        ranked = ranked.where(F.col("_k") <= limits.failures)
    return ranked.select("run_id", (F.col("_k") - 1).alias("seq"), *_case(F.col("r"), status, limits.stack))


def _case(r: Column, status: Column, chars: int | None = None) -> list[Column]:
    """name, status, detail, duration_ms and stack of a parsed result."""
    name = F.when(is_blank(nn(r["_testName"])), "unknown").otherwise(r["_testName"])
    message = strip_ws(nn(r["Output"]["ErrorInfo"]["Message"]))
    detail = F.concat(F.lit("Failed "), F.substring_index(name, ".", -1), F.when(message == "", "").otherwise(F.concat(F.lit(" "), message)))
    stack = nn(r["Output"]["ErrorInfo"]["StackTrace"])
    return [name.alias("name"), status.alias("status"), detail.alias("detail"), _milliseconds(r["_duration"]).alias("duration_ms"),
            F.nullif(stack if chars is None else F.substring(stack, 1, chars), F.lit("")).alias("stack")]


def test_report_counters(files: DataFrame, limits: Limits = EVERYTHING) -> DataFrame:
    """Counters per run, summed over its files."""
    c = "x.ResultSummary.Counters"
    z = lambda f: F.coalesce(F.sum(F.col(f"{c}.{f}")), F.lit(0)).cast("int")
    out = parse_trx(files, limits, f"struct<{_SUMMARY}>").groupBy("run_id").agg(
        z("_passed").alias("passed"), z("_failed").alias("failed"), z("_error").alias("errors"),
        (z("_notExecuted") + z("_inconclusive")).alias("skipped"), z("_total").alias("total"), F.count_if("refused").alias("refused"))
    return _totals(out)


def _totals(counters: DataFrame) -> DataFrame:
    every = F.col("passed") + F.col("failed") + F.col("errors") + F.col("skipped")
    return counters.withColumn("total", F.when(F.col("total") > 0, F.col("total")).otherwise(every))


# --- A9 from files ---

_RESULT = "struct<_testName:string,_outcome:string,_duration:string,Output:struct<ErrorInfo:struct<Message:string,StackTrace:string>>>"
_COUNTERS = "struct<_total:string,_passed:string,_failed:string,_error:string,_notExecuted:string,_inconclusive:string>"
_ATTRIBUTES = r"""(?:\s+[^\s=/>]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""
_END = "</UnitTestResult>"


def folder_of(path: Column) -> Column:
    """Name of the folder a file is in."""
    return F.element_at(F.split(path, "/"), -2)


def report_pieces(spark: SparkSession, path: str, pattern: str = "*.trx", run: Callable[[Column], Column] = folder_of) -> DataFrame:
    """(run_id, path, block, at, piece): report files cut behind each result, so that a report of any size is read by many tasks.

    The end tag of a result is the line separator of the scan; a file's pieces are ordered by block and position. Files whose
    prolog declares a document type or entity give one row with a null piece: what stands before the root element is in a file's first piece.
    """
    rows = spark.read.option("lineSep", _END).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    firsts = rows.where("block = 0").groupBy("path").agg(F.min("at").alias("at"), F.min_by(_refused(F.col("piece")), "at").alias("no"))
    refused = firsts.where("no").select("path", F.lit(0).cast("bigint").alias("block"), "at", F.lit(None).cast("string").alias("piece"))
    kept = rows.join(refused.select("path"), "path", "left_anti")
    return kept.unionByName(refused).select(run(F.col("path")).alias("run_id"), "path", "block", "at", "piece")


def _tags(piece: Column, name: str) -> Column:
    """Start tags of an element in a piece, outside comments and character data."""
    return F.filter(F.regexp_extract_all(piece, F.lit(rf"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<{name}{_ATTRIBUTES}/?>"), F.lit(0)), lambda x: x.startswith(f"<{name}"))


def read_report_results(pieces: DataFrame) -> DataFrame:
    """Failed results of report files: (run_id, seq, name, status, detail, duration_ms, stack), as `read_test_report_xml` has them.

    A piece ends a result: the last start tag in it that is not closed at once. Those closed at once are results too.
    """
    def elements(p: Column, tags: Column) -> Column:
        closed = F.filter(tags, lambda t: t.endswith("/>"))
        last = F.try_element_at(F.filter(tags, lambda t: ~t.endswith("/>")), F.lit(-1))
        rest = F.call_function("substring_index", p, last, F.lit(-1))  # what follows the tag
        opened = F.filter(F.array(F.struct(F.concat(last, rest, F.lit(_END)).alias("x"), F.concat(last, F.lit(_END)).alias("tag"))), lambda e: e["tag"].isNotNull())
        return F.concat(F.transform(closed, lambda t: F.struct(t.alias("x"), t.alias("tag"))), opened)
    found = pieces.select("run_id", "path", "block", "at", F.posexplode(let(_tags(F.col("piece"), "UnitTestResult"), lambda t: elements(F.col("piece"), t))).alias("sub", "e"))
    # a start tag with neither word nor an entity cannot name a failed result, so passed ones are not parsed
    found = found.where(F.col("e.tag").rlike("(?i)failed|error|&"))
    parsed = found.withColumn("r", F.from_xml("e.x", _RESULT, {"mode": "PERMISSIVE"}))
    r = settled(parsed, "r").withColumn("r", F.when(F.col("r._outcome").isNotNull(), F.col("r")).otherwise(F.from_xml("e.tag", _RESULT, {"mode": "PERMISSIVE"})))  # broken off behind its tag
    r = settled(r, "r")
    status = F.lower(nn(F.col("r._outcome")))
    bad = r.where(status.isin("failed", "error") & ~is_blank(nn(F.col("r._testName"))))
    seq = F.row_number().over(W.partitionBy("run_id").orderBy("path", "block", "at", "sub")) - 1
    return bad.select("run_id", seq.alias("seq"), *_case(F.col("r"), status))


def report_file_counters(pieces: DataFrame) -> DataFrame:
    """Counters per run, summed over its files; ``refused`` counts the files that were not read."""
    own = pieces.select("run_id", F.col("piece").isNull().cast("int").alias("refused"), F.explode_outer(_tags(F.col("piece"), "Counters")).alias("x"))
    tag = F.when(F.col("x").endswith("/>"), F.col("x")).otherwise(F.concat(F.col("x"), F.lit("</Counters>")))
    own = own.withColumn("c", F.from_xml(tag, _COUNTERS, {"mode": "PERMISSIVE"}))
    z = lambda f: F.coalesce(F.sum(F.col(f"c.{f}").try_cast("int")), F.lit(0)).cast("int")
    return _totals(own.groupBy("run_id").agg(
        z("_passed").alias("passed"), z("_failed").alias("failed"), z("_error").alias("errors"),
        (z("_notExecuted") + z("_inconclusive")).alias("skipped"), z("_total").alias("total"), F.sum("refused").alias("refused")))


# --- A10 ----------------------------------------------------------------------------

_FORMAT = ("array<struct<FilePath:string,FileName:string,FileChanges:array<struct<LineNumber:int,DiagnosticId:string,"
           "FormatDescription:string>>>>")


def format_findings(text: Column, limits: Limits = EVERYTHING) -> Column:
    """struct(findings, capped) of a format report, NULL when the text is none."""
    t = trim_ctl(nn(text))
    fits = t.startswith("[")
    if limits.format_chars is not None:
        fits &= F.length(t) <= limits.format_chars
    docs = F.when(fits & (json_depth(t) <= FORMAT_DEPTH), F.from_json(t, _FORMAT))

    def of_doc(d: Column) -> Column:
        file = F.when(~is_blank(nn(d["FilePath"])), trim_ctl(d["FilePath"])).otherwise(trim_ctl(nn(d["FileName"])))
        named = F.filter(F.coalesce(d["FileChanges"], F.array()), lambda c: ~(is_blank(nn(c["FormatDescription"])) & is_blank(nn(c["DiagnosticId"]))))
        return F.transform(named, lambda c: F.struct(
            file.alias("file"), c["LineNumber"].alias("line"), trim_ctl(nn(c["DiagnosticId"])).alias("code"),
            F.when(is_blank(nn(c["DiagnosticId"])), trim_ctl(nn(c["FormatDescription"]))).otherwise(F.concat(
                trim_ctl(c["DiagnosticId"]), F.lit(": "), trim_ctl(nn(c["FormatDescription"])))).alias("message"),
            F.lit("warning").alias("severity")))
    every = F.flatten(F.transform(docs, of_doc))
    most = limits.format_findings
    return F.when(docs.isNotNull(), F.struct((every if most is None else F.slice(every, 1, most)).alias("findings"),
                                             (F.lit(False) if most is None else F.size(every) > most).alias("capped")))


def read_format_report(reports: DataFrame, limits: Limits = EVERYTHING) -> DataFrame:
    """(run_id, seq, file, line, code, message, severity) of format reports (run_id, text)."""
    ex = reports.select("run_id", F.posexplode(format_findings(F.col("text"), limits)["findings"]).alias("seq", "f"))
    return ex.select("run_id", "seq", "f.*")
