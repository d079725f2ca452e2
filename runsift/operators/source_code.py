"""Source corpora: language detection, comment removal with line numbers, outlines.

A language's lexical rules become one pattern that cuts a text into strings,
comments and the rest. Cutting left to right is what protects a comment mark
inside a string, so no scanner runs outside the JVM; only texts with a block
comment nested in another one take the Arrow helper.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsift.functions.text import is_blank, join_lines, let, lines_of, nn
from runsift.functions.tokens import estimate_tokens
from runsift.operators.reduce import json_structure

_DQ, _SQ, _BQ = '"', "'", "`"
_C = {"line": "//", "block": ("/*", "*/")}
_HASH = {"line": "#"}
_BOTH = [(_DQ, "\\"), (_SQ, "\\")]
_TS_TYPE = r"^\s*(export\s+)?(type|interface|enum|class)\b"
_JS_FUNCTION = r"^\s*(export\s+)?(async\s+)?function\b"

# File names, comment marks, string delimiters with their escapes,
# raw-string style and outline patterns per language.
LANGUAGES: dict[str, dict] = {
    "c": {"ext": [".c", ".h"], **_C, "strings": _BOTH,
          "outline": [r"^\s*\w.+\(.*\)\s*\{?\s*$", r"^\s*(typedef\s+)?(struct|enum|union)\b"]},
    "cpp": {"ext": [".cpp", ".cc", ".cxx", ".hpp", ".hh"], **_C, "strings": _BOTH, "raw": "cpp",
            "outline": [r"^\s*(template\b|[\w:<>,\s*&]+)\(.*\)\s*(const)?\s*\{?\s*$",
                        r"^\s*(template\b|class|struct|enum|namespace)\b"]},
    "csharp": {"ext": [".cs"], **_C, "strings": _BOTH,
               "outline": [r"^\s*(public|private|protected|internal|static|sealed|abstract|\s)*"
                           r"(class|interface|enum|record|struct)\b",
                           r"^\s*(public|private|protected|internal|static|\s)*.+\(.*\)\s*\{?\s*$"]},
    "css": {"ext": [".css"], "block": ("/*", "*/"), "strings": _BOTH, "outline": [r"^\s*[^@\s].*\{\s*$", r"^\s*@"]},
    "go": {"ext": [".go"], **_C, "strings": _BOTH, "raw": "go_raw",
           "outline": [r"^\s*func\b", r"^\s*type\b", r"^\s*(package|import)\b"]},
    "html": {"ext": [".html", ".htm"], "block": ("<!--", "-->"), "strings": [],
             "outline": [r"^\s*</?(html|head|body|main|section|article|h[1-6]|script|style)\b"]},
    "java": {"ext": [".java"], **_C, "strings": _BOTH, "raw": "java_text",
             "outline": [r"^\s*(public|protected|private|static|final|abstract|sealed|\s)*"
                         r"(class|interface|enum|record)\b",
                         r"^\s*(public|protected|private|static|final|synchronized|native|default|\s)*"
                         r".+\(.*\)\s*(\{|throws|;|$)"]},
    "javascript": {"ext": [".js", ".mjs", ".cjs"], **_C, "strings": _BOTH, "raw": "js_template",
                   "outline": [_JS_FUNCTION, r"^\s*(export\s+)?class\b", r"^\s*export\b"]},
    "json": {"ext": [".json"], "data": True},
    "jsx": {"ext": [".jsx"], **_C, "strings": _BOTH, "raw": "js_template", "outline": [_JS_FUNCTION, r"^\s*export\b"]},
    "kotlin": {"ext": [".kt", ".kts"], **_C, "strings": [(_DQ, "\\")], "raw": "java_text", "nested": True,
               "outline": [r"^\s*(public|private|internal|protected|abstract|data|sealed|\s)*"
                           r"(class|interface|object|enum class|fun)\b",
                           r"^\s*(public|private|internal|protected|override|suspend|\s)*fun\b"]},
    "markdown": {"ext": [".md"], "block": ("<!--", "-->"), "strings": [], "outline": []},
    "powershell": {"ext": [".ps1"], "line": "#", "block": ("<#", "#>"), "strings": [(_DQ, _BQ), (_SQ, "\\")],
                   "outline": [r"^\s*function\b"]},
    "properties": {"ext": [".properties"], **_HASH, "strings": [(_DQ, "\\")], "outline": [r"^\s*[^#!\s].*="]},
    "python": {"ext": [".py", ".pyw"], **_HASH, "strings": _BOTH, "raw": "python",
               "outline": [r"^\s*(async\s+)?def\b", r"^\s*class\b"]},
    "ruby": {"ext": [".rb"], **_HASH, "strings": _BOTH, "outline": [r"^\s*(def|class|module)\b"]},
    "rust": {"ext": [".rs"], **_C, "strings": [(_DQ, "\\")], "raw": "rust", "nested": True,
             "outline": [r"^\s*(pub(\([^)]*\))?\s+)?(async\s+)?(unsafe\s+)?(const\s+)?fn\b",
                         r"^\s*(pub(\([^)]*\))?\s+)?(struct|enum|trait|impl|type|mod)\b"]},
    "shell": {"ext": [".sh", ".bash", ".zsh"], "names": ["Makefile", "Dockerfile"], **_HASH, "strings": _BOTH,
              "outline": [r"^\s*(function\s+)?[\w-]+\s*\(\s*\)"]},
    "sql": {"ext": [".sql"], "line": "--", "block": ("/*", "*/"), "strings": [(_SQ, _SQ), (_DQ, "\\")],
            "outline": [r"^\s*(CREATE|ALTER|DROP|SELECT|INSERT|UPDATE|DELETE|WITH)\b"]},
    "toml": {"ext": [".toml"], **_HASH, "strings": _BOTH, "outline": [r"^\s*\["]},
    "tsx": {"ext": [".tsx"], **_C, "strings": _BOTH, "raw": "js_template",
            "outline": [_JS_FUNCTION, r"^\s*(export\s+)?(type|interface|class)\b"]},
    "typescript": {"ext": [".ts", ".mts", ".cts"], **_C, "strings": _BOTH, "raw": "js_template",
                   "outline": [_JS_FUNCTION, _TS_TYPE]},
    "xml": {"ext": [".xml"], "block": ("<!--", "-->"), "strings": [], "outline": [r"^\s*<[^!?/]"]},
    "yaml": {"ext": [".yml", ".yaml"], **_HASH, "strings": _BOTH, "outline": [r"^\s*[\w.-]+\s*:"]},
}
UNKNOWN = "unknown"
EMPTY_NOTICE = "(only comments)"


# --- I1 -------------------------------------------------------------------------------

def detect_language(path: Column) -> Column:
    """Language by file name, then by extension, in either case; NULL when neither is known.

    The table is fixed and small, so it is a literal map: no join.
    """
    name = F.substring_index(F.replace(nn(path), F.lit("\\"), F.lit("/")), "/", -1)
    by_name = [F.lit(x) for lang, d in LANGUAGES.items() for n in d.get("names", []) for x in (n.lower(), lang)]
    by_ext = [F.lit(x) for lang, d in LANGUAGES.items() for e in d["ext"] for x in (e, lang)]
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)\z", 1))
    return F.coalesce(F.try_element_at(F.create_map(*by_name), F.lower(name)), F.try_element_at(F.create_map(*by_ext), ext))


# --- I2 -------------------------------------------------------------------------------

def _string(delim: str, escape: str) -> str:
    """A string that may run to the end of the text."""
    d = re.escape(delim)
    if escape == delim:
        return f"{d}[^{d}]*+(?:{d}{d}[^{d}]*+)*+(?:{d}|\\z)"
    e = re.escape(escape)
    return f"{d}[^{d}{e}]*+(?:{e}.?[^{d}{e}]*+)*+(?:{d}|\\z)"


def _raw_strings(style: str | None) -> list[str]:
    triple = r'"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\z)'
    if style == "rust":
        return [r'[bcBC]?[rR](#*+)".*?(?:"\1|\z)']
    if style == "cpp":
        return [r'(?:u8|[LuU])?R"([^(\n]{0,16})\(.*?(?:\)\1"|\z)']
    if style == "python":
        plain = [triple, r"'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\z)"]
        marked = r'[rRfFbBuU]{1,3}+(?:""".*?(?:"""|\z)|' + r"'''.*?(?:'''|\z)" + r'|"[^"]*+(?:"|\z)|' + r"'[^']*+(?:'|\z))"
        return [marked, *plain]
    if style == "java_text":
        return [triple]
    if style in ("js_template", "go_raw"):
        return [_string("`", "\\") if style == "js_template" else r"`[^`]*+(?:`|\z)"]
    return []


def _comments(d: dict) -> list[str]:
    out = []
    if "block" in d:
        start, end = map(re.escape, d["block"])
        out.append(f"{start}.*?(?:{end}|\\z)")
    if "line" in d:
        out.append(re.escape(d["line"]) + r"[^\n]*+")
    return out


def token_pattern(lang: str) -> str:
    """Strings, comments, and runs of characters that start neither."""
    d = LANGUAGES[lang]
    openers = {s[0][0] for s in d["strings"]}
    openers |= {d["line"][0]} if "line" in d else set()
    openers |= {d["block"][0][0]} if "block" in d else set()
    raw = d.get("raw")
    openers |= set({"rust": "bcBCrR", "cpp": "uLUR", "python": "rRfFbBuU\"'", "java_text": '"',
                    "js_template": "`", "go_raw": "`"}.get(raw, ""))
    safe = "".join(re.escape(c) for c in sorted(openers))
    strings = [_string(s, e) for s, e in sorted(d["strings"], key=lambda x: -len(x[0]))]
    return "(?s)" + "|".join([*_raw_strings(raw), *strings, *_comments(d), f"[^{safe}]++", "."])


def _starts_comment(token: Column, d: dict) -> Column:
    marks = [m for m in ([d["block"][0]] if "block" in d else []) + ([d["line"]] if "line" in d else [])]
    out = F.lit(False)
    for m in marks:
        out = out | token.startswith(m)
    return out


def _strip(text: Column, lang: str) -> Column:
    """Text without comments; a comment leaves its line breaks, so lines keep their numbers."""
    d = LANGUAGES[lang]
    tokens = F.regexp_extract_all(text, F.lit(token_pattern(lang)), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(
        _starts_comment(t, d), F.regexp_replace(t, r"[^\n]+", "")).otherwise(t)), "")


@F.pandas_udf(T.StringType())
def _strip_nested(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """Block comments inside block comments need a depth count.

    ``patterns`` holds each text's string pattern; marks are the C family's.
    """
    cache: dict = {}

    def strip(text, strings):
        rx = cache.setdefault(strings, re.compile(f"(?s)(?P<s>{strings})|(?P<l>//[^\\n]*)|(?P<o>/\\*)"))
        out, at = [], 0
        while (m := rx.search(text, at)) is not None:
            out.append(text[at:m.start()])
            at = m.end()
            if m.lastgroup == "s":
                out.append(m.group())
            elif m.lastgroup == "o":
                depth, start = 1, at
                for mark in re.finditer(r"/\*|\*/", text[at:]):
                    depth += 1 if mark.group() == "/*" else -1
                    if depth == 0:
                        at = start + mark.end()
                        break
                else:
                    at = len(text)
                out.append("\n" * text.count("\n", start, at))
        out.append(text[at:])
        return "".join(out)
    return pd.Series([None if t is None else strip(t, p) for t, p in zip(texts, patterns, strict=True)])


def _python_strings(lang: str) -> str:
    """The string part of a language's pattern in the helper's dialect."""
    d = LANGUAGES[lang]
    pattern = "|".join([*_raw_strings(d.get("raw")), *[_string(s, e) for s, e in d["strings"]]])
    # the helper's own group comes first, so a raw string's hash group is number two
    return pattern.replace("\\z", "\\Z").replace("\\1", "(?P=h)").replace("(#*+)", "(?P<h>#*+)")


def with_stripped(files: DataFrame) -> DataFrame:
    """Add language and ``stripped``; unknown and data languages keep their text."""
    df = files.withColumn("language", detect_language(F.col("path")))
    text, lang = nn(F.col("text")), F.col("language")
    body = F.replace(text, F.lit("\r"), F.lit(""))
    nested = [k for k, d in LANGUAGES.items() if d.get("nested")]
    deep = lang.isin(nested) & body.rlike(r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+/\*")
    strings = None
    for k in nested:
        strings = F.when(lang == k, _python_strings(k)) if strings is None else strings.when(lang == k, _python_strings(k))
    df = df.withColumn("_deep", _strip_nested(F.when(deep, body), strings))
    out = None
    for k, d in LANGUAGES.items():
        if d.get("data"):
            continue
        out = F.when(lang == k, _strip(body, k)) if out is None else out.when(lang == k, _strip(body, k))
    return df.withColumn("stripped", F.coalesce("_deep", out.otherwise(text))).drop("_deep")


def _numbered(text: Column) -> Column:
    """array<struct(line_no, line)> of the lines that still hold something."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))),
                    lambda r: ~is_blank(r["line"]))


def strip_comments(files: DataFrame) -> DataFrame:
    """(path, language, line_no, line) without comments and blank lines, original numbers kept."""
    rows = with_stripped(files).select("path", "language", F.explode(_numbered(F.col("stripped"))).alias("r"))
    return rows.select("path", F.coalesce("language", F.lit(UNKNOWN)).alias("language"), "r.line_no", "r.line")


# --- I3 -------------------------------------------------------------------------------

def matches_outline(lang: Column, line: Column) -> Column:
    out = None
    for k, d in LANGUAGES.items():
        hit = F.lit(False)
        for p in d.get("outline", []):
            hit = hit | line.rlike(p)
        out = F.when(lang == k, hit) if out is None else out.when(lang == k, hit)
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def outline(files: DataFrame) -> DataFrame:
    """Outline lines per file, all kept lines when a file has none; ``level`` says which."""
    df = with_stripped(files).withColumn("_all", _numbered(F.col("stripped")))
    df = df.withColumn("_out", F.filter("_all", lambda r: matches_outline(F.col("language"), r["line"])))
    has = F.size("_out") > 0
    rows = df.select("path", F.coalesce("language", F.lit(UNKNOWN)).alias("language"), F.when(has, "outline").otherwise("comments").alias("level"),
                     F.explode(F.when(has, F.col("_out")).otherwise(F.col("_all"))).alias("r"))
    return rows.select("path", "language", "level", "r.line_no", "r.line")


def rendered(lines: Column) -> Column:
    """Numbered listing of (line_no, line) structs."""
    width = F.length(F.array_max(F.transform(lines, lambda r: r["line_no"])).cast("string"))
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(join_lines(F.transform(lines, lambda r: F.concat(
        F.lpad(r["line_no"].cast("string"), width, " "), F.lit("| "), r["line"]))), F.lit("\n")))


def render_file(files: DataFrame, level: str = "comments") -> DataFrame:
    """(path, language, body): the listing a reader gets at ``comments`` or ``outline`` level."""
    df = with_stripped(files).withColumn("_all", _numbered(F.col("stripped")))
    text, known = nn(F.col("text")), F.col("language").isNotNull()
    data = F.col("language").isin([k for k, d in LANGUAGES.items() if d.get("data")])
    shown = F.col("_all")
    if level == "outline":
        picked = F.filter("_all", lambda r: matches_outline(F.col("language"), r["line"]))
        shown = F.when(F.size(picked) > 0, picked).otherwise(F.col("_all"))
    body = F.when(~known, text)
    body = body.when(data, json_structure(text, data) if level == "outline" else text)
    body = body.when((F.size("_all") == 0) & ~is_blank(text), F.lit(EMPTY_NOTICE)).otherwise(let(shown, rendered))
    return df.select("path", F.coalesce("language", F.lit(UNKNOWN)).alias("language"), body.alias("body"))


# --- I4 -------------------------------------------------------------------------------

def corpus_savings(files: DataFrame) -> DataFrame:
    """Files, lines, bytes and tokens before and after, per language."""
    df = with_stripped(files)
    kept = join_lines(F.transform(_numbered(F.col("stripped")), lambda r: r["line"]))
    per = df.select(F.coalesce("language", F.lit(UNKNOWN)).alias("language"), F.size(lines_of(nn(F.col("text")))).alias("li"),
                    F.octet_length(nn(F.col("text"))).alias("b"), estimate_tokens(nn(F.col("text"))).alias("rt"), kept.alias("kept"))
    return per.groupBy("language").agg(
        F.count("*").alias("files"), F.sum("li").alias("lines_in"), F.sum(F.size(lines_of(F.col("kept")))).alias("lines_out"),
        F.sum("b").alias("bytes"), F.sum("rt").alias("raw_tokens"), F.sum(estimate_tokens(F.col("kept"))).alias("out_tokens"))
