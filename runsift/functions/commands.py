"""Expressions over command strings: words, prefixes, compound splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runsift.functions.text import let, trim_ctl

# Words with a special role in a shell command. Repeated groups are
# possessive: they need no backtracking, and a long string costs no regex stack.
WRAPPERS = ["sudo", "env", "nohup", "time", "command", "builtin"]
DYNAMIC = ["eval", "exec", "source", "."]
OPERAND_OPTIONS = ["-u", "-C", "-g"]
QUOTED = r"""\\.|'[^']*+'|"(?:\\.|[^"\\])*+\""""
SEGMENT = r"""(?s)(?:\\.|'[^']*+'|"(?:\\.|[^"\\])*+"|[^'";&|\n\r\\])++"""
WORD = r"""(?s)[<>][<>&]*|(?:\\.|'[^']*+'|"(?:\\.|[^"\\])*+"|[^\s'"<>\\])++"""
ENV_ASSIGNMENT = r"^[a-zA-Z_][a-zA-Z0-9_]*=.*$"
REASON_HEREDOC = "here-document"
REASON_ESCAPE = "dangling escape"
REASON_SINGLE = "unclosed single quote"
REASON_DOUBLE = "unclosed double quote"
REASON_SUBSHELL = "command substitution"
REASON_DYNAMIC = "dynamic execution"
TWO_WORD_TOOLS = ["bundle", "npm", "pnpm", "yarn", "mvn", "gradle", "git", "cargo", "docker"]
RELATED_TOOLS = ["npm", "cargo", "mvn", "git", "docker"]


def normalized(command: Column) -> Column:
    """Lower case, single spaces, no outer blanks."""
    return F.lower(F.regexp_replace(trim_ctl(F.coalesce(command, F.lit(""))), r"\s+", " "))


def word_prefix(command: Column, n: int) -> Column:
    """First ``n`` words of a normalised command, NULL when it has fewer."""
    return F.when(F.size(F.split(command, " ")) >= n, F.substring_index(command, " ", n))


def gap_prefix(command: Column) -> Column:
    """First two words, or the only word."""
    return F.substring_index(F.regexp_replace(trim_ctl(command), r"\s+", " "), " ", 2)


def tool_prefix(command: Column) -> Column:
    """First word, or two words for tools whose second word names the task."""
    words = F.split(trim_ctl(command), r"\s+")
    two = F.lower(F.get(words, 0)).isin(TWO_WORD_TOOLS) & (F.size(words) > 1)
    prefix = F.when(two, F.concat_ws(" ", F.get(words, 0), F.get(words, 1))).otherwise(F.get(words, 0))
    return F.when(trim_ctl(F.coalesce(command, F.lit(""))) == "", F.lit("unknown")).otherwise(prefix)


def first_word(command: Column) -> Column:
    """Text before the first space of the trimmed command."""
    return F.substring_index(trim_ctl(command), " ", 1)


def related(a: Column, b: Column) -> Column:
    """Same first word, or both first words belong to one tool family."""
    wa, wb = first_word(a), first_word(b)
    out = F.lower(wa) == F.lower(wb)
    for tool in RELATED_TOOLS:
        out = out | (wa.contains(tool) & wb.contains(tool))
    return out


def _blank_quotes(command: Column) -> Column:
    return F.regexp_replace(command, "(?s)" + QUOTED, " ")


def split_error(command: Column) -> Column:
    """Why a command cannot be split safely, or NULL."""
    rest = _blank_quotes(command)
    here = F.instr(rest, "<<")
    quote = F.least(F.nullif(F.instr(rest, "'"), F.lit(0)), F.nullif(F.instr(rest, '"'), F.lit(0)))
    first_quote = F.substring(rest, quote, F.lit(1))
    return (
        F.when((here > 0) & (quote.isNull() | (here < quote)), F.lit(REASON_HEREDOC))
        .when(rest.endswith("\\") & (quote.isNull() | (first_quote == '"')), F.lit(REASON_ESCAPE))
        .when(first_quote == "'", F.lit(REASON_SINGLE))
        .when(first_quote == '"', F.lit(REASON_DOUBLE))
    )


def plain_spaces(command: Column) -> Column:
    """Every blank except line breaks as one plain space."""
    return F.regexp_replace(command, r"[\x09\x0B\x0C\x1C-\x1F\x{A0}\x{1680}\x{2000}-\x{200A}"
                                     r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]", " ")


def raw_segments(command: Column) -> Column:
    """Trimmed, non-empty pieces between unquoted separators."""
    pieces = F.regexp_extract_all(command, F.lit(SEGMENT), F.lit(0))
    return F.filter(F.transform(pieces, lambda s: trim_ctl(s)), lambda s: s != "")


def executable_name(word: Column) -> Column:
    """Unquoted base name in lower case without a Windows suffix."""
    def clean(w: Column) -> Column:
        quoted = w.rlike(r"""(?s)^(".*"|'.*')\z""") & (F.length(w) >= 2)
        inner = F.when(quoted, F.substring(w, F.lit(2), F.length(w) - 2)).otherwise(w)
        base = F.substring_index(F.replace(inner, F.lit("\\"), F.lit("/")), "/", -1)
        return F.regexp_replace(F.lower(trim_ctl(base)), r"\.(?:exe|cmd|bat)\z", "")
    return let(trim_ctl(word), clean)


def has_substitution(segment: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(segment, r"(?s)\\.", " "), r"(?s)'[^']*(?:'|\z)", " ")
    may = segment.contains("`") | segment.contains("$(")
    return may & (bare.contains("`") | bare.contains("$("))


def segment_head(segment: Column) -> Column:
    """struct(executable, reason) of one segment.

    Redirections, assignments and wrappers in front of the executable are
    skipped, which needs the word order: a fold over the segment's words.
    """
    words = F.regexp_extract_all(segment, F.lit(WORD), F.lit(0))
    null = F.lit(None).cast("string")

    def state(phase, skip, operand, exe, reason):
        return F.struct(phase.alias("phase"), skip.alias("skip"), operand.alias("operand"),
                        exe.alias("exe"), reason.alias("reason"))

    start = state(F.lit("lead"), F.lit(False), F.lit(False), null, null)

    def step(acc: Column, word: Column) -> Column:
        base = executable_name(word)
        redirect = word.rlike("^[<>]")
        standalone = word.isin("<", ">", ">>")
        plain = F.regexp_replace(F.regexp_replace(word, r"""^(["'])(.*)\1$""", "$2"), r"(?s)\\(.)", "$1")
        env = plain.rlike(ENV_ASSIGNMENT)
        option = word.startswith("-") & (acc["phase"] == "opt")
        keep = state(acc["phase"], F.lit(False), F.lit(False), acc["exe"], acc["reason"])
        return (
            F.when(acc["phase"] == "done", acc)
            .when(acc["skip"], keep)
            .when(acc["operand"] & ~word.startswith("-"), keep)
            .when(redirect, state(acc["phase"], standalone, F.lit(False), acc["exe"], acc["reason"]))
            .when(option, state(acc["phase"], F.lit(False), word.isin(OPERAND_OPTIONS), acc["exe"], acc["reason"]))
            .when(env, keep)
            .when(base.isin(DYNAMIC), state(F.lit("done"), F.lit(False), F.lit(False), base, F.lit(REASON_DYNAMIC)))
            .when(base.isin(WRAPPERS), state(F.lit("opt"), F.lit(False), F.lit(False), acc["exe"], acc["reason"]))
            .otherwise(state(F.lit("done"), F.lit(False), F.lit(False), base, acc["reason"]))
        )

    folded = F.aggregate(words, start, step, lambda a: F.struct(a["exe"].alias("executable"), a["reason"].alias("reason")))
    # Most segments open with a plain word that is neither wrapper nor dynamic command.
    first = F.regexp_extract(segment, r"^([A-Za-z0-9_./+-]+)(?=\s|\z)", 1)
    plain = let(executable_name(first), lambda base: F.when(
        (first != "") & ~base.isin(WRAPPERS + DYNAMIC), F.struct(base.alias("executable"), null.alias("reason"))))
    return F.when(has_substitution(segment), F.struct(null.alias("executable"), F.lit(REASON_SUBSHELL).alias("reason"))) \
        .otherwise(F.coalesce(plain, folded))
