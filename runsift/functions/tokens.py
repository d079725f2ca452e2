"""Token estimate and savings percentage as plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runsift.functions.text import let

ESTIMATOR = "utf8_weighted_v1"

# Joiners, variation selectors and skin tones weigh nothing;
# dense scripts, emoji and full-width forms weigh one token per code point;
# every other run of characters weighs one token per four code points.
RUN_DIVISOR = 4
IGNORABLE = r"[\x{200D}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{1F3FB}-\x{1F3FF}]"
DENSE = (
    r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsBopomofo}"
    r"\x{3000}-\x{303F}\x{3200}-\x{33FF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}"
    r"\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}]"
)


# Every dense or ignorable code point lies in here; testing the range first keeps the
# script lookups away from the bulk of the text.
_RANGE = r"\x{02EA}\x{02EB}\x{1100}-\x{11FF}\x{200D}\x{2600}-\x{27BF}\x{2E80}-\x{10FFFF}"
_DENSE_RUN = f"[[{_RANGE}]&&{DENSE}]+"


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens of a text column.

    A text without dense or ignorable characters is one run: its length decides.
    Otherwise the text is split at dense stretches; the pieces are the other runs,
    and what the split swallowed is one token per code point.
    """
    zero = F.lit(0).cast("bigint")

    def quarter(n: Column) -> Column:
        return F.floor((n + F.lit(RUN_DIVISOR - 1)) / F.lit(RUN_DIVISOR)).cast("bigint")

    def weigh(clean: Column) -> Column:
        start = F.struct(zero.alias("t"), zero.alias("n"))
        totals = F.aggregate(F.split(clean, _DENSE_RUN), start, lambda acc, run: F.struct(
            (acc["t"] + quarter(F.char_length(run))).alias("t"), (acc["n"] + F.char_length(run)).alias("n")))
        return let(totals, lambda r: r["t"] + F.char_length(clean) - r["n"])

    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(f"[{_RANGE}]")
    return F.when(text.isNull() | (text == ""), zero).when(plain, quarter(F.char_length(text))).otherwise(
        let(F.regexp_replace(text, f"[[{_RANGE}]&&{IGNORABLE}]", ""), weigh))


def savings_pct(raw: Column, out: Column) -> Column:
    """Whole percent saved, truncated toward zero; 0 when nothing was read."""
    return F.when(raw == 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("try_divide", (raw - out) * 100, raw).cast("bigint")
    )


def ratio_1dp(raw: Column, out: Column) -> Column:
    """Compression ratio, 1.0 for no input and the raw size for no output."""
    value = F.when(out > 0, raw / out).when(raw > 0, raw.cast("double")).otherwise(F.lit(1.0))
    return F.round(value, 1)
