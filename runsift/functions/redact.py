"""Secret redaction, applied before anything is counted or shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runsift.functions.text import let

# Labels that replace a secret, and our own patterns for them.
REDACTIONS = [
    (r"([a-zA-Z][a-zA-Z0-9+.\-]*://[^\s/:@]+):[^\s/@]+@", "$1:[REDACTED_SECRET]@"),
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=\-]{8,}", "$1 [REDACTED_BEARER_TOKEN]"),
    (r"\bAIza[0-9A-Za-z_\-]{20,}", "[REDACTED_GOOGLE_KEY]"),
    (r"\bsk-[A-Za-z0-9_\-]{8,}", "[REDACTED_SECRET]"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED_SECRET]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}", "[REDACTED_SECRET]"),
    (r"(?i)(--(?:token|password|passwd|secret|api-key|apikey|access-key)[= ])(?:\"[^\"]*\"|'[^']*'|[^\s\"']+)",
     "$1[REDACTED_SECRET]"),
    (r"(?i)\b((?:api_?key|secret|token|passwd|password)\s*[=:]\s*)(?:\"[^\"]*\"|'[^']*'|[^\s\"',;\[]+)",
     "$1[REDACTED_SECRET]"),
]


# Lower-case words of which a text must hold one before a pattern can match.
_HINTS = [["://"], ["bearer"], ["aiza"], ["sk-"], ["akia", "asia"], ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ["--"],
          ["key", "secret", "token", "passw"]]
SHORT = 256


def redact(text: Column) -> Column:
    """Replace secrets by labels. A plain search for a pattern's hint decides whether
    the pattern runs, which spares most texts most of the patterns."""
    def chain(p: Column) -> Column:
        out = p["t"]
        for (pattern, label), hints in zip(REDACTIONS, _HINTS, strict=True):
            possible = F.lit(False)
            for h in hints:
                possible = possible | p["low"].contains(h)
            out = _step(out, possible, pattern, label)
        return out
    direct = text
    for pattern, label in REDACTIONS:
        direct = F.regexp_replace(direct, pattern, label)
    return F.when(F.char_length(text) <= SHORT, direct).otherwise(
        let(F.struct(text.alias("t"), F.lower(text).alias("low")), chain))


def _step(text: Column, possible: Column, pattern: str, label: str) -> Column:
    return let(text, lambda t: F.when(possible, F.regexp_replace(t, pattern, label)).otherwise(t))
