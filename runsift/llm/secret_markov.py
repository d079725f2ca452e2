"""Secrets in text by patterns and by character Markov models, in DataFrame functions only.

Three patterns give the base spans. Two first-order Markov models over characters, one of random strings and one
of ordinary identifiers, then judge every other long run of identifier characters: a run whose log-likelihood ratio
exceeds ``least`` is a further span of kind ``markov``. Both models are trained on labelled samples taken from the
``train_docs`` documents with the lowest hashes of their ids (a bound on the rows the classifier is fitted on): values
that the patterns find are random, all other runs of such documents are ordinary.

Null text counts as empty. Each row is judged on its own, so repeated rows get equal answers and nothing is shuffled
but the counts of character pairs in training. Without any training rows the models are alike and add no span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import stored

#: The kinds in order, their patterns, and the least lengths (of the value for assign).
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of 20 and more
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Runs that the models judge: characters of identifiers and base-64 text.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
_SPANS = "array<struct<start:int,end:int>>"

#: Positions of matches from the lengths of the pieces between them; gathered in blocks of 64, so that a text with
#: very many matches costs little more than its length.
_PLACE = f"""
flatten(aggregate(
  transform(sequence(1, size({{m}}), 64), i -> slice(zip_with(slice({{p}}, 1, size({{m}})), {{m}}, (p, x) -> struct(length(p) AS gap, length(x) AS own)), i, 64)),
  named_struct('at', 0, 'out', CAST(array() AS array<{_SPANS}>)),
  (acc, block) -> aggregate(
    array(aggregate(block, named_struct('at', acc.at, 'out', CAST(array() AS {_SPANS})),
      (a, x) -> named_struct('at', a.at + x.gap + x.own, 'out', array_append(a.out, named_struct('start', a.at + x.gap, 'end', a.at + x.gap + x.own))))),
    acc, (z, r) -> named_struct('at', r.at, 'out', array_append(z.out, r.out)))
).out)
"""


def _matches(text: Column, pattern: str, maybe: Column | None = None, group: int = 0) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return found if maybe is None else F.when(maybe, found).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column, pattern: str, matches: str) -> Column:
    return F.when(F.size(matches) > 0, F.split(text, pattern, -1))


def _placed(matches: str, pieces: str) -> Column:
    return F.when(F.size(matches) > 0, F.expr(_PLACE.format(m=matches, p=pieces))).otherwise(F.array().cast(_SPANS))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """Base spans and all long runs: id, text, assign, access, hex (arrays of start, end), assign_values, runs (texts), run_spans."""
    text = F.col("text")
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("*", _matches(text, ASSIGN, text.contains("=") | text.contains(":")).alias("m0"), _matches(text, ACCESS, text.contains("AKIA")).alias("m1"),
                   _matches(text, HEX).alias("m2"), _matches(text, RUN % least).alias("m3"))
    df = df.select("*", F.when(F.size("m0") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).alias("values"),
                   *[_pieces(text, p, f"m{k}").alias(f"p{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN % least))])
    df = df.select("*", *[_placed(f"m{k}", f"p{k}").alias(f"s{k}") for k in range(4)])
    long = F.expr(f"""CASE WHEN size(m0) > 0 THEN transform(filter(zip_with(s0, values, (s, v) -> struct(s AS s, v AS v)), x -> length(x.v) >= {ASSIGN_LEAST}), x -> x.s)
                      ELSE s0 END""")
    return df.select(id_col, "text", long.alias("assign"), F.col("s1").alias("access"), F.col("s2").alias("hex"),
                     F.expr(f"filter(coalesce(values, array()), v -> length(v) >= {ASSIGN_LEAST})").alias("assign_values"),
                     F.concat("m1", "m2").alias("other_values"), F.col("m3").alias("runs"), F.col("s3").alias("run_spans"))


def _overlaps(span: Column) -> Column:
    others = F.concat("assign", "access", "hex")
    return F.exists(others, lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"]))


def train(docs: DataFrame, train_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random against ordinary) of character b after a, at a * 128 + b; row 0 is the start.

    Collected are counts of pairs of ASCII characters, at most 2 * 128 * 128 rows.
    """
    sample = docs.select(id_col, text_col).orderBy(F.xxhash64(F.col(id_col), F.lit(5)), F.xxhash64(text_col)).limit(train_docs)
    found = base_spans(stored(sample, "secret-sample"), id_col, text_col, least=6)
    ordinary = F.expr("transform(filter(zip_with(runs, run_spans, (r, s) -> struct(r AS r, s AS s)), x -> NOT exists(concat(assign, access, hex), b -> b.start < x.s.end AND b.end > x.s.start)), x -> x.r)")
    labelled = found.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), F.concat("assign_values", "other_values").alias("runs")),
                                              F.struct(F.lit(False).alias("random"), ordinary.alias("runs")))).alias("x"))
    pairs = labelled.select("x.random", F.explode("x.runs").alias("run")).select("random", F.split("run", "").alias("c")).select(
        "random", F.explode(F.expr("zip_with(concat(array(''), slice(c, 1, size(c) - 1)), c, (a, b) -> struct(ascii(a) AS a, ascii(b) AS b))")).alias("p"))
    counts = {True: {}, False: {}}
    for r in pairs.groupBy("random", "p.a", "p.b").count().collect():
        counts[r[0]][r[1], r[2]] = r[3]
    letters = [0, *(c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-.")]
    rows = {label: {a: sum(counts[label].get((a, b), 0) for b in letters) for a in letters} for label in counts}
    out = [0.0] * (128 * 128)
    if not any(rows[True].values()) or not any(rows[False].values()):
        return out
    for a in letters:
        for b in letters[1:]:
            random, ordinary_ = ((counts[x].get((a, b), 0) + smooth) / (rows[x][a] + smooth * (len(letters) - 1)) for x in (True, False))
            out[a * 128 + b] = round(math.log(random / ordinary_), 6)
    return out


def find_secrets(docs: DataFrame, ratios: list[float], least: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: id, n_assign, n_access, n_hex, base (array of kind, start, end), found (base and markov spans), in order of start, then kind."""
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    df = base_spans(docs, id_col, text_col)
    judged = F.zip_with("runs", "run_spans", lambda r, s: F.struct(r.alias("r"), s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn("judged", F.filter(judged, lambda x: ~_overlaps(x)))

    def ratio(run: Column) -> Column:
        chars = F.split(run, "")
        codes = F.transform(chars, lambda c: F.ascii(c))
        after = F.concat(F.array(F.lit(0)), F.slice(codes, 1, F.size(codes) - 1))
        return F.aggregate(F.zip_with(after, codes, lambda a, b: F.element_at(weights, a * 128 + b + 1)), F.lit(0.0), lambda s, x: s + x)

    def of(column: str, kind: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    df = df.withColumn("markov", F.filter("judged", lambda x: ratio(x["r"]) > least))
    base = F.concat(of("assign", 0), of("access", 1), of("hex", 2))
    df = df.withColumns({"base": F.array_sort(base), "found": F.array_sort(F.concat(base, of("markov", 3)))})
    name = F.array(*[F.lit(k) for k in KINDS])

    def named(column: str) -> Column:
        return F.transform(column, lambda s: F.struct(F.element_at(name, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return df.select(id_col, *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]], named("base").alias("base"), named("found").alias("found"))


def joined(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
