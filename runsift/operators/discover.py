"""Repository discovery and rule proposals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runsift.functions import commands as C
from runsift.functions.text import nn, trim_ctl
from runsift.operators.ledger import days_before
from runsift.operators.prepare import lookup_prefixes, with_bound
from runsift.operators.sessions import covered

# Thresholds, kinds and states of proposals.
MIN_RUNS, MIN_INCIDENTS, MIN_RAW_TOKENS, LOOKBACK_DAYS = 5, 3, 2000, 90
COVERAGE, SAFETY, UNMATCHED = "coverage", "safety", "unmatched"
READY, SKIPPED, BLOCKED = "ready", "skipped_existing", "blocked_not_representable"
INCIDENT_KINDS = ["stage_exception", "apply_fallback"]


# --- H1, H2 -----------------------------------------------------------------------

def discover(repo_files: DataFrame, signals: DataFrame) -> DataFrame:
    """(root, family, rule, priority, signals, recommend): the first rule that fires per family.

    Files meet the signal table on the path; everything after is grouped per root
    and family with combining aggregates.
    """
    hit = repo_files.join(with_bound(signals), "path")
    hit = hit.where(F.forall("needles", lambda n: nn(F.col("head_text")).contains(n)))
    per_rule = hit.groupBy("root", "family", "rule", "priority").agg(
        F.array_sort(F.collect_set(F.struct("signal_no", "path"))).alias("s"), F.first("recommend").alias("recommend"))
    best = per_rule.groupBy("root", "family").agg(
        F.min_by(F.struct("rule", "priority", "s", "recommend"), F.struct("priority", "rule")).alias("b"))
    return best.select("root", "family", F.col("b.rule").alias("rule"), F.col("b.priority").alias("priority"),
                       F.transform("b.s", lambda x: x["path"]).alias("signals"), F.col("b.recommend").alias("recommend"))


def recommendations(hits: DataFrame) -> DataFrame:
    """(root, rank, definition): distinct definitions in the order their rules fire."""
    rows = hits.select("root", "priority", "rule", F.posexplode("recommend").alias("pos", "definition"))
    firsts = rows.groupBy("root", "definition").agg(F.min(F.struct("priority", "rule", "pos")).alias("k"))
    return firsts.select("root", F.row_number().over(W.partitionBy("root").orderBy("k")).alias("rank"), "definition")


# --- H3 ---------------------------------------------------------------------------

def propose_coverage(recommended: DataFrame, definitions: Mapping[str, Mapping], existing: DataFrame) -> DataFrame:
    """(root, command, definition, status) for every command of a recommended definition.

    ``existing``: (root, command) overrides of a project. A command claimed by two
    definitions goes to the earlier recommendation.
    """
    spark = recommended.sparkSession
    table = spark.createDataFrame(
        [(d["name"], i, " ".join(c.lower().split()), bool(d.get("gate")) or bool((d.get("select_input") or "").strip()))
         for d in definitions.values() for i, c in enumerate(d["commands"])],
        "definition string, pos int, command string, blocked boolean")
    rows = recommended.join(with_bound(table), "definition")
    first = rows.groupBy("root", "command").agg(F.min(F.struct("rank", "pos", "definition", "blocked")).alias("f"))
    have = existing.select("root", F.lower(trim_ctl(F.col("command"))).alias("command")).distinct().withColumn("have", F.lit(True))
    out = first.join(have, ["root", "command"], "left")
    status = F.when(F.col("have"), SKIPPED).when(F.col("f.blocked"), BLOCKED).otherwise(READY)
    return out.select("root", "command", F.col("f.definition").alias("definition"), status.alias("status"))


# --- H6 ---------------------------------------------------------------------------

def under_root(cwd: Column, root: str) -> Column:
    base = root.rstrip("/")
    return (cwd == base) | cwd.startswith(base + "/")


def project_scope(ledger: DataFrame, root: str, fingerprint: str) -> DataFrame:
    """Rows in scope of a root: run below it, of its project, or of a project that a
    newer row below the root belongs to (rows are read newest first)."""
    inside = under_root(nn(F.col("cwd")), root)
    at = F.struct("ts", "id")
    seen = ledger.where(inside & (trim_ctl(nn(F.col("project"))) != "")).groupBy("project").agg(F.max(at).alias("_first"))
    out = ledger.join(with_bound(seen), "project", "left")
    scoped = inside | (F.col("project") == fingerprint) | (F.col("_first").isNotNull() & (at <= F.col("_first")))
    return out.where(F.coalesce(scoped, F.lit(False))).select(*ledger.columns)


def latest(rows: DataFrame, as_of: str, n: int | None = None) -> DataFrame:
    """Rows of the look-back window; with ``n``, the newest so many (top-k, no full sort)."""
    out = rows.where(F.col("ts") >= days_before(as_of, LOOKBACK_DAYS))
    return out if n is None else out.orderBy(F.desc("ts"), F.desc("id")).limit(n)


# --- H4, H5 -------------------------------------------------------------------------

def override_key(rows: DataFrame, rules: DataFrame, max_words: int) -> DataFrame:
    """Add ``key``: the longest rule prefix that owns the command, else the whole command."""
    dim = with_bound(rules.select("prefix", F.col("prefix").alias("key")))
    out = lookup_prefixes(rows, dim, "command", ["key"], max_words)
    return out.withColumn("key", F.coalesce("key", F.lower(trim_ctl(nn(F.col("command"))))))


def propose_safety(outcomes: DataFrame, commands: DataFrame, rules: DataFrame, max_words: int, as_of: str,
                   fingerprint: str, n: int | None = None) -> DataFrame:
    """(command, incidents) with repeated fallbacks among the outcomes of the look-back window in scope (``n``: its newest).

    ``commands`` are the scoped ledger rows; an outcome is in scope by its project
    or by its exact command.
    """
    recent = latest(outcomes.where(F.col("kind").isin(INCIDENT_KINDS)), as_of, n)
    norm = F.lower(trim_ctl(nn(F.col("command"))))
    projects = commands.select("project").where("project IS NOT NULL").distinct().withColumn("_p", F.lit(True))
    names = commands.select(norm.alias("_cmd")).distinct().withColumn("_c", F.lit(True))
    out = recent.withColumn("_cmd", norm).join(projects, "project", "left").join(names, "_cmd", "left")
    out = out.where(F.col("_p") | F.col("_c") | (F.col("project") == fingerprint))
    keyed = override_key(out, rules, max_words)
    return keyed.groupBy(F.col("key").alias("command")).agg(F.count("*").alias("incidents")).where(
        F.col("incidents") >= MIN_INCIDENTS)


def first_plain_word(command: Column) -> Column:
    words = F.split(C.normalized(command), " ")
    return F.coalesce(F.try_element_at(F.filter(words, lambda w: (w != "") & ~w.startswith("-")), F.lit(1)), F.lit(""))


def propose_unmatched(commands: DataFrame, prefixes: Sequence[str], interpreter_prefixes: Sequence[str] = (),
                      own_name: str = "runsift") -> DataFrame:
    """(command, uses, sum_raw) of frequent, large commands that no rule family covers."""
    return _unmatched(commands, [], prefixes, interpreter_prefixes, own_name)


def _unmatched(commands: DataFrame, by: list[str], prefixes: Sequence[str], interpreter_prefixes: Sequence[str], own_name: str) -> DataFrame:
    every = [*prefixes, *interpreter_prefixes]
    families = sorted({p.split()[0].lower() for p in every} | {own_name})
    word = first_plain_word(F.col("command"))
    rows = commands.where(~covered(F.col("command"), every)).select(*by, word.alias("command"), "raw_tokens")
    rows = rows.where((F.col("command") != "") & ~F.col("command").isin(families))
    return rows.groupBy(*by, "command").agg(
        F.count("*").alias("uses"), F.sum(F.greatest(F.col("raw_tokens"), F.lit(0))).alias("sum_raw")).where(
            (F.col("uses") >= MIN_RUNS) & (F.col("sum_raw") >= MIN_RAW_TOKENS))


# --- H4, H5, H6 for a table of roots ---------------------------------------------------

def folders(path: Column) -> Column:
    """A path and all folders above it, without closing slashes; the top is ''."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def _keys(rows: DataFrame, *keys: Column) -> DataFrame:
    """A row for each distinct key of a row: struct(kind, key)."""
    return rows.withColumn("_k", F.explode(F.array_distinct(F.array_compact(F.flatten(F.array(*keys)))))).withColumns(
        {"_kind": F.col("_k.kind"), "_key": F.col("_k.key")}).drop("_k")


def _key(kind: str, value: Column) -> Column:
    return F.array(F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.alias("key"))))


def scope_all(ledger: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, ledger columns): for each of many roots (root, path, fingerprint) the rows that `project_scope` has for one.

    A row names the folders above it and its project, and meets the roots on equality: a path claims what lies below it, and a
    project is claimed by its fingerprint or, up to the newest row below the root, by rows below the root. The claims are a few rows a root,
    and the ledger is read once for the projects seen and once for the rows, whatever the number of roots.
    """
    cwd, project = F.regexp_replace(nn(F.col("cwd")), "/+$", ""), F.col("project")
    above = F.when(cwd != "", F.transform(folders(cwd), lambda x: F.struct(F.lit("folder").alias("kind"), x.alias("key"))))
    above = F.coalesce(above, F.array().cast("array<struct<kind:string,key:string>>"))
    at = F.struct("ts", "id")
    paths = roots.select("root", F.lit("folder").alias("_kind"), F.regexp_replace("path", "/+$", "").alias("_key"))
    named = roots.where("fingerprint IS NOT NULL").select("root", F.lit("project").alias("_kind"), F.col("fingerprint").alias("_key"))
    below = _keys(ledger.where(trim_ctl(nn(project)) != "").select("ts", "id", "project", above.alias("_above")), F.col("_above")).join(with_bound(paths), ["_kind", "_key"])
    seen = below.groupBy("root", "project").agg(F.max(at).alias("_until")).select("root", F.lit("project").alias("_kind"), F.col("project").alias("_key"), "_until")
    claims = paths.unionByName(named).distinct().withColumn("_until", F.lit(None).cast(seen.schema["_until"].dataType)).unionByName(seen)
    own = _keys(ledger.withColumn("_above", above), F.col("_above"), _key("project", project)).drop("_above")
    hit = own.join(with_bound(claims), ["_kind", "_key"]).where(F.col("_until").isNull() | (at <= F.col("_until")))
    return hit.dropDuplicates(["root", "id"]).select("root", *ledger.columns)


def propose_safety_all(outcomes: DataFrame, scoped: DataFrame, roots: DataFrame, rules: DataFrame, max_words: int, as_of: str) -> DataFrame:
    """(root, command, incidents): `propose_safety` for each root of ``scoped`` (`scope_all`); outcomes have an ``id``."""
    norm = F.lower(trim_ctl(nn(F.col("command"))))
    recent = latest(outcomes.where(F.col("kind").isin(INCIDENT_KINDS)), as_of)
    # the projects and commands of a root, distinct before they are shuffled
    wanted = _keys(scoped.select("root", "project", norm.alias("_cmd")).distinct(), _key("project", F.col("project")), _key("command", F.col("_cmd"))).select("root", "_kind", "_key")
    wanted = wanted.unionByName(roots.where("fingerprint IS NOT NULL").select("root", F.lit("project").alias("_kind"), F.col("fingerprint").alias("_key"))).distinct()
    own = _keys(recent.select("id", "command", "project"), _key("project", F.col("project")), _key("command", norm))
    hit = own.join(wanted, ["_kind", "_key"]).dropDuplicates(["root", "id"]).select("root", "command")
    keyed = override_key(hit, rules, max_words)
    return keyed.groupBy("root", F.col("key").alias("command")).agg(F.count("*").alias("incidents")).where(F.col("incidents") >= MIN_INCIDENTS)


def propose_unmatched_all(scoped: DataFrame, prefixes: Sequence[str], interpreter_prefixes: Sequence[str] = (), own_name: str = "runsift") -> DataFrame:
    """(root, command, uses, sum_raw): `propose_unmatched` for each root of ``scoped``."""
    return _unmatched(scoped, ["root"], prefixes, interpreter_prefixes, own_name)


# --- H7 -------------------------------------------------------------------------------

def proposal_id(kind: Column, command: Column, body: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit("\0"), command, F.lit("\0"), body), 256), 1, 12)


def merge_proposals(coverage: DataFrame, safety: DataFrame, unmatched: DataFrame, existing: DataFrame,
                    n: int | None = None) -> DataFrame:
    """One claim per root and command in the order coverage, safety, unmatched; existing commands are skipped.

    Inputs share (root, command) and their evidence columns; ``existing`` is (root, command). ``n``: first rows of each root.
    """
    zero = F.lit(None).cast("bigint")
    parts = [
        coverage.select(F.lit(0).alias("claim"), F.lit(COVERAGE).alias("kind"), "root", "command", "status", zero.alias("uses"),
                        zero.alias("incidents"), zero.alias("sum_raw")),
        safety.select(F.lit(1).alias("claim"), F.lit(SAFETY).alias("kind"), "root", "command", F.lit(READY).alias("status"), zero.alias("uses"),
                      "incidents", zero.alias("sum_raw")),
        unmatched.select(F.lit(2).alias("claim"), F.lit(UNMATCHED).alias("kind"), "root", "command", F.lit(READY).alias("status"), "uses",
                         zero.alias("incidents"), "sum_raw")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    have = existing.select("root", F.lower(trim_ctl(F.col("command"))).alias("command")).distinct().withColumn("have", F.lit(True))
    rows = rows.join(have, ["root", "command"], "left").withColumn("have", F.coalesce("have", F.lit(False)))
    # skipped rows stay, one per kind; of the others the first claim wins
    cols = ["claim", "kind", "status", "uses", "incidents", "sum_raw"]
    won = rows.where(~F.col("have")).groupBy("root", "command").agg(F.min_by(F.struct(*cols), "claim").alias("b")).select("root", "command", "b.*")
    skipped = rows.where("have").groupBy("root", "command", "kind").agg(F.min("claim").alias("claim")).select(
        "root", "command", "claim", "kind", F.lit(SKIPPED).alias("status"), zero.alias("uses"), zero.alias("incidents"), zero.alias("sum_raw"))
    out = won.unionByName(skipped)
    body = F.concat_ws("|", "status", F.col("uses").cast("string"), F.col("incidents").cast("string"))
    out = out.select("root", proposal_id(F.col("kind"), F.col("command"), body).alias("id"), "kind", "status", "command", "uses",
                     "incidents", "sum_raw")
    if n is None:
        return out
    rank = F.row_number().over(W.partitionBy("root").orderBy("kind", "command", "status"))
    return out.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
