"""Prefix trie of conversations: a z-fast trie as a table, filled in batches.

A conversation is a sequence of turns (role, text). Its prefix of ``d`` turns is named by 128 bits: the exclusive or, over
its turns, of a hash of the place and the turn's SHA-256, so prefixes of one conversation come from running folds and no
text is moved. The compacted trie has a node for the root, each sequence that ends a conversation and each sequence after
which conversations part. A node's edge covers the depths after its parent's up to its own; its handle is the prefix at the
two-fattest of these depths (the one divisible by the highest power of two), and the table finds a node by its handle.

Distinct conversations are inserted in ``batches`` of growing size. A batch is located by fat binary search: each
conversation halves its range of depths at the two-fattest depth, an equi-join of its prefix there with the handles, which
takes as many rounds as the longest one has bits; the deepest node found, or its child by the next turn, is the exit node, and
the conversation leaves the trie at the last place where its turns and the exit node's are the same. Edges that are left
in the middle, or end there, are cut; what is new forks where its prefixes have several successors. At the end edges are
expanded into one row for each depth.

Everything is equi-joins and grouped sums: a prefix shared by a third of all conversations is pre-aggregated, running
values of one long conversation are made in chunks, and the identifiers that a node's digest covers are joined in stretches of the
number line before they stream through the hash.

Rules for odd rows: turns are ordered by number (null first), those of one number by the hash of role and text. Null role
and text count as empty, so repeated rows are repeated turns. Rows without a conv_id are left out. Extra columns are
ignored. An empty table gives no rows. Texts have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.common import stored

#: Turns of one conversation that a running value takes at a time; width of the stretches of identifiers.
CHUNK, STRETCH = 1 << 16, 1 << 12


def _running(df: DataFrame, key: str, order: str, values: dict[str, tuple]) -> DataFrame:
    """Running folds of columns by ``order`` (whole numbers) within ``key``: {name: (column, aggregate, combine)}; null where nothing comes before."""
    df = df.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({f"_in_{n}": agg(c).over(inside) for n, (c, agg, _) in values.items()})
    totals = df.groupBy(key, "_chunk").agg(*[agg(c).alias(f"_of_{n}") for n, (c, agg, _) in values.items()])
    heads = totals.select(key, "_chunk", *[agg(f"_of_{n}").over(before).alias(f"_to_{n}") for n, (_, agg, _) in values.items()]).where("_chunk > 0")
    out = local.join(heads, [key, "_chunk"], "left")
    extra = {n: F.when(F.col(f"_to_{n}").isNull(), F.col(f"_in_{n}")).when(F.col(f"_in_{n}").isNull(), F.col(f"_to_{n}"))
             .otherwise(both(F.col(f"_to_{n}"), F.col(f"_in_{n}"))) for n, (_, _, both) in values.items()}
    return out.select(*[c for c in df.columns if c != "_chunk"], *[c.alias(n) for n, c in extra.items()])


def _sum(values) -> tuple:
    return values, F.sum, lambda a, b: a + b


def _xor(values) -> tuple:
    return values, F.bit_xor, lambda a, b: a.bitwiseXOR(b)


def _max(values) -> tuple:
    return values, F.max, F.greatest


def turn_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, d (place from 1), a, b (halves of a hash of role and text), chars: the turns in order, without their texts."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint").alias("a"), F.conv(F.substring(digest, 17, 16), 16, -10).cast("bigint").alias("b"),
        F.char_length(text).cast("bigint").alias("chars"))
    stretch = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62)))
    rows = rows.withColumn("_part", stretch)
    place = F.row_number().over(Window.partitionBy("conv", "_part").orderBy(F.asc_nulls_first("turn"), "a", "b")).cast("bigint")
    before = rows.groupBy("conv", "_part").agg(F.count("*").alias("_n")).select(
        "conv", "_part", F.sum("_n").over(Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    placed = rows.withColumn("_at", place).join(before.where("_before > 0"), ["conv", "_part"], "left")
    return placed.select("conv", (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("d"), "a", "b", "chars")


def shared_openings(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose opening comes from the one at the round number before them: conversation c takes the first
    h = crc32(c) % ``most`` turns of conversation c - c % ``every`` and goes on with its own turns after its first h.

    conv, d, a, b, chars; conversations that are left without a turn are not among them. At most ``every`` conversations share an opening.
    """
    own = turns.withColumn("h", F.crc32(F.col("conv").cast("string")) % most)
    names = turns.select("conv").distinct().select(
        "conv", (F.col("conv") - F.col("conv") % every).alias("base"), (F.crc32(F.col("conv").cast("string")) % most).alias("h"))
    first = turns.where(F.col("d") < most).withColumnsRenamed({"conv": "base"})
    opening = names.join(first, "base").where("d <= h").select("conv", "d", "a", "b", "chars")
    sizes = opening.groupBy("conv").agg(F.count("*").alias("_k"))
    rest = own.where("d > h").join(sizes, "conv", "left").select("conv", (F.coalesce("_k", F.lit(0)) + F.col("d") - F.col("h")).alias("d"), "a", "b", "chars")
    return opening.unionAll(rest)


def _two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high)))
    return high.bitwiseAND(F.expr("bigint(-1)") * F.pow(F.lit(2), bits - 1).cast("bigint"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, d, p1, p2 (name of the first d turns), chars (of all of them)."""
    terms = turns.select("conv", "d", F.xxhash64("d", "a", "b").alias("t1"), F.xxhash64("b", "d", "a").alias("t2"), "chars")
    return _running(terms.withColumnRenamed("chars", "c"), "conv", "d", {"p1": _xor("t1"), "p2": _xor("t2"), "chars": _sum("c")}).select("conv", "d", "p1", "p2", "chars")


_NODE = "p1 bigint, p2 bigint, depth bigint, top bigint, wit bigint"


def _with_keys(nodes: DataFrame, named: DataFrame) -> DataFrame:
    """Nodes with the names of the handle (f, f1, f2) and of the first prefix of the edge (g1, g2)."""
    nodes = nodes.withColumn("f", _two_fattest(F.col("top"), F.col("depth")))
    at = lambda d, x, y: named.select(F.col("conv").alias("wit"), F.col("d").alias(d), F.col("p1").alias(x), F.col("p2").alias(y))
    out = nodes.join(at("f", "f1", "f2"), ["wit", "f"]).withColumn("_g", F.col("top") + 1)
    return out.join(at("_g", "g1", "g2"), ["wit", "_g"]).drop("_g")


def _locate(batch: DataFrame, handles: DataFrame, named: DataFrame, rounds: int) -> DataFrame:
    """conv, e1, e2, top, depth, wit (exit node; null: none), left_at (turns in common with the trie)."""
    by_handle = handles.select("f", "f1", "f2", "p1", "p2", "depth", "wit")
    prefix = named.select("conv", F.col("d").alias("f"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    state = batch.select("conv", F.col("len"), F.lit(0).cast("bigint").alias("low"), F.col("len").alias("high"), F.lit(0).cast("bigint").alias("n_depth"),
                         *[F.lit(None).cast("bigint").alias(c) for c in ("n1", "n2")])
    for k in range(rounds):  # the deepest node whose handle is a prefix
        asked = state.withColumn("f", F.when(F.col("low") < F.col("high"), _two_fattest(F.col("low"), F.col("high"))))
        hit = asked.where("f IS NOT NULL").join(prefix, ["conv", "f"]).join(by_handle, ["f", "f1", "f2"]).select("conv", "p1", "p2", "depth")
        state = asked.join(hit, "conv", "left").select(
            "conv", "len", F.coalesce("depth", "low").alias("low"), F.when(F.col("p1").isNull() & F.col("f").isNotNull(), F.col("f") - 1).otherwise(F.col("high")).alias("high"),
            F.coalesce("depth", "n_depth").alias("n_depth"), F.coalesce("p1", "n1").alias("n1"), F.coalesce("p2", "n2").alias("n2"))
        if k % 2 or k == rounds - 1:
            state = stored(state, "trie-search")
    # the whole of the node found is a prefix: its child by the next turn, if there is one, is the exit node
    here = named.select("conv", F.col("d").alias("n_depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    state = state.join(here, ["conv", "n_depth"], "left").withColumn("whole", (F.col("n_depth") == 0) | F.col("h1").eqNullSafe(F.col("n1")) & F.col("h2").eqNullSafe(F.col("n2")))
    following = named.select("conv", (F.col("d") - 1).alias("n_depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2"))
    child = handles.select("g1", "g2", F.col("p1").alias("c1"), F.col("p2").alias("c2"))
    state = state.join(following, ["conv", "n_depth"], "left").join(child, ["g1", "g2"], "left")
    down = F.col("whole") & F.col("c1").isNotNull()
    state = state.select("conv", "len", F.when(down, F.col("c1")).otherwise(F.col("n1")).alias("e1"), F.when(down, F.col("c2")).otherwise(F.col("n2")).alias("e2"))
    node = handles.select(F.col("p1").alias("e1"), F.col("p2").alias("e2"), "top", "depth", "wit")
    state = stored(state.join(node, ["e1", "e2"], "left"), "trie-exit")
    # the last common place on the exit node's edge
    mine = named.select("conv", "d", "p1", "p2")
    theirs = named.select(F.col("conv").alias("wit"), "d", F.col("p1").alias("w1"), F.col("p2").alias("w2"))
    same = state.select("conv", "wit", "top", "depth").join(mine, "conv").where("d > top AND d <= depth").join(theirs, ["wit", "d"]).where("p1 = w1 AND p2 = w2")
    common = same.groupBy("conv").agg(F.max("d").alias("_last"))
    return state.join(common, "conv", "left").withColumn("left_at", F.coalesce("_last", "top", F.lit(0).cast("bigint"))).drop("_last")


def _insert(nodes: DataFrame, batch: DataFrame, named: DataFrame, rounds: int) -> DataFrame:
    """The trie with one more batch of distinct conversations (conv, len)."""
    own = named.join(batch, "conv")
    placed = stored(_locate(batch, _with_keys(nodes, named), named, rounds), "trie-placed")
    # new prefixes: what lies below the place where a conversation leaves the trie
    below = placed.select("conv", "left_at")
    fresh = own.join(below, "conv").where("d > left_at").select("conv", "d", "p1", "p2", "len", "left_at")
    fresh = stored(fresh, "trie-fresh")
    links = fresh.select("conv", (F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    heads = fresh.groupBy("p1", "p2").agg(F.min("conv").alias("wit"), F.first("d").alias("depth"), F.max(F.col("d") == F.col("len")).alias("ends"))
    parents = heads.select(F.col("wit").alias("conv"), F.col("depth").alias("d")).join(links, ["conv", "d"]).groupBy("q1", "q2").agg(F.count("*").alias("kids"))
    forks = heads.join(parents.withColumnsRenamed({"q1": "p1", "q2": "p2"}), ["p1", "p2"], "left").where("ends OR kids > 1").select("p1", "p2", "depth", "wit")
    forks = stored(forks, "trie-forks")
    # their tops: the last fork before them on their witness, or where it leaves the trie
    paths = fresh.join(forks.select("p1", "p2", F.col("wit").alias("of")), ["p1", "p2"], "left")
    paths = _running(paths.withColumns({"_at": F.when(F.col("of").isNotNull(), F.col("d")), "_next": F.col("d") + 1}), "conv", "_next", {"_last": _max("_at")})
    ahead = paths.where("_last IS NOT NULL").select("conv", F.col("_next").alias("d"), "_last")
    new = forks.join(ahead, (forks["wit"] == ahead["conv"]) & (forks["depth"] == ahead["d"]), "left").drop("conv", "d").join(
        below.withColumnRenamed("conv", "wit"), "wit").select("p1", "p2", "depth", F.coalesce("_last", "left_at").alias("top"), "wit")
    # cuts of edges that are left, or where a conversation ends, before their end
    cut = placed.where("left_at > top AND left_at < depth").select("e1", "e2", "wit", "top", F.col("left_at").alias("depth")).distinct()
    names = named.select(F.col("conv").alias("wit"), F.col("d").alias("depth"), "p1", "p2")
    lower = placed.where("left_at > top AND left_at < depth").groupBy("e1", "e2").agg(F.max("left_at").alias("_cut"))
    old = nodes.join(lower.withColumnsRenamed({"e1": "p1", "e2": "p2"}), ["p1", "p2"], "left").select("p1", "p2", "depth", F.coalesce("_cut", "top").alias("top"), "wit")
    between = Window.partitionBy("e1", "e2").orderBy("depth")
    cut = cut.withColumn("_top", F.coalesce(F.lag("depth").over(between), F.col("top"))).join(names, ["wit", "depth"]).select("p1", "p2", "depth", F.col("_top").alias("top"), "wit")
    return stored(old.unionByName(new).unionByName(cut), "trie-nodes")


def build(classes: DataFrame, named: DataFrame, batches: int = 2) -> DataFrame:
    """Compacted nodes but the root: p1, p2 (name), depth, top (parent's depth), wit (a conversation that has it as a prefix).

    ``classes``: conv, len of distinct conversations with turns; ``named``: their prefixes.
    """
    nodes = classes.sparkSession.createDataFrame([], _NODE)
    longest = classes.agg(F.max("len")).first()[0] or 0
    parts = (3 ** batches - 1) // 2  # shares 1, 3, 9, ...
    drawn = F.pmod(F.xxhash64("conv"), F.lit(parts))
    low = 0
    for k in range(batches):
        high = low + 3 ** k
        nodes = _insert(nodes, classes.where((drawn >= low) & (drawn < high)), named, int(longest).bit_length() if k else 0)
        low = high
    return nodes


def _digests(ends: DataFrame, key: str) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ascending decimal conv ids of each key, comma-joined."""
    stretches = ends.groupBy(key, F.floor(F.col("conv") / STRETCH).alias("part")).agg(F.sort_array(F.collect_list("conv")).alias("ids")).select(
        key, "part", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))  # at most STRETCH ids
    counted = stored(stretches, "trie-ends")
    many = counted.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(key).to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=[key, "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=[key, "ends_sha256"])

    streamed = counted.join(many, key, "left_semi").repartition(key).sortWithinPartitions(key, "part").mapInArrow(run, f"{key} bigint, ends_sha256 string")
    return counted.join(many, key, "left_anti").select(key, F.sha2("ids", 256).alias("ends_sha256")).unionAll(streamed)


def trie_nodes(turns: DataFrame, conversations: DataFrame | None = None, batches: int = 2) -> DataFrame:
    """One row for each distinct prefix of the conversations in ``turns`` (conv, d, a, b, chars), the empty one included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    ``conversations`` (conv) also names those without turns, which are members of the root.
    """
    spark = turns.sparkSession
    named = stored(prefixes(turns), "trie-prefixes")
    last = named.groupBy("conv").agg(F.max("d").alias("len")).withColumnRenamed("len", "d").join(named, ["conv", "d"])
    ends = stored(last.select("conv", F.col("d").alias("len"), F.col("p1"), F.col("p2"), "chars"), "trie-ends")
    classes = stored(ends.groupBy("p1", "p2").agg(F.min("conv").alias("conv"), F.first("len").alias("len"), F.count("*").alias("n")), "trie-classes")
    of_classes = stored(named.join(classes.select("conv", "len", "n"), "conv"), "trie-class-prefixes")
    nodes = build(classes.select("conv", "len"), of_classes.select("conv", "d", "p1", "p2"), batches)

    # class members of nodes: every class below its smallest conversation's prefixes
    paths = stored(of_classes.select("conv", "d", "n", "p1", "p2").join(nodes.select("p1", "p2"), ["p1", "p2"]), "trie-paths")
    members = paths.groupBy("p1", "p2").agg(F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"))
    at = of_classes.select(F.col("conv").alias("wit"), F.col("d").alias("depth"), F.col("chars").alias("chars_to"))
    up = of_classes.select(F.col("conv").alias("wit"), F.col("d").alias("top"), F.col("chars").alias("chars_from"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    full = nodes.join(members, ["p1", "p2"]).join(at, ["wit", "depth"]).join(up, ["wit", "top"], "left")
    kids = full.groupBy("q1", "q2").agg(F.count("*").alias("kids"))
    full = full.join(kids.where("q1 IS NOT NULL").withColumnsRenamed({"q1": "p1", "q2": "p2"}), ["p1", "p2"], "left").select(
        "p1", "p2", "q1", "q2", "depth", "top", "wit", "conv_id", "n_convs", F.coalesce("kids", F.lit(0)).cast("bigint").alias("n_children"),
        ((F.col("n_convs") - 1) * (F.col("chars_to") - F.coalesce("chars_from", F.lit(0)))).alias("saved"), "chars_to",
        F.monotonically_increasing_id().alias("node"))
    full = stored(full, "trie-full")
    # what a subtree adds up to: each node counts for the nodes above it, which are on its witness
    sums = full.select(F.col("wit").alias("conv"), "depth", "saved", (F.col("n_children") == 0).cast("bigint").alias("leaf")).join(paths.select("conv", "d", "p1", "p2"), "conv").where(
        "d <= depth").groupBy("p1", "p2").agg(F.sum(F.when(F.col("d") < F.col("depth"), F.col("saved")).otherwise(0)).alias("saved_below"), F.sum("leaf").alias("n_leaves"))
    above = full.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above_id"))
    full = full.join(sums, ["p1", "p2"])
    full = full.where("top > 0").join(above, ["q1", "q2"]).unionByName(full.where("top = 0").withColumn("above_id", F.lit(None).cast("bigint")))
    ending = ends.join(full.select("p1", "p2", "node"), ["p1", "p2"]).select("conv", "node")
    full = full.join(_digests(ending, "node"), "node", "left")

    everyone = (turns if conversations is None else conversations).select("conv").where("conv IS NOT NULL").distinct()
    whole = everyone.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).first()
    tops = full.agg(F.sum("saved").alias("saved"), F.sum((F.col("top") == 0).cast("bigint")).alias("kids"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves")).first()
    turnless = everyone.join(ends.select("conv"), "conv", "left_anti").select("conv", F.lit(0).cast("bigint").alias("node"))
    digest = _digests(turnless, "node").first()
    none = hashlib.sha256(b"").hexdigest()
    top_row = [(whole["conv_id"], 0, None, whole["n_convs"], tops["kids"] or 0, tops["leaves"] or 1, tops["saved"] or 0, digest["ends_sha256"] if digest else none)]
    root = spark.createDataFrame(top_row if whole["n_convs"] else [], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")

    # edges expanded: a row for each depth
    starts = F.explode(F.sequence(F.col("top") + 1, F.col("depth"), F.lit(CHUNK).cast("bigint")))
    edge = full.withColumn("_from", starts).withColumn("d", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK - 1, F.col("depth")))))
    before = of_classes.select(F.col("conv").alias("wit"), (F.col("d") + 1).alias("d"), F.col("chars").alias("chars_before"))
    edge = edge.join(before, ["wit", "d"], "left")
    inner = F.col("d") < F.col("depth")
    rows = edge.select(
        "conv_id", F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("top") + 1, F.col("conv_id")).when(F.col("top") == 0, F.lit(whole["conv_id"]).cast("bigint")).otherwise(F.col("above_id")).alias("parent_conv_id"),
        "n_convs", F.when(inner, F.lit(1)).otherwise(F.col("n_children")).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("saved_below") + (F.col("n_convs") - 1) * (F.col("chars_to") - F.coalesce("chars_before", F.lit(0)))).alias("saved_tokens"),
        F.when(inner, F.lit(none)).otherwise(F.coalesce("ends_sha256", F.lit(none))).alias("ends_sha256"))
    return rows.unionByName(root)
