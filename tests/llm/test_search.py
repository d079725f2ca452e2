"""Ranked search, the conversation trie and nearest neighbours against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from runsift.llm import nra_search, projection_forest, zfast_trie

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked_brute(docs, items, k=10):
    """docs, items: (id, text); rows (item, rank, doc, score), items numbered by place."""
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, n_all = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        hits = []
        for d, bag in bags:
            n = sum(bag.values())
            m = 100 - 75 + (75 * n * n_docs) // n_all if n_all else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score > 0:
                hits.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:k], 1)]
    return out


def everything(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k", 1) for i, t in rows], "item_id bigint, text string, rank int, key string, row int")


def test_terms():
    text = "Ab1-É ÀB_c\x7fİi\x00z  ß.Ω"
    assert [t.decode() for t in nra_search.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("postings", [40, 1 << 20])
def test_ranked_against_brute_force(spark, corpus, postings):
    rng = random.Random(postings)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "É", "Z"]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 65), k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(400 + i, docs[i % 5][1]) for i in range(60)]  # copies: ties
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    got = nra_search.search(corpus([t for _, t in docs], [d for d, _ in docs]).repartition(3), items_of(spark, items), postings=postings, item_chars=200)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert everything(got) == in_order(ranked_brute(docs, items))


def test_lists_are_left_early():
    """Reading stops before the ends of the lists once the best are settled."""
    rng = np.random.default_rng(1)
    n = 20_000
    tf = np.concatenate([np.full(20, 500), np.ones(2 * n - 20, int)])
    doc, term = np.concatenate([np.arange(n), np.arange(n)]), np.repeat([0, 1], n)
    tf[n:n + 20] = 500
    shard = nra_search.Shard(list(range(n)), rng.integers(50, 60, n), doc, term, tf, 2)
    found, taken = shard.best([(0, 900), (1, 800)], 10, 0)
    assert taken < n / 10
    assert {d for _, d in sorted(found, reverse=True)[:10]} <= set(range(20))
    assert shard.best([(0, 900), (1, 800)], 10, 10 ** 15) == ([], 0)


def test_ranked_odd_rows(spark, corpus, long_text):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "..."), (5, "alpha beta"), (5, "alpha beta"), (4, long_text), (6, "Word1 and ALPHA")]
    items = [(0, "alpha"), (None, "word1 word1 and1"), (2, None), (3, "nowhere"), (0, "alpha"), (9, long_text)]
    got = nra_search.search(corpus([t for _, t in docs], [d for d, _ in docs]), items_of(spark, items))
    assert everything(got) == in_order(ranked_brute(docs, items))
    assert nra_search.search(corpus([], []), items_of(spark, items)).count() == 0
    assert nra_search.search(corpus(["a"]), items_of(spark, [])).count() == 0


def trie_brute(rows):
    """rows: (conv, turn, role, text), turns of one number equal."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [z[2:] for z in sorted(v)] for c, v in own.items()}
    built = {c: tuple(own.get(c - c % 100, [])[:zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6:]) for c, v in own.items()}
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                kids[v[:d - 1]].add(v[:d])
    leaves, saved, out = {}, {}, []
    for v in sorted(members, key=len, reverse=True):
        leaves[v] = sum(leaves[k] for k in kids[v]) or 1
        saved[v] = sum(saved[k] for k in kids[v]) + ((len(members[v]) - 1) * len(v[-1][1]) if v else 0)
        ids = ",".join(str(c) for c in sorted(members[v]) if len(built[c]) == len(v))
        out.append((min(members[v]), len(v), min(members[v[:-1]]) if v else None, len(members[v]), len(kids[v]), leaves[v], saved[v], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def conversations(spark, rows):
    rows = [(*r, 5, 3, 1, "x") for r in rows]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, depth int, n_convs int, conv int, d string")


def trie(source):
    turns = zfast_trie.shared_openings(zfast_trie.turn_rows(source))
    return zfast_trie.trie_nodes(turns, source.select(F.col("conv_id").alias("conv")))


def test_two_fattest(apply):
    for low, high in [(0, 1), (0, 5), (3, 4), (4, 7), (8, 15), (100, 1000), (65_535, 65_537)]:
        got = apply(lambda a, b: zfast_trie._two_fattest(a.cast("bigint"), b.cast("bigint")), low, high)
        assert got == max(range(low + 1, high + 1), key=lambda x: x & -x)


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_trie_against_brute_force(spark, monkeypatch, chunk):
    """Chains, forks, copies, shared and absent openings, turnless conversations, one conversation far longer than the rest."""
    monkeypatch.setattr(zfast_trie, "CHUNK", chunk)
    monkeypatch.setattr(zfast_trie, "STRETCH", 16)
    rng = random.Random(5)
    rows = []
    for c in [0, *rng.sample(range(1, 700), 160)]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["a", "bé", "a long turn", "", None])))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(80) for t in range(8)]  # one group of copies, many ends
    rows += [(2000 + 7 * c, t, "user", f"chain {t}") for c in range(14) for t in range(c + 1)]
    rows += [(3000, t, "user", str(t // 3)) for t in range(70)] + [(3001, t, "user", str(t // 3)) for t in range(40)]
    rows += [(5000 + c, None if t == 0 else t, "user", "null first") for c in (0, 1, 150) for t in (2, 0, 1)]
    rows += [(None, 0, "user", "nobody")]
    assert everything(trie(conversations(spark, rows))) == in_order(trie_brute(rows))


def test_trie_odd_rows(spark, long_text):
    assert trie(conversations(spark, [])).count() == 0
    turnless = next(c for c in range(7100, 7200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "gone")]
    assert everything(trie(conversations(spark, rows))) == in_order(trie_brute(rows))
    rows = [(0, t, None, long_text) for t in range(3)] + [(0, 1, None, long_text), (-5, 0, "user", "x"), (8, 1 << 40, "user", "far"), (8, 2, "user", "near")]
    got = {r.depth for r in trie(conversations(spark, rows)).collect()}
    assert got >= {0, 1, 2, 3, 4}


def test_trie_by_batches(spark):
    """The same nodes whatever the batches are; later ones meet handles of earlier ones."""
    turns = zfast_trie.turn_rows(spark.read.parquet(f"{SF}/conversations.parquet"))
    shared = zfast_trie.shared_openings(turns)
    assert everything(zfast_trie.trie_nodes(shared, batches=1)) == everything(zfast_trie.trie_nodes(shared, batches=4))


def test_trie_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert everything(entry.queries()["op12_zfast_trie"](spark, SF)) == in_order(trie_brute(rows))


def nearest_brute(rows, k, every):
    """rows: (id, vector); {query: [(score, id)]} by products added in order."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            hits = []
            for j, w in good:
                if j != i and len(w) == len(v):
                    total = 0.0
                    for a, b in zip(v, w, strict=True):
                        total += a * b
                    hits.append((-total, j))
            out[i] = [(-s, j) for s, j in sorted(hits)[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, 1, 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, n int, score double")


def by_query(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return dict(out)


def test_nearest_is_exact_when_all_leaves_are_searched(spark):
    """Copies, ties of many zero products, vectors of several lengths and sizes, blocks of few vectors."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 5])]) for i in range(300)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(90)]
    rows += [(600 + i, [float(i % 4 == j) for j in range(40)]) for i in range(200)]
    got = by_query(projection_forest.nearest(vectors(spark, rows), k=7, every=10, recall=1.0, checks=1000, block=16))
    assert got == nearest_brute(rows, 7, 10)


def test_nearest_odd_rows(spark):
    rows = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [math.inf, 1.0]), (100, [math.nan, 1.0]), (None, [1.0, 1.0]),
            (120, [1.0, 2.0]), (120, [1.0, 2.0]), (121, [2.0, 1.0]), (122, [-0.0, 1.0]), (123, [0.0, 1.0]), (140, [1.0, 2.0, 3.0]), (160, [5.0]), (161, [-5.0])]
    got = by_query(projection_forest.nearest(vectors(spark, rows), k=2))
    assert got == {120: [(4.0, 121), (2.0, 122)], 160: [(-25.0, 161)]}
    assert projection_forest.nearest(vectors(spark, [])).count() == 0


def test_queue_goes_by_distance_over_all_trees():
    """Leaves come in the order of their squared distances, whatever their tree."""
    rng = np.random.default_rng(4)
    forest = projection_forest.fit(rng.normal(size=(2000, 12)), 6.0, 64, 3, 1)
    q = rng.normal(size=12)
    unit = np.append(q / np.linalg.norm(q), 0.0)
    far = {}
    for t in range(3):
        for leaf in range(64):
            node, total = leaf + 63, 0.0
            while node:
                up = (node - 1) // 2
                s = unit @ forest.normals[t, up] - forest.offsets[t, up]
                total += s * s if (node == 2 * up + 2) != (s > 0) else 0.0
                node = up
            far[t, leaf] = total
    order = [far[v] for v in forest.visits(q, 192)]
    assert len(order) == 192 and order == pytest.approx(sorted(far.values()))


def test_nearest_query_recall(spark):
    """At least nine of ten true neighbours on the whole table, each with its exact score."""
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = nearest_brute(rows, 20, 20), by_query(entry.queries()["op13_projection_forest"](spark, SF))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
