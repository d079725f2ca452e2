"""Joins and near-duplicates against brute force: shingle sets, vectors, lines, components."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from runsift.llm import edits, fuzzy_lines, ngram_join, pivot_index
from runsift.llm.common import Steps, stored
from runsift.llm.components import components
from runsift.llm.shingles import word_hashes


def joined(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def sets_of(rows, size):
    out = {}
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[d] = frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()
    return out


def jaccard_brute(rows, size, percent):
    sets = sets_of(rows, size)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = joined(ids, links)
    return {d: (len(sets[d]), group[d]) for d in ids}


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1090)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = joined({x for p in real for x in p}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_jaccard_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entry.queries()["op3_ngram_jaccard_join"](spark, "/root/testdata/sf0.001").collect()}
    assert got == jaccard_brute(rows, 3, 90)


def test_jaccard_chains_and_odd_rows(corpus, long_text):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    texts = [None, "", " \t\n", "One", "one", "a b", "A  B", "a b c", long_text, long_text + " end", *variants(rng, base, 40, 6), *variants(rng, base, 40, 2)]
    for size, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(corpus(texts), percent, size).collect()}
        assert got == jaccard_brute(list(enumerate(texts)), size, percent)
    again = ngram_join.jaccard_groups(corpus(["a b c", "a b c", "x y z"], [4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in again if r.doc_id) == [(4, 4), (4, 4)]
    assert [r.component_id for r in again if r.doc_id is None] == [None]
    assert ngram_join.jaccard_groups(corpus([])).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    near = rng.normal(size=(1, 16)) + 0.12 * rng.normal(size=(300, 16))
    mixed = [rng.normal(size=16) for _ in range(300)]
    close = [v + 0.3 * rng.normal(size=16) for v in mixed[:100]]
    rows = [*near.tolist(), *map(list, mixed), *map(list, close), near[0].tolist(), (near[0] * 2).tolist()]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0, 2.0]]
    data = [(i, None if v is None else [None if c is None else float(c) for c in v], 3, "k") for i, v in enumerate([*rows, *odd])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, n int, key string")
    got = {r.vec_id: r for r in pivot_index.near_duplicates(df, block=64).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T) >= 0.9
    np.fill_diagonal(link, False)
    true, found = int(link.sum()), sum(r.n_links for r in got.values())
    assert found <= true and found >= 0.9 * true
    assert all(got[i].n_links <= link[i].sum() for i in range(len(rows)))
    want = joined(range(len(rows)), zip(*np.nonzero(np.triu(link)), strict=True))
    assert np.mean([got[i].component_id == want[i] for i in range(len(rows))]) > 0.95
    for i in range(len(rows), len(data)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pivot_index.near_duplicates(df.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert edits.edit_distance(a, b) == distance(a, b)


def test_edit_similarity_of_many_pairs():
    rng = random.Random(12)
    left, right = [], []
    for _ in range(1500):
        a = "".join(rng.choice("abcdeé 漢") for _ in range(rng.randint(0, rng.choice([1, 3, 20, 64, 65, 130, 400]))))
        b = list(a)
        for _ in range(int(len(a) * rng.choice([0, 0.05, 0.15, 0.2, 0.25, 0.5]))):
            at, kind = rng.randrange(len(b) + 1), rng.random()
            b[at:at + (kind < 0.7)] = rng.choice("abxyz") if kind < 0.4 or kind >= 0.7 else ""
        left.append(a)
        right.append("".join(b))
    left += ["", "", "a" * 5000, "ab" * 3000]
    right += ["", "a", "a" * 5000, "ab" * 2000]
    for least in (0.5, 0.8, 1.0):
        want = [edits.similar(a, b, least) for a, b in zip(left, right, strict=True)]
        assert edits.alike(left, right, least).tolist() == want and 0 < sum(want) < len(want)
    assert edits.alike([], [], 0.8).tolist() == []


def lines_brute(rows, least):
    """Occurrences that go, by edit similarity over all pairs of lines."""
    places = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if norm := fuzzy_lines.normalised(line):
                places.setdefault(norm, []).append((d, n))
    keys = sorted(places, key=len)
    links = []
    for i, a in enumerate(keys):
        for j in range(i + 1, len(keys)):
            if len(a) < least * len(keys[j]):
                break
            if edits.similar(a, keys[j], least):
                links.append((i, j))
    groups = {}
    for i, g in joined(range(len(keys)), links).items():
        groups.setdefault(g, []).extend(places[keys[i]])
    return {p for g in groups.values() for p in g} - {min(g) for g in groups.values()}, len(links)


def test_lines_against_brute_force(corpus):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(4)]
    pool = [line for b in base for line in variants(rng, b, 40, 2)] + base * 3 + ["", "  ", "Short line", "short LINE!", "}"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)] + [None, "", "\n\n"]
    df = corpus(texts)
    gone, links = lines_brute(list(enumerate(texts)), 0.8)
    assert links > 50
    assert {(r.doc, r.line) for r in fuzzy_lines.duplicate_lines(df).collect()} == gone
    for r in fuzzy_lines.drop_duplicate_lines(df).collect():
        text = texts[r.doc_id]
        kept = None if text is None else "\n".join(p for n, p in enumerate(text.split("\n")) if (r.doc_id, n) not in gone)
        assert r.text == kept
    assert fuzzy_lines.drop_duplicate_lines(corpus([])).count() == 0


def test_lines_against_edit_similarity_alone(corpus):
    rng = random.Random(9)
    texts = []
    for n in (1, 2, 4, 6, 8, 10, 12, 15, 20, 30, 40, 60) * 6:
        base = [f"{rng.randrange(16 ** 6):06x}" for _ in range(n)]
        other = list(base)
        for k in rng.sample(range(n), max(1, n // 8)):
            other[k] = "".join(rng.sample("ghijklmnop", 6)) if n > 5 else other[k][:3] + "z" + other[k][4:]
        texts += [" ".join(base), " ".join(other)]
    texts += ["abcde", "abcd", "Cat", "cart", "x", "y"]
    gone, links = lines_brute(list(enumerate(texts)), 0.8)
    assert links > 65
    assert {(r.doc, r.line) for r in fuzzy_lines.duplicate_lines(corpus(texts)).collect()} == gone


def test_lines_query_against_edit_similarity_alone(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    gone, _ = lines_brute(rows, 0.8)
    got = entry.queries()["op7_fuzzy_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_removed for r in got) == len(gone)


def test_lines_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    gone, _ = lines_brute(rows, 0.8)
    got = entry.queries()["op7_fuzzy_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_removed for r in got) == len(gone)


def test_simhash_against_brute_force():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(50)]
    lines = ["", *(" ".join(rng.choice(words, n)) for n in (1, 2, 3, 254, 255, 256, 510, 511, 2000))]
    for line, got in zip(lines, fuzzy_lines.simhashes(lines).view(np.uint64).tolist(), strict=True):
        hashes = word_hashes([line.encode()])[0].tolist()
        assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_lines_with_clashing_columns(spark):
    rows = [(1, "one line of some words here\nanother line that stays as it is", 5, "x"), (2, "one line of some words here", 6, "y"), (3, "", 7, "z"), (4, None, 8, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_removed int, left string")
    import corpus_pipeline

    got = {r.doc_id: (r.text, r.n_removed, r.left) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], 5, "x"), 3: ("", 7, "z"), 4: (None, 8, "w")}


def test_lines_that_share_one_frequent_key(spark):
    """Pairs with one common word run, which many unlike lines have too, are found like others."""
    rng = random.Random(5)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    pairs = []
    while len(pairs) < 4:
        one = ["common", "phrase", "here", *[word() for _ in range(12)]]
        two = [w[:4] + "0" + w[5:] if i >= 3 and i % 3 == 0 else w for i, w in enumerate(one)]
        found, keys = fuzzy_lines.sketches([" ".join(one), " ".join(two)])
        apart = sum(int(np.bitwise_count(found[c].view(np.uint64)[:1] ^ found[c].view(np.uint64)[1:])[0]) for c in fuzzy_lines.WORD_SIMS)
        if apart <= fuzzy_lines.WORD_BITS:
            assert len(set(keys[0].tolist()) & set(keys[1].tolist())) == 1 and edits.similar(" ".join(one), " ".join(two), 0.8)
            pairs.append((" ".join(one), " ".join(two)))
    lines = [x for p in pairs for x in p] + [" ".join(["common", "phrase", "here", *[word() for _ in range(12)]]) for _ in range(50)]
    for most in (1024, 16):  # as one table of pairs, and by blocks
        old, fuzzy_lines.PAIRED = fuzzy_lines.PAIRED, most
        try:
            gone = fuzzy_lines.duplicate_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"))
            assert sorted(r.doc for r in gone.collect()) == [1, 3, 5, 7]
        finally:
            fuzzy_lines.PAIRED = old


def test_near_pairs_keep_every_similar_pair():
    """Pairs of a bucket, whole and cut into blocks, against all pairs that the sketches allow; none that is similar is dropped."""
    rng = random.Random(11)
    lines = []
    for _ in range(60):
        base = "".join(rng.choice("abcde ") for _ in range(rng.randint(4, 70)))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(0, len(base) // 6)):
                at = rng.randrange(len(other))
                other[at:at + rng.randint(0, 1)] = rng.choice("abcde ")
            lines.append(fuzzy_lines.normalised("".join(other)))
    lines = sorted({x for x in lines if x})
    found, _ = fuzzy_lines.sketches(lines)
    found["size"] = np.array([len(x) for x in lines])
    ids, similar, listed = np.arange(len(lines)), set(), []
    for blocks in (1, 3):
        tables = []
        for cell, (i, j) in enumerate((i, j) for i in range(blocks) for j in range(i, blocks)):
            rows = np.flatnonzero((ids % blocks == i) | (ids % blocks == j))
            tables.append(pa.table({"id": ids[rows], "g": ids[rows] // 2, "own": ids[rows] % blocks, "cell": np.full(len(rows), cell), "single": np.full(len(rows), i == j), **{c: found[c][rows] for c in fuzzy_lines.NODE}}))
        got = [p for t in fuzzy_lines._near_pairs(pa.concat_tables(tables), 0.8) for p in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True)]
        assert len(got) == len(set(got)) and all(a < b and a // 2 != b // 2 for a, b in got)
        listed.append(set(got))
    words, grams = ([found[c].view(np.uint64) for c in names] for names in (fuzzy_lines.WORD_SIMS, fuzzy_lines.GRAM_SIMS))
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            near = [sum(int(np.bitwise_count(x[a] ^ x[b])) for x in sims) for sims in (words, grams)]
            allowed = near[0] <= fuzzy_lines.WORD_BITS or found["short"][a] and found["short"][b] and near[1] <= fuzzy_lines.GRAM_BITS or max(len(lines[a]), len(lines[b])) <= fuzzy_lines.TINY
            if a // 2 != b // 2 and allowed and edits.similar(lines[a], lines[b], 0.8):
                similar.add((a, b))
    assert listed[0] == listed[1] >= similar and len(similar) > 30


def test_edit_bands_of_many_pairs():
    """Batches by bands, with heads first, against the plain distance: shifts up to the edge of a band, and texts of one batch that end apart."""
    rng = random.Random(12)
    left, right = [], []
    for _ in range(400):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([40, 150, 170, 310, 330, 640, 900]) + rng.randint(0, 30)))
        cut = int(len(a) * rng.choice([0.05, 0.09, 0.1, 0.11, 0.19, 0.2, 0.21]))
        shift = "".join(rng.choice("xyz") for _ in range(cut))
        left.append(a)
        right.append(rng.choice([shift + a[:len(a) - cut], a[cut:] + shift, a[cut:], shift + a, a]))
    for least in (0.8, 0.9):
        want = [edits.similar(a, b, least) for a, b in zip(left, right, strict=True)]
        assert edits.alike(left, right, least).tolist() == want and 0 < sum(want) < len(want)


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList().mkString("\n").count("shuffle_")
    for store in (stored, Steps().store):
        before = files()
        out = store(spark.range(2000).groupBy((F.col("id") % 1000).alias("k")).count(), "shuffle-test")
        end = time.time() + 10
        while files() > before and time.time() < end:
            time.sleep(0.2)
        assert files() <= before and out.count() == 1000


def test_lines_of_large_buckets(spark):
    """Many unlike lines with a run of words in common, and groups of near copies among them, some of longer lines than the sketches hold."""
    rng = random.Random(21)

    def words(n):
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]
    lines = []
    for n in (3, 20, 300):
        bases = [["common", "run", "here", *words(n)] for _ in range(60)]
        lines += [" ".join(x) for x in bases]
        lines += [" ".join([w[:3] + w[4:] if 3 <= i and i % 6 == 3 else w for i, w in enumerate(x)]) for x in bases[:20]]
    gone, links = lines_brute(list(enumerate(lines)), 0.8)
    assert links >= 60
    assert {(r.doc, r.line) for r in fuzzy_lines.duplicate_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()} == gone


def test_normalised_lines_equal_single_lines():
    rng = random.Random(22)
    signs = "aB Σσςİıß\t\r_-9٣²Ⅷ漢́. " + "\n" * 4
    for _ in range(200):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4))]
        assert fuzzy_lines.normalised_lines(texts) == [fuzzy_lines.normalised(x).encode() for t in texts for x in t.split("\n")]


def test_word_bits_keep_pairs_with_scattered_typos():
    """Lines in which a letter of half the words differs pass the filter by words; unlike lines do not."""
    rng = random.Random(23)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(4000)]
    one = [[rng.choice(pool) for _ in range(n)] for n in (15, 30, 60, 120, 200, 400) * 20]
    two = [[w[:1] + "z" + w[2:] if k in touched else w for k, w in enumerate(x)] for x in one for touched in [set(rng.sample(range(len(x)), len(x) // 2))]]
    found = [fuzzy_lines._columns(fuzzy_lines._described([" ".join(x).encode() for x in part])[0]) for part in (one, two)]
    every = np.arange(len(one))
    assert len(fuzzy_lines._near(found[0], every, found[1], every, 0.8)) >= 0.99 * len(one)
    assert len(fuzzy_lines._near(found[0], every, found[1], (every + 6) % len(one), 0.8)) == 0


def test_components_at_once(spark):
    rng = random.Random(24)
    links = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    found = [{(r.node, r.component) for r in components(df, steps=Steps(), at_once=most).collect()} for most in (0, 1000)]
    assert found[0] == found[1] and len(found[0]) > 300
