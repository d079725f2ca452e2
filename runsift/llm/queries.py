"""Queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.llm import arrow_shards, bpe_fst, fuzzy_lines, lang_crf, latent_leaks, lpf_dedup, ngram_join, nra_search, pivot_index, prefix_tokens, projection_forest, secret_markov, zfast_trie
from runsift.llm.common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


#: Documents that no model learns from.
HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 5 = 0"


@query
def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by the chain model, trained on documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = lang_crf.train(docs.where(~F.expr(HELD_OUT)))
    return lang_crf.predict(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


@query
def op2_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the prefix table, and where a limit of 4096 tokens would cut."""
    got = prefix_tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), budget=4096)
    return got.select("doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars")


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts whose sets of three-word shingles have Jaccard similarity 0.9 or more."""
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), percent=90, size=3)


@query
def op4_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors with cosine 0.9 or more."""
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op5_arrow_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the corpus as Arrow shards of equal-length sequences and read every document back from them."""
    manifest = arrow_shards.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return arrow_shards.read_documents(manifest, keep=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text by the transducer and decode it again."""
    got = bpe_fst.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text left after one occurrence of each group of similar lines is kept."""
    got = fuzzy_lines.drop_duplicate_lines(table(spark, sf_dir, "documents"), similarity=0.8)
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without every byte that a repeated string of 200 bytes covers."""
    got = lpf_dedup.remove_repeats(table(spark, sf_dir, "documents"), least=200, keep="none")
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


@query
def op9_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: base spans by pattern, further ones by the Markov models."""
    docs = table(spark, sf_dir, "documents")
    found = secret_markov.find_secrets(docs, secret_markov.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_markov.joined("base"), 256).alias("base_sha256"), secret_markov.joined("found").alias("spans"))


@query
def op10_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents by latent retrieval and verified on words."""
    return latent_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return nra_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


#: Runs of everything but ASCII characters that are neither letters nor digits, with only A-Z in lower case.
_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES["op11_nra_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(t))::HUGEINT AS n_all FROM d WHERE len(t) > 0),
q AS (SELECT i, item_id, unnest(t) AS term FROM b),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 25 + (75 * len(t)::HUGEINT * n_docs) // n_all AS m FROM d, s),
h AS (SELECT q.i, q.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM h WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM p WHERE rank <= 10"""


@query
def op12_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of the conversations, whose openings come from one conversation in a hundred."""
    source = table(spark, sf_dir, "conversations")
    turns = stored(zfast_trie.shared_openings(zfast_trie.turn_rows(source)), "trie-turns")
    return zfast_trie.trie_nodes(turns, source.select(F.col("conv_id").cast("bigint").alias("conv")))


#: CRC-32 (reflected, polynomial 0xEDB88320) of the decimal digits of a column, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda z: ord(z)::BIGINT)),
    lambda acc, z: list_reduce([xor(acc, z), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
ORACLES["op12_zfast_trie"] = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS v, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, {_CRC.format('c')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT c.c, t.d, t.v, t.n FROM c JOIN t ON t.c = c.c - c.c % 100 AND t.d <= c.h),
k AS (SELECT c, count(*) AS k FROM b GROUP BY c),
s AS (FROM b UNION ALL SELECT c.c, coalesce(k, 0) + d - h, v, n FROM t JOIN c ON t.c = c.c LEFT JOIN k ON k.c = c.c WHERE d > h),
p AS (SELECT c, d, n, md5(string_agg(v, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM s UNION ALL SELECT c, 0, 0, '' FROM c),
l AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, lead(key) OVER (PARTITION BY c ORDER BY d) AS down FROM p),
g AS (SELECT key, any_value(up) AS up, min(c) AS conv_id, any_value(d) AS depth, any_value(n) AS n, count(*) AS n_convs, count(DISTINCT down) AS n_children,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE down IS NULL), '')) AS ends_sha256 FROM l GROUP BY key),
a AS (SELECT p.key, sum(CASE WHEN g.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((g.n_convs - 1) * g.n)::BIGINT AS saved_tokens
    FROM g JOIN p ON p.c = g.conv_id AND p.d <= g.depth GROUP BY p.key)
SELECT g.conv_id, g.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n_convs, g.n_children, a.n_leaves, a.saved_tokens, g.ends_sha256
FROM g JOIN a USING (key) LEFT JOIN g AS u ON u.key = g.up"""


@query
def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    return projection_forest.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the cleaning pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
