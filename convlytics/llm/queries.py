"""The registered queries of the training-data operators, and their SQL.

Each query applies one operator, with its production parameters, to the whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlytics.llm import decontaminate, fingerprints, language_id, licenses, pii, quality, segmentation, toxicity
from convlytics.llm.hard_negatives import hard_negatives, relabelled
from convlytics.llm.ngram_join import jaccard_components
from convlytics.llm.packing import pack
from convlytics.llm.prefix_trie import prefix_nodes, rebuilt, sequences
from convlytics.llm.scratch import settle
from convlytics.llm.suffix_dedup import repeated_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_ngram_jaccard")
def op1_ngram_jaccard(spark, sf_dir):
    """Components of documents whose 3-word shingle sets have a Jaccard of 0.9 or more."""
    return jaccard_components(documents(spark, sf_dir), k=3, num=90, den=100)


@query("op7_suffix_array")
def op7_suffix_array(spark, sf_dir):
    """Documents with passages of 50 words or more that stand in other documents, too."""
    return repeated_documents(documents(spark, sf_dir))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """Language of every document by nearest centroid; a quarter of the rows is held out."""
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    return (language_id.identify(docs, model)
            .select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_packing")
def op3_packing(spark, sf_dir):
    """All documents in sequences of up to 2048 tokens."""
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query("op5_pii")
def op5_pii(spark, sf_dir):
    """Personal data of all documents: base spans and those the trees add."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@query("op2_fingerprints")
def op2_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edited_likeness(documents(spark, sf_dir))


@query("op6_license_scan")
def op6_license_scan(spark, sf_dir):
    """Licence phrases and notices in all documents."""
    return licenses.scan(documents(spark, sf_dir))


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    """Rule measures of all documents and the verdict of the estimated rules."""
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """Toxicity of all documents; a fifth of the rows is held out."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    """Sampled segmentations of all documents, and whether decoding gives the text back."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = vocabulary("piece_bpe_32k.model")
    rows = segmentation.decode(segmentation.encode(docs, model), model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_decontaminate")
def op13_decontaminate(spark, sf_dir):
    """Words of all documents inside windows of ten benchmark words, and the items they are from."""
    found = decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = decontaminate.n_hit()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))


@query("op11_prefix_trie")
def op11_prefix_trie(spark, sf_dir):
    """All nodes of the trie of rebuilt conversations, and what sharing their turns saves."""
    return prefix_nodes(rebuilt(sequences(settle(spark).read.parquet(f"{sf_dir}/conversations.parquet"))))


@query("op12_hard_negatives")
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of all anchors, for each of their five best positives."""
    return hard_negatives(relabelled(settle(spark).read.parquet(f"{sf_dir}/embeddings.parquet")))


SQL["op13_decontaminate"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS k
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM docs, (SELECT DISTINCT size FROM windows) AS s, unnest(range(1, len(w) - size + 2)) AS t(i)),
found AS (
  SELECT r, i, p.size, item_id FROM places p JOIN windows v ON p.size = v.size AND p.k = v.k),
hit AS (
  SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, size FROM found), unnest(range(size)) AS t(j) GROUP BY r),
who AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN who USING (r)
"""

SQL["op11_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                 lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
whole AS (
  SELECT c.conv_id, 0 AS part, t.i, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL SELECT c.conv_id, 1, t.i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h),
steps AS (
  SELECT conv_id, text, row_number() OVER w AS depth, sha256(to_json(list([role, text]) OVER w)::VARCHAR) AS node
  FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ways AS (
  SELECT conv_id, 0 AS depth, 'root' AS node, '' AS text FROM convs UNION ALL SELECT conv_id, depth, node, text FROM steps),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM ways GROUP BY conv_id) GROUP BY node),
nodes AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS words
  FROM ways GROUP BY node),
up AS (
  SELECT n.node, p.node AS parent FROM nodes n JOIN ways p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
below AS (
  SELECT a.node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN ways a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY a.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
LEFT JOIN up ON up.node = n.node LEFT JOIN nodes p ON p.node = up.parent
"""

SQL["op12_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
