"""Registered queries of the operators for training data, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from findmill.llm import byte_bpe, exact_dedup, hard_negatives, line_dedup, lsh_forest, merkle, mixing, ngram_join, packing
from findmill.llm import token_count, toxicity, url_rules, warc
from findmill.llm.tables import ascii_lower, table

#: The url rules of the query, as (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SPACE_CLASS = r"[\x20\x09-\x0D]"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select(
        warc.record_key(F.col("record")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.record_key(F.col("refers_to")).cast("long").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS top,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1)::INTEGER, 1)), '') AS digest
  FROM p
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), words=4, threshold=85)


OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{SPACE_CLASS}+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(len(words) - 3),
      lambda i: array_to_string(words[i + 1 : i + 4], ' '))) END AS shingles
  FROM w
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x
), smallest AS (
  SELECT x, min(y) AS component_id FROM reached GROUP BY x
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, smallest.component_id
FROM s JOIN smallest ON s.doc_id = smallest.x
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), "quality")
    labelled = pages.select("page_id", "url").join(labels, "page_id")
    rules = url_rules.mine_rules(labelled, "url", F.col("quality") == 0, F.col("page_id"))
    judged = url_rules.judge_urls(pages.select("page_id", "url"), rules, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = byte_bpe.decode_ids(encoded)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, mixing.plan_mix(docs)).select("doc_id", "source", "epoch", "block", "slot")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs.join(labels.hint("merge"), "doc_id"), "text", "toxic", "doc_id")
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND f.keeper <> k.doc_id AS dropped
  FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False)), ascii_lower(F.col("text")))
    fields = {name: F.col(name) for name in merkle.FIELDS} | {"text": F.coalesce(tampered, "text")}
    manifest = merkle.build_manifest(docs, tampered=merkle.leaf_of(*fields.values()))
    folded = merkle.climbed(F.col("tampered"), F.col("way"))
    return merkle.proofs(manifest).select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        merkle.siblings_hash(F.col("way")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF_SQL = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"
# crc32 bit by bit over the digits of doc_id
_CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
    4294967295::BIGINT))"""


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs of a tree's nodes, and of each node's siblings to the left and right."""
    return f"""{name}_nodes AS (
  SELECT tree, 0 AS level, row_number() OVER (PARTITION BY tree ORDER BY key NULLS FIRST, h) - 1 AS pos, h,
    count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, pos // 8
), {name}_steps AS (
  SELECT a.tree, a.level, a.pos,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM {name}_nodes AS a JOIN {name}_nodes AS b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos
)"""


def _climb_sql(name: str, tree: str, start: str) -> str:
    """A CTE that folds each of ``start(key, tree, pos, h, proof)`` up to its tree's root."""
    return f"""{name} AS (
  SELECT key, tree, 0 AS level, pos, h, proof FROM {start}
  UNION ALL
  SELECT c.key, c.tree, c.level + 1, c.pos // 8, sha256(s.l || c.h || s.r), c.proof || s.l || s.r
  FROM {name} AS c JOIN {tree}_steps AS s ON s.tree = c.tree AND s.level = c.level AND s.pos = c.pos
)"""


OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT coalesce('=' || lang, '-') AS tree, doc_id AS key, {_LEAF_SQL.format(text="text")} AS h,
    CASE WHEN {_CRC_SQL} % 3 = 0
      THEN {_LEAF_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {_LEAF_SQL.format(text="text")} END AS tampered
  FROM documents
), {_tree_sql("low", "leaves")}, subroots AS (
  SELECT '' AS tree, tree AS key, h FROM low_nodes WHERE n = 1
), {_tree_sql("top", "subroots")}, placed AS (
  SELECT key, tree, row_number() OVER (PARTITION BY tree ORDER BY key NULLS FIRST, h) - 1 AS pos, tampered AS h, '' AS proof FROM leaves
), {_climb_sql("to_subroot", "low", "placed")}, at_subroot AS (
  SELECT * FROM to_subroot QUALIFY row_number() OVER (PARTITION BY key, tree ORDER BY level DESC) = 1
), entered AS (
  SELECT a.key, '' AS tree, t.pos, a.h, a.proof, a.tree AS lang
  FROM at_subroot AS a JOIN (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM subroots) AS t ON t.key = a.tree
), {_climb_sql("to_root", "top", "entered")}, at_root AS (
  SELECT * FROM to_root QUALIFY row_number() OVER (PARTITION BY key ORDER BY level DESC) = 1
)
SELECT l.key AS doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256,
  f.h AS folded_root, f.h = r.h AS verified
FROM leaves AS l JOIN subroots AS s ON s.key = l.tree JOIN at_root AS f ON f.key = l.key
CROSS JOIN (SELECT h FROM top_nodes WHERE n = 1) AS r
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_warc": (op1_warc, OP1_SQL),
    "op2_ngram_join": (op2_ngram_join, OP2_SQL),
    "op3_url_filter": (op3_url_filter, None),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_mixing": (op6_mixing, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op9_lsh_forest": (op9_lsh_forest, None),
    "op10_token_count": (op10_token_count, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_merkle_manifest": (op12_merkle_manifest, OP12_SQL),
    "op13_packing": (op13_packing, None),
}
