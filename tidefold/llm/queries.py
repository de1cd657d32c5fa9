"""The queries of this subpackage as they are registered, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidefold.llm.common import materialize, read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidefold.llm import bpe

    rows = bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import langid

    return langid.identify(read_table(spark, sf_dir, "documents"), "doc_id", declared="lang", host="source")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over `pages`, where all its evidence speaks: text, declared markup language, address suffix, priors of host and domain."""
    from tidefold.llm import langid

    rows = materialize(langid.page_evidence(read_table(spark, sf_dir, "pages")), "page-evidence")
    return langid.identify(rows, "page_id", declared="declared", host="host")


def op3_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import embeddings

    return embeddings.components(read_table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import quality

    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import packing

    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import near_dup

    return near_dup.components(read_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import html_text

    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import toxicity

    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import token_store

    return token_store.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidefold.llm import warc

    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe_codec, op2_language_id, op3_embedding_dup, op4_quality, op5_packing, op6_near_dup, op7_html_text, op8_toxicity, op9_token_store, op10_warc, pages_language)}


OP10_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f"""


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.reached FROM r JOIN l ON l.x = r.vec_id),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id"""

OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END, ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.reached FROM r JOIN l ON l.x = r.doc_id),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""


def oracle_sql() -> dict[str, str]:
    from tidefold.llm import quality

    return {"op3_embedding_dup": OP3_SQL, "op4_quality": quality.oracle(), "op6_near_dup": OP6_SQL, "op10_warc": OP10_SQL}
