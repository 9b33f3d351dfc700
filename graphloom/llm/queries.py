"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, huffman, jaccard, langid, pii, secrets, tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.new_path(spark, "token-files")
    huffman.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return huffman.read_checksums(spark, path)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(_read(spark, sf_dir, "documents")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = given.unionByName(own).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digest(chat.parse(chat.format_chats(turns)))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(_read(spark, sf_dir, "documents"), n=4, threshold=(85, 100))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_token_counts": op2_token_counts,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_token_files": op4_token_files,
        "op5_secret_scan": op5_secret_scan,
        "op6_pii": op6_pii,
        "op7_chat_format": op7_chat_format,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_language_id": op10_language_id,
    }


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL = {
    "op1_decontaminate": f"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item, least(13, len(words)) AS n, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0),
x AS (SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS g FROM s),
k AS (SELECT DISTINCT n FROM x),
d AS (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM w, k WHERE len(words) >= n),
h AS (SELECT doc_id, i, d.n, item FROM d JOIN x ON x.n = d.n AND x.g = array_to_string(words[i : i + d.n - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id)""",
    "op7_chat_format": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + length('<s>[role][/role]</s>') AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM e GROUP BY 1""",
    "op8_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) USING (doc_id)""",
}


def oracle_sql() -> dict:
    return dict(_SQL)
