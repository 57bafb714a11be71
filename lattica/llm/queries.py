"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, html_extract, line_dedup, packing, sharding, simhash, topk, toxicity

#: What both turns of the conversation added to the others say.
PROBE = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("f0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.embedding_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), room=2048)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors.where(F.col("id") % 50 == 0), vectors, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_trees(chat.chains(table.union(probe)), branches=1)
    conv = F.when(F.col("tree") != "null", F.col("tree")).cast("long")
    columns = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return chat.digests(formatted).select(conv.alias("conv_id"), *columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), ratio=0.02, min_pages=5)
    return cleaned.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(_table(spark, sf_dir, "documents"), shards=16)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return dealt.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_embedding_dedup, op3_toxicity, op4_packing, op5_top_k, op6_chat_format, op7_line_dedup, op8_html_extract, op9_sharding, op10_bpe,
    )
}

_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

ORACLE_SQL = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        ), component AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
        FROM embeddings e JOIN component c ON c.a = e.vec_id
    """,
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, k::INT AS rank, vec_id, score FROM r WHERE k <= 5
    """,
    "op6_chat_format": rf"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS role0, text AS text0 FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{PROBE}', 'user', '{PROBE}'
            UNION ALL SELECT -7, 1, 'assistant', '{PROBE}', 'assistant', '{PROBE}'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(15 + length(replace({_ESCAPED.format("role")}, ':', '\:')) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op7_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS k, * FROM documents),
        l AS (SELECT k, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
        h AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
        c AS (SELECT source, line, count(DISTINCT k) AS n FROM l WHERE regexp_matches(line, '\S') GROUP BY source, line),
        b AS (SELECT c.source, c.line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n >= 5 AND c.n > 0.02 * h.pages),
        m AS (SELECT l.k, l.pos, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
        g AS (SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                     coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY k)
        SELECT d.doc_id, d.source, coalesce(g.n_lines, 0)::INT AS n_lines, coalesce(g.n_dropped, 0)::INT AS n_dropped, g.text
        FROM d LEFT JOIN g USING (k)
    """,
}
